"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of w consecutive
hashes the minimum is chosen, the rightmost where hashes tie; each chosen hash
is kept once with its position.  Any passage of k + w - 1 code points that two
texts share puts at least one common hash into both fingerprints.

A text of fewer than k code points has one gram, all of it; an empty text has
none.  Short texts keep all their k-grams, which hold the chosen ones of any w,
and very short ones their 3-grams too.  Two fingerprints are compared at the
coarser of their schemes: chosen grams with chosen ones, unless both texts keep
more.  Two empty fingerprints are alike (1.0), an empty one and another not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftcube.llm.common import prepare, text_of, with_columns_mapped

#: Production parameters: gram and window, in code points and grams. Matches of K + W - 1 code points are guaranteed.
K, W = 8, 8
#: Texts of fewer code points keep all their grams, and those of fewer than the second number all grams of SHORT_K code points as well.
DENSE, SHORT, SHORT_K = 64, 32, 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHOSEN = np.dtype([("hash", ">u4"), ("position", ">u4")])


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """32-bit hashes of the k-grams, rolled up by doubling: grams of length 2m from two of length m."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(k, len(points))
    if not k:
        return np.empty(0, np.uint32)
    power, length, block = _BASE, 1, points
    out, done = None, 0
    n = len(points) - k + 1
    with np.errstate(over="ignore"):
        while length <= k:
            if k & length:  # a binary digit of k: append a block of this length
                piece = block[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += length
            if 2 * length <= k:
                block = block[: len(block) - length] * power + block[length:]
            power = power * power
            length *= 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions chosen, ascending: minima of all windows of w hashes, rightmost ties."""
    if not len(hashes):
        return np.empty(0, np.int64)
    w = min(w, len(hashes))
    best, length = np.arange(len(hashes)), 1

    def lower(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] <= hashes[left], right, left)

    while 2 * length <= w:
        best = lower(best[:-length], best[length:])
        length *= 2
    if length < w:
        n = len(hashes) - w + 1
        best = lower(best[:n], best[w - length : w - length + n])
    return best[np.concatenate(([True], best[1:] != best[:-1]))]


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[str, tuple[np.ndarray, ...]]:
    """The fingerprint as hex digits (8 of the hash, 8 of the position, each gram kept) and its distinct hashes by scheme, the coarsest first."""
    hashes = gram_hashes(text, k)
    chosen = winnow(hashes, w)
    values = hashes[chosen]
    sets = [np.unique(values)]
    if len(text) < DENSE:
        values, chosen = hashes, np.arange(len(hashes))
        sets.append(np.unique(values))
    if len(text) < SHORT:
        short = gram_hashes(text, SHORT_K) if len(text) > SHORT_K else np.empty(0, np.uint32)
        values, chosen = np.concatenate((values, short)), np.concatenate((chosen, np.arange(len(short))))
        sets.append(np.unique(values))
    both = np.empty(len(chosen), _CHOSEN)
    both["hash"], both["position"] = values, chosen
    return both.tobytes().hex(), tuple(sets)


def parse(text: str) -> list[tuple[int, int]]:
    """(hash, position) pairs of a fingerprint string."""
    return [(int(h), int(p)) for h, p in np.frombuffer(bytes.fromhex(text), _CHOSEN)]


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Jaccard index of two fingerprints' hashes, at the finest scheme that both have."""
    a, b = list(zip(a, b))[-1]
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def with_fingerprints(df: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``fingerprint`` (string) of column ``text``; a null text counts as empty and has an empty fingerprint.

    Long texts are read whole; hashes that tie give the rightmost position.  A
    column of ``df`` named fingerprint is replaced; all others stay, repeated
    rows too; an empty table gives an empty result.
    """
    prepare(df.sparkSession)
    return with_columns_mapped(
        df, [T.StructField("fingerprint", T.StringType())], lambda: lambda texts: ([fingerprint(t or "", k, w)[0] for t in texts],), text
    )


_EDITED = (
    "doc_id long, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def with_next_document(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W, keep_text: bool = True) -> DataFrame:
    """Fingerprints of each document, of its edited text and their likeness; see ``_EDITED`` for the columns.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many of the next document by ascending (doc_id, text), null ids first;
    the last document's next is the first.  Repeated rows follow each other.
    Null texts count as empty, other columns are left out, an empty table gives
    an empty result.  ``keep_text`` False leaves ``edited`` null.

    Documents are dealt into ranges of ids and sorted there once; each range
    also gets a copy of the next range's first document.  Of the whole table
    the driver only sees ids: a bound and the first id for each range.
    """
    spark = prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 8 * partitions
    ids = docs.select("doc_id")
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.min("doc_id").alias("m")).first()
    bounds = np.unique(np.array(found["q"] or [], np.int64))

    def buckets(values: list) -> np.ndarray:
        known = np.array([v is not None for v in values], bool)
        filled = np.array([v if v is not None else 0 for v in values], np.int64)
        return np.where(known, np.searchsorted(bounds, filled, side="right") + 1, 0)

    firsts = [tuple(r) for r in ids.groupBy(_bucket_of("doc_id", bounds).alias("b")).agg(F.min("doc_id")).orderBy("b").collect()]
    #: id of a range's first document -> the range before it (the last one for the first)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            own = buckets(values)
            ghosts = [i for i, v in enumerate(values) if v in before]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(np.zeros(len(own), np.int8)), batch.column(0), batch.column(1)], names=["bucket", "ghost", "doc_id", "text"]
            )
            if ghosts:
                part = batch.take(pa.array(ghosts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([before[values[i]] for i in ghosts], pa.int64()), pa.array(np.ones(len(ghosts), np.int8)), part.column(0), part.column(1)],
                    names=["bucket", "ghost", "doc_id", "text"],
                )

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prints, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                current, kept = row, None
                if held is not None and held[1] == 0 and held[0] == row[0]:
                    made, kept = _edited(held, row[3], prints, k, w, keep_text)
                    out.append(made)
                held, prints = current, kept
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _ARROW)], names=_NAMES)
                out = []

    dealt = docs.mapInArrow(deal, "bucket long, ghost byte, doc_id long, text string")
    dealt = dealt.repartitionById(partitions, F.col("bucket").cast("int"))  # equal numbers of ranges, where a hash would pile some up
    return dealt.sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(follow, _EDITED)


def _bucket_of(column: str, bounds: np.ndarray) -> F.Column:
    """The range of an id as an expression over the ids alone (no texts pass through Python)."""

    @F.pandas_udf("long")
    def bucket(values):
        import pandas as pd

        known = values.notna().to_numpy()
        return pd.Series(np.where(known, np.searchsorted(bounds, values.fillna(0).astype("int64").to_numpy(), side="right") + 1, 0))

    return bucket(F.col(column))


_NAMES = [part.strip().split(" ")[0] for part in _EDITED.split(",")]
_ARROW = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[part.strip().split(" ")[1]] for part in _EDITED.split(",")]


def _edited(row: tuple, following: str, prints: tuple | None, k: int, w: int, keep_text: bool) -> tuple[tuple, tuple]:
    """The result row of a document, and the next document's own fingerprint for its turn."""
    text = row[3]
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    own, own_set = prints or fingerprint(text, k, w)
    changed, changed_set = (own, own_set) if edited == text else fingerprint(edited, k, w)
    after = fingerprint(following, k, w)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return (row[2], len(text), edited if keep_text else None, digest, own, changed, likeness(own_set, changed_set), likeness(own_set, after[1])), after
