"""Ranked lexical search as a blocked sparse matrix product.

Items times documents = (item-term multiplicities) times (term-document
impacts).  One pass over the texts writes the right matrix in blocks of
documents: for each term of the items the documents that hold it and how often,
a row of the matrix after another, with the block's part of the counts of
documents, terms and document frequencies.  Those sums give the weights, and
each block's frequencies become int64 impacts.  A block's product merges, for
each item, the rows of its terms (Gustavson) in numpy; a task keeps the k best
of each item over its blocks, and two rounds of ranks leave the k best of all.

Items with more terms than one pass may hold go in slabs of bounded size, a
pass over the documents each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftcube.llm.byte_words import separators, words
from driftcube.llm.common import prepare, stage, text_of, with_columns_mapped, with_running_sum

#: Production parameters: results of an item; term weight, tf scale and saturation, length share of a document's score.
K, WEIGHT, SCALE, TF, LENGTH, SATURATION = 10, 1000, 1_000_000_000, 1000, 75, 8
#: Entries (item, term) of one slab: its terms and multiplicities are broadcast. A slab exceeds it by less than one item.
ENTRIES = 500_000
#: Documents and entries from which on a block is closed.
DOCS, POSTINGS = 8192, 1_000_000
#: Parts in which results are ranked first.
FAN = 64

#: A term: ASCII letters and digits and all that is not ASCII; only A-Z are lower-cased.
_TERMS = separators("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", lower=True)
_BLOCK = "no long, docs long, terms long, doc_id array<long>, n array<long>, term array<int>, df array<int>, at binary, tf binary"
_MOST = 2**63


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(no, item_id, terms, times, size) of the items that have terms, a row an item."""

    def rows():
        def batch(texts):
            found = []
            for t in texts:
                counts: dict[bytes, int] = {}
                for piece in words(t, _TERMS):
                    for w in piece:
                        counts[w] = counts.get(w, 0) + 1
                found.append(counts)
            return [list(c) for c in found], [list(c.values()) for c in found], [len(c) for c in found]

        return batch

    fields = [T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())]
    asked = items.select(F.col(item_id).alias("item_id"), text_of(text).cast("binary").alias("text"))
    found = with_columns_mapped(asked, fields, rows, "text", drop=["text"]).where("size > 0")
    return stage(found.withColumn("no", F.monotonically_increasing_id()), "items")


def _slabs(items: DataFrame, entries: int) -> tuple[DataFrame, int]:
    """``items`` with ``slab``, and how many slabs there are."""
    total = items.agg(F.sum("size")).first()[0] or 0
    if total <= entries:
        return items.withColumn("slab", F.lit(0)), 1 if total else 0
    dealt = with_running_sum(items, [], ["no"], "size", F.pmod(F.xxhash64("no"), F.lit(1024)), "before")
    dealt = stage(dealt.withColumn("slab", F.floor(F.col("before") / entries).cast("int")).drop("before"), "slabs")
    return dealt, dealt.agg(F.max("slab")).first()[0] + 1


class _Block:
    """What a task holds of the block that it builds."""

    def __init__(self):
        self.docs = self.terms = self.entries = 0
        self.ids, self.lengths, self.places, self.found, self.times = [], [], [], [], []

    def add(self, doc_id: int | None, n: int, parts: list[np.ndarray]) -> None:
        self.docs += n > 0
        self.terms += n
        if parts:
            term, times = np.unique(np.concatenate(parts), return_counts=True)
            self.places.append(np.full(len(term), len(self.ids), np.int32))
            self.found.append(term)
            self.times.append(times.astype(np.int32))
            self.entries += len(term)
            self.ids.append(doc_id)
            self.lengths.append(n)

    def row(self, schema: pa.Schema, no: int) -> pa.RecordBatch:
        """The block with the entries of a term after another, documents ascending in each."""
        empty = np.empty(0, np.int32)
        term, at, tf = (np.concatenate([empty, *x]) for x in (self.found, self.places, self.times))
        order = np.argsort(term, kind="stable")
        names, df = np.unique(term, return_counts=True)
        values = [no, self.docs, self.terms, self.ids, self.lengths, names, df.astype(np.int32), at[order].tobytes(), tf[order].tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _blocks(docs: DataFrame, doc_id: str, text: str, terms: dict[bytes, int], most_docs: int, most_entries: int) -> DataFrame:
    """The term-document matrix over ``terms`` (numbered from 1) in blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(_BLOCK))
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # of one slab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, no, held = sent.value.get, TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, parts = 0, []
                for piece in words(t.as_py(), _TERMS):
                    n += len(piece)
                    if hits := list(filter(None, map(number, piece))):
                        parts.append(np.array(hits, np.int32))
                held.add(i, n, parts)
                if len(held.ids) >= most_docs or held.entries >= most_entries:
                    yield held.row(schema, no)
                    no, held = no + 1, _Block()
        if held.docs:
            yield held.row(schema, no)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, _BLOCK), "blocks")


def _impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) of each entry, m from the length n of its document."""
    if LENGTH * int(n.max(initial=0)) * docs < _MOST:
        m = (100 - LENGTH) + (LENGTH * n * docs) // terms
    else:  # a product that no int64 holds
        m = np.array([(100 - LENGTH) + LENGTH * int(x) * docs // terms for x in n], np.int64)
    return weight * ((SCALE * tf) // (TF * tf + SATURATION * m))


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by ascending id, unknown ids last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~known[at], -scores[at]))[:k]]


def _products(blocks: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, terms: int, k: int) -> DataFrame:
    """(no, part, doc_id, score): the k best of each item over the blocks of a task."""
    sent = blocks.sparkSession.sparkContext.broadcast((items, weights))  # of one slab

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = sent.value
        held: dict[int, tuple[np.ndarray, ...]] = {}
        part = None
        for batch in batches:
            for r in range(batch.num_rows):
                read = lambda name: batch.column(name)[r]  # noqa: B023, E731
                ids, n, names, df = (read(c).values for c in ("doc_id", "n", "term", "df"))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids, n, names, df = ids.fill_null(0).to_numpy(), n.to_numpy(), names.to_numpy(), df.to_numpy()
                at, tf = (np.frombuffer(read(c).as_buffer(), np.int32) for c in ("at", "tf"))
                part = read("no").as_py() % FAN if part is None else part
                term_of = np.repeat(names, df)
                impact = _impacts(weights[term_of], tf.astype(np.int64), n[at], docs, terms)
                first, last = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
                last[names] = np.cumsum(df)
                first[names] = last[names] - df
                for no, wanted, times in items:
                    total = np.zeros(len(ids), np.int64)
                    for t, x in zip(wanted, times):  # a term's documents are distinct, so its row adds up by places
                        row = slice(first[t], last[t])
                        total[at[row]] += x * impact[row]
                    hits = np.flatnonzero(total > 0)
                    if len(hits):
                        best = hits[_best(total[hits], ids[hits], known[hits], k)]
                        new = total[best], ids[best], known[best]
                        if no in held:
                            new = tuple(np.concatenate(x) for x in zip(held[no], new))
                            keep = _best(*new, k)
                            new = tuple(x[keep] for x in new)
                        held[no] = new
        for no, (scores, ids, known) in held.items():
            columns = [pa.array(np.full(len(ids), no)), pa.array(np.full(len(ids), part)), pa.array(ids, mask=~known), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["no", "part", "doc_id", "score"])

    return blocks.mapInArrow(run, "no long, part long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    entries: int = ENTRIES, most_docs: int = DOCS, most_postings: int = POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0.

    Terms are the runs of ASCII letters, digits and characters beyond ASCII,
    with A-Z lower-cased; a null or empty text has none, and does not count as
    a document.  Equal scores go by ascending id, documents without an id last.
    Rows that repeat an id or a text are documents, or items, of their own, so
    such an item has k results for each of its rows; items without terms or
    hits have no row.  Texts are read whole, a bounded piece at a time.  Other
    columns are left out.  Without documents or items the result is empty.
    """
    spark = prepare(docs.sparkSession)
    asked, slabs = _slabs(_item_terms(items, item_id, text), entries)
    kind = items.schema[item_id].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("rank int, doc_id long, score long")]))
    for slab in range(slabs):
        own = asked.where(F.col("slab") == slab)
        table = own.select("no", "terms", "times").toArrow().to_pylist()  # at most ``entries`` terms and one item's
        terms: dict[bytes, int] = {}
        matrix = [(r["no"], np.array([terms.setdefault(t, len(terms) + 1) for t in r["terms"]], np.int64), np.array(r["times"], np.int64)) for r in table]
        blocks = _blocks(docs, doc_id, text, terms, most_docs, most_postings)
        counts = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        found = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("e")).groupBy("e.term").agg(F.sum("e.df").alias("df")).toArrow()  # a row a term of the slab
        weights = np.zeros(len(terms) + 1, np.int64)
        for t, df in zip(found["term"].to_pylist(), found["df"].to_pylist()):
            weights[t] = math.floor(WEIGHT * math.log((2 * counts["docs"] + 2) / (2 * df + 1)))
        hits = _products(blocks, matrix, weights, counts["docs"], counts["terms"], k)
        for within in (["no", "part"], ["no"]):
            rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
            hits = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        out = out.unionByName(hits.join(own.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score"))
    return out
