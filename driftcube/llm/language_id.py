"""Language of a document as a mixture: proportions by expectation-maximisation, the set of languages by penalised likelihood.

A text is a bag of trigrams of letters, with a space for all that is no letter.
Each language gives a trigram the probability

    (1 - SHARED) * n(gram, language) / n(language) + SHARED * mean of these shares over the languages,

so what one language has never seen is rare in it, but never impossible.  The
counts are a sharded table of all trigrams of all training texts, and grow with
them.  A document's trigrams are draws from a mixture of the languages; EM
gives the proportions.  The sets of the 1, 2, ... languages of highest
proportion are fitted each, and the one of highest likelihood, less a penalty
for each further language, is chosen.  The prediction is the language of
highest proportion in that set, its score the proportion.

While the table of probabilities has at most ``CELLS`` of them, counted before,
it is broadcast.  Beyond it documents go into compressed chunks whose distinct
trigrams meet the table in a shuffled join; both ways infer alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftcube.llm.char_model import pieces
from driftcube.llm.common import BATCH_ROWS, prepare, stage, with_columns_mapped

#: Share of the mean over the languages in each language's probabilities, rounds of EM, the change at which a document's proportions stand.
SHARED, ROUNDS, STILL = 0.05, 40, 1e-4
#: Price of a further language: so many times the logarithm of the number of trigrams.
PENALTY = 3.0
#: Name of what has no letters; languages there may be at most, as each costs a probability for every trigram (more are an error).
UNDETERMINED, MOST_LANGUAGES = "und", 256
#: Probabilities (trigrams times languages) up to which the table is broadcast.
CELLS = 4_000_000
#: Distinct trigrams that a counting task holds, rows of documents and trigrams that are merged at once, probabilities that EM holds.
HELD, MERGED, FITTED = 500_000, 2_000_000, 4_000_000
#: Characters from which on a chunk is closed.
CHUNK = 4_000_000

_BITS, _SPACE = 21, 32
_FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.StringType())]


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-cased letter or a space, and whether it is a letter; marks stay, as parts of words."""
    plain, letter = np.full(0x110000, _SPACE, np.int64), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            plain[c], letter[c] = ord(x.lower()[0]), True
        elif c > 127 and unicodedata.category(x)[0] == "M":
            plain[c] = c
    return plain, letter


def trigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, trigram, count), a bounded piece of ``texts`` at a time: trigrams with a letter in the middle."""
    plain, letter = _alphabet()
    for group in pieces([t + " " for t in texts]):
        points = np.frombuffer("".join(before + part for _, before, part in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([(3, len(part)) for _, _, part in group])
        own = np.repeat(np.tile([False, True], len(group)), lengths.ravel())
        at = np.flatnonzero(own)
        at = at[letter[points[at - 1]]]
        of = np.repeat([i for i, _, _ in group], lengths[:, 1])[np.cumsum(own)[at] - 1]
        signs = plain[points]
        number, codes = pd.factorize((signs[at - 2] << 2 * _BITS) | (signs[at - 1] << _BITS) | signs[at])
        low = of.min(initial=len(texts))
        pairs = (of - low) * max(1, len(codes)) + number
        n = np.bincount(pairs) if len(pairs) and pairs.max() < MERGED * 4 else None
        kept, n = (np.flatnonzero(n), n[np.flatnonzero(n)]) if n is not None else np.unique(pairs, return_counts=True)
        yield low + kept // max(1, len(codes)), codes[kept % max(1, len(codes))], n


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """The parts as one, with the counts of equal (text, trigram) added up."""
    if len(parts) < 2:
        return parts
    of, gram, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, of))
    of, gram, n = of[order], gram[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (gram[1:] != gram[:-1]))))
    return [(of[first], gram[first], np.add.reduceat(n, first))] if len(of) else []


@dataclass
class Model:
    """``table``: (gram, langs, shares), a language's place and the gram's share in it; the rest by language, in order of names."""

    table: DataFrame
    languages: list[str]
    usual: int
    rows: int


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) of all texts that have a language; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                for _, gram, n in _merged(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(names)):
                for _, gram, n in trigrams([texts[i] for i in np.flatnonzero(names == name)]):
                    code, first = pd.factorize(gram)
                    part = np.zeros(len(first), np.int64), first, np.bincount(code, n, len(first)).astype(np.int64)
                    before = sum(len(p[1]) for p in held.get(name, []))
                    held[name] = _merged([*held.get(name, []), part])
                    size += sum(len(p[1]) for p in held[name]) - before
                    if size > HELD:
                        yield from sent()
                        size = 0
        yield from sent()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with a language; null and empty texts and rows without a language teach nothing."""
    prepare(docs.sparkSession)
    counted = stage(counts(docs, text, lang), "trigrams")
    totals = stage(counted.groupBy("lang").agg(F.sum("n").alias("all")), "languages")
    if (found := totals.count()) > MOST_LANGUAGES:
        raise ValueError(f"{found} languages; at most {MOST_LANGUAGES} are told apart")
    known = sorted(totals.collect(), key=lambda r: r["lang"])  # at most MOST_LANGUAGES rows
    places = docs.sparkSession.createDataFrame([(r["lang"], i, r["all"]) for i, r in enumerate(known)], "lang string, place int, all long")
    rows = counted.join(F.broadcast(places), "lang").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("place", (F.col("n") / F.col("all")).alias("share")))).alias("x"))
    table = stage(rows.select("gram", F.col("x.place").alias("langs"), F.col("x.share").alias("shares")), "probabilities")
    usual = max(range(len(known)), key=lambda i: (known[i]["all"], -i), default=-1)
    return Model(table, [r["lang"] for r in known], usual, table.count())


def _dense(rows: pa.Table, languages: int) -> np.ndarray:
    """Probabilities (trigrams, languages) of (langs, shares)."""
    sizes = rows["langs"].combine_chunks().value_lengths().to_numpy()
    out = np.zeros((rows.num_rows, languages))
    out[np.repeat(np.arange(rows.num_rows), sizes), rows["langs"].combine_chunks().flatten().to_numpy()] = rows["shares"].combine_chunks().flatten().to_numpy()
    return (1 - SHARED) * out + SHARED * out.sum(axis=1, keepdims=True) / max(1, languages)


def _fitted(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) by document after EM from ``share``; rows of documents begin at ``starts``. A document that stands is left alone."""
    sizes = np.diff(np.append(starts, len(n)))
    all_of = np.add.reduceat(n, starts)
    share, moving = share.copy(), np.arange(len(starts))
    q, m, s, z = p, n, starts, sizes
    for _ in range(ROUNDS):
        weight = q * np.repeat(share[moving], z, axis=0)
        weight *= (m / weight.sum(axis=1))[:, None]
        new = np.add.reduceat(weight, s, axis=0) / all_of[moving, None]
        still = np.abs(new - share[moving]).max(axis=1) < STILL
        share[moving] = new
        if still.any():
            rows = np.repeat(~still, z)
            moving, q, m, z = moving[~still], q[rows], m[rows], z[~still]
            if not len(moving):
                break
            s = np.concatenate(([0], np.cumsum(z)[:-1]))
    mixed = (p * np.repeat(share, sizes, axis=0)).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mixed), starts)


def proportions(p: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each document's proportions over the set of languages of highest penalised likelihood; 0 outside it.

    ``p`` holds the probabilities (rows, languages) of the documents' trigrams,
    ``n`` how often they occur, ``starts`` where a document's rows begin.
    """
    languages = p.shape[1]
    full, most = _fitted(p, n, starts, np.full((len(starts), languages), 1.0 / languages))
    price = PENALTY * np.log(1.0 + np.add.reduceat(n, starts))
    order = np.argsort(-full, axis=1, kind="stable")
    sizes = np.diff(np.append(starts, len(n)))
    best = np.zeros_like(full)
    best[np.arange(len(starts)), order[:, 0]] = 1.0
    value = np.add.reduceat(n * np.log((p * np.repeat(best, sizes, axis=0)).sum(axis=1)), starts)
    for k in range(2, languages + 1):
        open_ = np.flatnonzero(most - price * (k - 1) > value)  # no set of k languages is likelier than all of them
        if not len(open_):
            break
        rows = np.isin(np.repeat(np.arange(len(starts)), sizes), open_)
        start = np.zeros((len(open_), languages))
        np.put_along_axis(start, order[open_, :k], np.maximum(np.take_along_axis(full[open_], order[open_, :k], axis=1), 1e-6), axis=1)
        start /= start.sum(axis=1, keepdims=True)
        share, found = _fitted(p[rows], n[rows], np.concatenate(([0], np.cumsum(sizes[open_])[:-1])), start)
        found -= price[open_] * (k - 1)
        better = found > value[open_]
        best[open_[better]], value[open_[better]] = share[better], found[better]
    return best


def _inferred(texts: list[str], grams: np.ndarray, p: np.ndarray, languages: list[str], usual: int) -> tuple[list, list, list]:
    """(lang_pred, score, proportions) of texts by the probabilities ``p`` of the sorted ``grams``."""
    has, parts = np.zeros(len(texts), bool), []
    for of, gram, n in trigrams(texts):
        has[of] = True
        at = np.minimum(np.searchsorted(grams, gram), max(0, len(grams) - 1))
        known = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
        parts.append((of[known], at[known], n[known]))
        if sum(len(x[0]) for x in parts) > MERGED:
            parts = _merged(parts)
    share = np.zeros((len(texts), len(languages)))
    for of, at, n in _merged(parts):
        order = np.argsort(of, kind="stable")
        of, at, n = of[order], at[order], n[order].astype(np.float64)
        docs, starts = np.unique(of, return_index=True)
        ends, first = np.append(starts[1:], len(of)), 0
        while first < len(docs):  # as many documents as EM may hold, one at least
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + FITTED // len(languages), "right")))
            rows = slice(starts[first], ends[last - 1])
            share[docs[first:last]] = proportions(p[at[rows]], n[rows], starts[first:last] - starts[first])
            first = last
    names, scores, listed = [], [], []
    for i in range(len(texts)):
        if not has[i] or not languages:
            names.append(UNDETERMINED), scores.append(0.0), listed.append("")
        elif not share[i].any():
            names.append(languages[usual]), scores.append(1.0 / len(languages)), listed.append("")
        else:
            top = int(share[i].argmax())
            found = [(round(float(share[i, j]), 6), languages[j]) for j in np.flatnonzero(share[i] > 0)]
            names.append(languages[top]), scores.append(min(1.0, round(float(share[i, top]), 6)))
            listed.append(",".join(f"{x}:{s:.6f}" for s, x in sorted(found, key=lambda y: (-y[0], y[1]))))
    return names, scores, listed


def identify(docs: DataFrame, model: Model, text: str = "text", cells: int = CELLS) -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` (0 to 1) and ``proportions`` ("lang:share", the largest first); columns so named are replaced.

    A null text and one without letters is ``und`` with score 0, and so is
    every text if nothing was learned.  A text with letters, but none of the
    trigrams learned, gets the language of most training text, its score what
    chance gives.  Equal proportions go to the smaller name.  Repeated rows and
    rows without an id are judged each; an empty table gives an empty one.
    Texts are read whole, a bounded piece at a time.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.withColumn(text, F.col(text).cast("string"))
    languages, usual = model.languages, model.usual
    if model.rows * len(languages) > cells:
        return _by_chunks(spark, docs, model, text)
    table = model.table.toArrow().sort_by("gram")  # at most ``cells`` probabilities
    sent = spark.sparkContext.broadcast((table["gram"].to_numpy(), _dense(table, len(languages))))
    return with_columns_mapped(docs, _FIELDS, lambda: lambda texts: _inferred([t or "" for t in texts], *sent.value, languages, usual), text, drop=[text])


def _by_chunks(spark: SparkSession, docs: DataFrame, model: Model, text: str) -> DataFrame:
    """:func:`identify` by a shuffled join of the chunks' distinct trigrams and the table."""
    names = {f.name for f in _FIELDS}
    kept = [c for c in docs.columns if c not in {*names, text}]
    rows_of = docs.select(text, *kept)
    languages, usual = model.languages, model.usual

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, no = [], 0, TaskContext.get().partitionId() << 32

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            found = np.empty(0, np.int64)
            for _, gram, _ in trigrams([t or "" for t in table[text].to_pylist()]):
                found = np.union1d(found, gram)
            columns = [pa.array([no]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([found], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "blob", "grams"])

        for batch in batches:
            held.append(batch)
            size += sum(len(t) for t in batch.column(text).to_pylist() if t)
            if size >= CHUNK:
                yield closed()
                held, size, no = [], 0, no + 1
        if held:
            yield closed()

    chunks = stage(rows_of.mapInArrow(pack, "chunk long, blob binary, grams array<long>"), "chunks")
    found = chunks.select("chunk", F.explode("grams").alias("gram")).join(model.table, "gram")
    found = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("gram", "langs", "shares"))).alias("x"))  # the distinct trigrams of one chunk
    joined = chunks.select("chunk", "blob").join(found, "chunk", "left").select("blob", "x.gram", "x.langs", "x.shares")
    out = T.StructType([*(docs.schema[c] for c in kept), *_FIELDS])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                table = pa.ipc.open_stream(batch.column(0)[r].as_buffer()).read_all()
                grams, p = np.empty(0, np.int64), np.empty((0, len(languages)))
                if batch.column(1)[r].is_valid:
                    grams = batch.column(1)[r].values.to_numpy()
                    p = _dense(pa.table({"langs": batch.column(2)[r].values, "shares": batch.column(3)[r].values}), len(languages))
                for part in table.to_batches(max_chunksize=BATCH_ROWS):
                    made = _inferred([t or "" for t in part.column(0).to_pylist()], grams, p, languages, usual)
                    columns = [*(part.column(c) for c in kept), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(kept) :]))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return joined.mapInArrow(run, out)
