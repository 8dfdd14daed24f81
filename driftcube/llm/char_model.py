"""Interpolated modified Kneser-Ney of order 4 over characters themselves, as sharded tables.

A character is its code point, so no classes bound what is counted: a gram is
(ctx, c), the three characters before packed at 21 bits each, and the one that
follows.  Counts and tables are sharded by gram and context and grow with the
text: each task adds up its own texts first, and counts, continuation counts,
contexts and orders are joins of tables.

Documents fall into ``FOLDS`` by a hash of their id, and fold f is scored by
model f, which is fitted on the trusted documents of the other folds: no
document is scored by a model that has seen it.  All models are rows of the
same tables.

For scoring, the distinct grams of a batch of texts meet the tables.  While
those have at most ``BROADCAST_GRAMS`` rows, counted before, that join is a
broadcast one.  Beyond it texts are packed into chunks, one compressed row
each, whose distinct grams meet the sharded tables in shuffled joins, and each
chunk gets its grams' log-probabilities back in order.  Both give the same
numbers, fixed-point rounding included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftcube.llm.common import BATCH_ROWS, stage, with_columns_mapped

#: Order of the model, bits of a character, characters there are, folds.
ORDER, BITS, ALPHABET, FOLDS = 4, 21, 0x110000, 4
#: Least discount: whatever the counts of counts say, every seen context leaves something to the order below, so no probability is 0.
LEAST_CUT = 0.05
#: What stands before a text, and characters that are turned into arrays at once, of however long texts.
PAD, PIECE = " " * (ORDER - 1), 1_000_000
#: Rows of all tables up to which they are broadcast for scoring; beyond it grams are joined by shuffles.
BROADCAST_GRAMS = 4_000_000
#: Distinct grams that a counting task holds before it passes them on.
HELD_GRAMS = 1_000_000
#: Characters from which on a chunk is closed.
CHUNK = 4_000_000
#: Bits of a gram's number in its chunk, and of a fixed-point log-probability: whole nats below 256 and 24 bits of fraction.
PLACE, FIXED, FRACTION = 26, 32, 24

_PACKED = "chunk long, fold int, blob binary, ctx array<long>, c array<int>"


def fold(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit("fold")), F.lit(FOLDS)).cast("int")


def pieces(texts: list[str], most: int | None = None) -> Iterator[list[tuple[int, str, str]]]:
    """Lists of (number of the text, the three characters before, piece) that hold all of ``texts``, each list of at most ``most`` characters."""
    held, room = [], most or PIECE
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + room]
            held.append((i, (PAD + text[max(0, at - ORDER + 1) : at])[-ORDER + 1 :], part))
            at += len(part)
            room -= len(part)
            if not room:
                yield held
                held, room = [], most or PIECE
    if held:
        yield held


def grams(texts: list[str], before: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the gram at each character, ctx, c of the grams in order of first use); each text stands behind three spaces, or those of ``before``."""
    pads = before or [PAD] * len(texts)
    points = np.frombuffer("".join(p + t for p, t in zip(pads, texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.tile([False, True], len(texts)), np.stack((np.full(len(texts), ORDER - 1), lengths), 1).ravel())
    at = np.flatnonzero(own)
    ctx = (points[at - 3] << 2 * BITS) | (points[at - 2] << BITS) | points[at - 1]
    which, contexts = pd.factorize(ctx)
    number, codes = pd.factorize((which.astype(np.int64) << BITS) | points[at])
    return number, contexts[codes >> BITS], codes & ((1 << BITS) - 1)


def pack(docs: DataFrame, text: str, fold_of: Column) -> DataFrame:
    """Chunks of the rows of ``docs``, with the distinct grams of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        task, made = TaskContext.get().partitionId(), 0

        def close(f: int) -> pa.RecordBatch:
            nonlocal made
            rows = pa.Table.from_batches(held.pop(f)[1]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            _, ctx, c = grams([t or "" for t in rows[text].to_pylist()])
            made += 1
            values = [(task << 16) + made, f, sink.getvalue().to_pybytes(), ctx, c.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types)], schema=arrow)

        for batch in batches:
            folds = batch.column("__fold").to_numpy()
            plain = batch.drop_columns(["__fold"])
            for f in np.unique(folds).tolist():
                part = plain.take(pa.array(np.flatnonzero(folds == f)))
                state = held.setdefault(f, [0, []])
                state[0] += sum(len(t) for t in part[text].to_pylist() if t)
                state[1].append(part)
                if state[0] >= CHUNK:
                    yield close(f)
        for f in list(held):
            yield close(f)

    arrow = to_arrow_schema(T.StructType.fromDDL(_PACKED))
    return stage(docs.withColumn("__fold", fold_of).mapInArrow(run, _PACKED), "chunks")


def counts(docs: DataFrame, text: str, fold_of: Column) -> DataFrame:
    """(model, ctx, c, n) of trusted texts: each model counts the other folds. Null and empty texts have no grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)
        for batch in batches:
            folds, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(0).to_pylist()]
            for group in pieces(texts):
                parts = [held]
                for f in sorted({folds[i] for i, _, _ in group}):
                    own = [(before, piece) for i, before, piece in group if folds[i] == f]
                    number, ctx, c = grams([p for _, p in own], [b for b, _ in own])
                    parts.append(np.stack((np.full(len(c), f), ctx, c, np.bincount(number, minlength=len(c)))))
                held = _added(np.concatenate(parts, axis=1))
                if held.shape[1] > HELD_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["fold", "ctx", "c", "n"])
                    held = held[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["fold", "ctx", "c", "n"])

    rows = docs.select(F.col(text).cast("string"), fold_of.alias("fold")).mapInArrow(run, "fold long, ctx long, c long, n long")
    rows = stage(rows.groupBy("fold", "ctx", "c").agg(F.sum("n").alias("n")), "fold-counts")
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda m: m != F.col("fold")))
    rows = rows.select(models.alias("model"), "ctx", F.col("c").cast("int").alias("c"), "n")
    return stage(rows.groupBy("model", "ctx", "c").agg(F.sum("n").alias("n")), "counts")


def _added(rows: np.ndarray) -> np.ndarray:
    """Columns (fold, ctx, c, n) with the counts of equal grams added up."""
    rows = rows[:, np.lexsort(rows[:3])]
    if not rows.shape[1]:
        return rows
    first = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    return np.concatenate((rows[:3, first], np.add.reduceat(rows[3:], first, axis=1)))


def _discounts(level: DataFrame) -> Column:
    """Each row's modified Kneser-Ney discount, from its model's numbers of grams seen 1 to 4 times."""
    found = {r["model"]: r for r in level.groupBy("model").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).collect()}  # a row a model
    out = []
    for m in range(FOLDS):
        n = [found[m][f"n{i}"] if m in found else 0 for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out.append(F.array(*(F.lit(float(min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, LEAST_CUT), i))) for i in (1, 2, 3))))
    return F.element_at(F.element_at(F.array(*out), F.col("model") + 1), F.least("n", F.lit(3)).cast("int"))


def _short(ctx: Column, order: int) -> Column:
    """The context of that order: the last order - 1 characters."""
    return ctx.bitwiseAND((1 << BITS * (order - 1)) - 1)


def tables(counted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (model, ctx, c, p) of the grams seen and (model, ctx, gamma) of their contexts.

    The highest order has counts, lower ones continuation counts: of how many
    different characters they were seen behind.
    """
    levels = [counted]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[0].groupBy("model", _short(F.col("ctx"), k).alias("ctx"), "c").agg(F.count("*").alias("n"))
        levels.insert(0, stage(shorter, f"level{k}"))
    out, below = [], None
    for k, level in enumerate(levels, 1):
        level = level.withColumn("cut", _discounts(level))
        sums = level.groupBy("model", "ctx").agg(F.sum("n").alias("all"), F.sum("cut").alias("free"))
        contexts = stage(sums.select("model", "ctx", "all", (F.col("free") / F.col("all")).alias("gamma")), f"contexts{k}")
        joined = level.join(contexts, ["model", "ctx"])
        lower: Column = F.lit(1.0 / ALPHABET)
        if below is not None:
            joined = joined.withColumn("suffix", _short(F.col("ctx"), k - 1))
            joined = joined.join(below.select("model", F.col("ctx").alias("suffix"), "c", F.col("p").alias("lower")), ["model", "suffix", "c"])
            lower = F.col("lower")
        p = (F.col("n") - F.col("cut")) / F.col("all") + F.col("gamma") * lower
        below = stage(joined.select("model", "ctx", "c", p.alias("p")), f"p{k}")
        out.append((below, contexts.select("model", "ctx", "gamma")))
    return out


def looked_up(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(model, ctx, c, cost) of distinct ``asked`` (model, ctx, c), the negative log-probability in fixed point; what was not seen backs off to its suffix."""
    p: Column = F.lit(1.0 / ALPHABET)
    for k, (seen, contexts) in enumerate(model, 1):
        asked = asked.withColumn(f"ctx{k}", _short(F.col("ctx"), k))
        asked = asked.join(seen.select("model", F.col("ctx").alias(f"ctx{k}"), "c", F.col("p").alias(f"p{k}")), ["model", f"ctx{k}", "c"], "left")
        asked = asked.join(contexts.select("model", F.col("ctx").alias(f"ctx{k}"), F.col("gamma").alias(f"gamma{k}")), ["model", f"ctx{k}"], "left")
        p = F.coalesce(f"p{k}", F.coalesce(f"gamma{k}", F.lit(1.0)) * p)
    return asked.select("model", "ctx", "c", F.round(-F.log(p) * float(1 << FRACTION)).cast("long").alias("cost"))


def with_surprise(docs: DataFrame, text: str, doc_id: str, model: list[tuple[DataFrame, DataFrame]], most: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` with ``surprise`` (mean negative log-probability a character, null for a null or empty text) and ``length``.

    A document's fold is that of its ``doc_id``; of a null id, that of null.
    ``most`` bounds the rows of the tables that are broadcast.
    """
    docs = docs.drop("surprise", "length", "__fold")
    if sum(seen.count() + contexts.count() for seen, contexts in model) > most:
        return _by_chunks(pack(docs, text, fold(doc_id)), docs.schema, text, model)
    sent = docs.sparkSession.sparkContext.broadcast([_arrays(seen.toArrow(), contexts.toArrow()) for seen, contexts in model])  # at most ``most`` rows

    def rows():
        def batch(structs):
            texts, folds = [r["text"] or "" for r in structs], np.array([r["fold"] for r in structs], np.int64)
            lengths, sums = np.array([len(t) for t in texts], np.int64), np.zeros(len(texts))
            for group in pieces(texts):
                number, ctx, c = grams([p for _, _, p in group], [b for _, b, _ in group])
                of = np.repeat([i for i, _, _ in group], [len(p) for _, _, p in group])
                sums += np.bincount(of, _costs(sent.value, ctx, c)[folds[of], number], len(texts))
            return _means(sums, lengths), lengths

        return batch

    fields = [T.StructField("surprise", T.DoubleType()), T.StructField("length", T.LongType())]
    asked = docs.withColumn("__asked", F.struct(F.col(text).cast("string").alias("text"), fold(doc_id).alias("fold")))
    return with_columns_mapped(asked, fields, rows, "__asked", drop=["__asked"])


def _means(sums: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Sums by lengths; null for an empty text."""
    return pa.array(sums / np.maximum(lengths, 1), pa.float64(), mask=lengths == 0)


def _arrays(seen: pa.Table, contexts: pa.Table) -> tuple[np.ndarray, ...]:
    """One order's tables as sorted arrays: contexts and their gammas by model; grams, as (place of the context, c), and their probabilities by model."""
    ctx, places = np.unique(contexts["ctx"].to_numpy(), return_inverse=True)
    gammas = np.ones((FOLDS, len(ctx)))
    gammas[contexts["model"].to_numpy(), places] = contexts["gamma"].to_numpy()
    code = (np.searchsorted(ctx, seen["ctx"].to_numpy()) << BITS) | seen["c"].to_numpy().astype(np.int64)
    code, places = np.unique(code, return_inverse=True)
    p = np.full((FOLDS, len(code)), np.nan)
    p[seen["model"].to_numpy(), places] = seen["p"].to_numpy()
    return ctx, gammas, code, p


def _costs(orders: list[tuple[np.ndarray, ...]], ctx: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cost of each gram by model, as of :func:`looked_up`."""
    p = np.full((FOLDS, len(c)), 1.0 / ALPHABET)
    for k, (contexts, gammas, codes, known) in enumerate(orders, 1):
        if not len(codes):
            continue
        short = ctx & ((1 << BITS * (k - 1)) - 1)
        place = np.minimum(np.searchsorted(contexts, short), len(contexts) - 1)
        there = contexts[place] == short
        code = (place << BITS) | c
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        seen = np.where(there & (codes[at] == code), known[:, at], np.nan)
        p = np.where(np.isnan(seen), np.where(there, gammas[:, place], 1.0) * p, seen)
    return np.round(-np.log(p) * float(1 << FRACTION)) / float(1 << FRACTION)


def _by_chunks(chunks: DataFrame, schema: T.StructType, text: str, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The rows packed into ``chunks`` with ``surprise`` and ``length``."""
    grams_of = chunks.select("chunk", "fold", F.posexplode(F.arrays_zip("ctx", "c")).alias("i", "g"))
    place = F.shiftleft("chunk", PLACE).bitwiseOR(F.col("i").cast("long")).alias("place")
    asked = grams_of.select(place, F.col("g.ctx").alias("ctx"), (F.shiftleft(F.col("fold").cast("long"), BITS) + F.col("g.c")).alias("end"))  # three longs a row
    distinct = asked.select("ctx", "end").distinct()
    distinct = distinct.select(F.shiftright("end", BITS).cast("int").alias("model"), "ctx", F.col("end").bitwiseAND((1 << BITS) - 1).cast("int").alias("c"))
    known = looked_up(distinct, model).select("ctx", (F.shiftleft(F.col("model").cast("long"), BITS) + F.col("c")).alias("end"), "cost")
    number = F.shiftleft(F.col("place").bitwiseAND((1 << PLACE) - 1), FIXED).bitwiseOR(F.col("cost"))
    found = asked.join(known, ["ctx", "end"]).select(F.shiftright("place", PLACE).alias("chunk"), number.alias("number"))
    found = found.groupBy("chunk").agg(F.sort_array(F.collect_list("number")).alias("costs"))
    joined = chunks.select("chunk", "blob").join(found, "chunk", "left").select("blob", "costs")
    out = T.StructType([*schema, T.StructField("surprise", T.DoubleType()), T.StructField("length", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.ipc.open_stream(batch.column(0)[i].as_buffer()).read_all()
                texts = [t or "" for t in table[text].to_pylist()]
                lengths = np.array([len(t) for t in texts], np.int64)
                costs = batch.column(1)[i].values
                known = (costs.to_numpy() & ((1 << FIXED) - 1)) / float(1 << FRACTION) if costs is not None else np.empty(0)
                sums = np.bincount(np.repeat(np.arange(len(texts)), lengths), known[grams(texts)[0]], len(texts)) if lengths.any() else np.zeros(len(texts))
                made = table.append_column("surprise", _means(sums, lengths)).append_column("length", pa.array(lengths)).cast(arrow)
                yield from made.combine_chunks().to_batches(max_chunksize=BATCH_ROWS)

    return joined.mapInArrow(run, out)
