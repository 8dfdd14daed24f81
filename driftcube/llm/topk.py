"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks.  Scores are integers;
histograms of them, with bins that narrow from pass to pass, locate each
query's k-th highest score: a bin is found from the top, then refined, until
bins are one score wide.  A last pass keeps the scores above it, and of those
that tie with it the smallest ids.

Candidates are packed into chunks and queries into blocks, a row each.  Chunks
are dealt to groups of bounded size and every block goes to every group, so a
pass is one join over (block, chunk), whose rows are scored as they stream by;
the number of jobs does not depend on the number of queries, and nothing
reaches the driver but counts of chunks.  A task sends only the bins that hold
the k highest of its own scores: the k-th of all scores is never below that, so
no lower bin matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.llm.common import prepare, stage

#: Production parameters: results of a query, scale of components, queries of a block, candidates of a chunk, bits of a bin's width by pass.
K, SCALE, BLOCK, CHUNK, SHIFTS = 5, 256, 1024, 2048, (16, 8, 0)
#: Chunks that the groups have at most on average: what a task of the join holds while blocks stream by.
GROUP = 16
#: Blocks for which a task holds histograms before it sends them.
HELD = 64
_EXACT, _MOST = 2**53, 2**63
#: Bits of a row's place in the number of its row: the chunk's number stands above them.
PLACE = 20


def _vectors(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether asked for, integer matrix) for each vector length in a batch of (vec_id, embedding, asked) that takes part."""
    ids, lists, asked = batch.column(0), batch.column(1), batch.column(2)
    rows = np.flatnonzero(pc.is_valid(ids).to_numpy(zero_copy_only=False) & pc.is_valid(lists).to_numpy(zero_copy_only=False))
    if not len(rows):
        return []
    ids, lists, asked = (x.take(pa.array(rows)) for x in (ids, lists, asked))
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    ids, asked, out = ids.to_numpy(zero_copy_only=False).astype(np.int64), asked.to_numpy(zero_copy_only=False).astype(bool), []
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        matrix = values[starts[own][:, None] + np.arange(length)[None, :]]
        finite = np.isfinite(matrix).all(axis=1)
        out.append((ids[own][finite], asked[own][finite], np.floor(SCALE * matrix[finite])))
    return [x for x in out if len(x[0])]


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while those are exact, else in Python's integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if most < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    scores = whole(queries) @ whole(candidates).T
    if scores.size and np.abs(scores).max() >= _MOST:
        raise OverflowError("an inner product does not fit a long")
    return scores.astype(np.int64)


_NONE = -_MOST


def _highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th highest score, or the lowest possible if it has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), _NONE)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _add(held: tuple | None, rows: np.ndarray, bins: np.ndarray, need: np.ndarray) -> tuple:
    """Histogram (query row, bin, count) with further scores added, cut below the bin that holds each row's need-th."""
    weight = np.ones(len(rows), np.int64)
    if held is not None:
        rows, bins, weight = np.concatenate((held[0], rows)), np.concatenate((held[1], bins)), np.concatenate((held[2], weight))
    order = np.lexsort((-bins, rows))
    rows, bins, weight = rows[order], bins[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1]))))
    if not len(rows):
        return rows, bins, weight
    rows, bins, weight = rows[first], bins[first], np.add.reduceat(weight, first)
    run = np.cumsum(weight)
    begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    base = np.repeat(run[begin] - weight[begin], np.diff(np.concatenate((begin, [len(rows)]))))
    keep = run - weight - base < need[rows]
    return rows[keep], bins[keep], weight[keep]


def _packed(rows: DataFrame, most: int, kinds: tuple, arrays_of, name: str) -> DataFrame:
    """(no, length, and a binary column each of ``kinds``) of the arrays that ``arrays_of`` finds in a batch, the last of them a matrix: at most ``most`` of its rows, of one length, a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def closed(length: int, keep: int) -> Iterator[pa.RecordBatch]:
            arrays = [np.concatenate(x) for x in zip(*held[length])]
            while len(arrays[-1]) > keep:
                columns = [pa.array([x[:most].tobytes()], pa.binary()) for x in arrays]
                arrays = [x[most:] for x in arrays]
                yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), *columns], names=["length", *kinds])
            held[length] = [tuple(arrays)]

        for batch in batches:
            for arrays in arrays_of(batch):
                length = arrays[-1].shape[1]
                held.setdefault(length, []).append(arrays)
                if sum(len(x[-1]) for x in held[length]) >= most:
                    yield from closed(length, most - 1)
        for length in list(held):
            yield from closed(length, 0)

    made = rows.mapInArrow(run, "length int, " + ", ".join(f"{k} binary" for k in kinds))
    return stage(made.withColumn("no", F.monotonically_increasing_id()), name)


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(row numbers, ids, matrix) of what is asked for in chunks."""
    for r in range(batch.num_rows):
        read = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
        at = np.flatnonzero(read("asked", bool))
        if len(at):
            ids = read("ids", np.int64)
            matrix = read("matrix", np.float64).reshape(len(ids), batch.column("length")[r].as_py())
            yield (batch.column("no")[r].as_py() << PLACE) + at, ids[at], matrix[at]


_STATE = "array<struct<q:int,need:long,low:long,high:long>>"


def _pairs(rows: pa.RecordBatch, k: int) -> Iterator[tuple]:
    """(block, query ids, need, low, high, candidate ids, scores) of each row of the join; a query's own row scores _NONE."""
    for r in range(rows.num_rows):
        block, length, state = (rows.column(c)[r].as_py() for c in ("block", "length", "state"))
        read = lambda name, kind: np.frombuffer(rows.column(name)[r].as_buffer(), kind)  # noqa: B023, E731
        names, ids = read("query_ids", np.int64), read("ids", np.int64)
        queries, matrix = (read(c, np.float64).reshape(n, length) for c, n in (("query_matrix", len(names)), ("matrix", len(ids))))
        need, low, high = np.full(len(names), k), np.full(len(names), _NONE), np.full(len(names), _MOST - 1)  # the k-th score lies in [low, high]
        if state:
            q = [x["q"] for x in state]
            need[q], low[q], high[q] = ([x[c] for x in state] for c in ("need", "low", "high"))
        scores = _scores(queries, matrix)
        at = read("query_rows", np.int64) - (rows.column("no")[r].as_py() << PLACE)  # the place of a query's own row, if it is in this chunk
        inside = np.flatnonzero((at >= 0) & (at < len(ids)))
        scores[inside, at[inside]] = _NONE
        yield block, names, need, low, high, ids, scores


def top_k(vectors: DataFrame, asked: Column | str, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products over ``vectors`` of each of its rows that meets the condition ``asked``.

    Components become floor(256 * x).  Candidates are all rows but the query's
    own; ties go to the smaller id, and a query with fewer candidates gets all.  Rows that are null, have a null id, or hold a null or
    non-finite component take no part, neither as queries nor as candidates;
    only vectors of equal length are scored.  Rows that repeat an id are
    queries and candidates of their own and each other's candidates, so such a
    query has k results for each of its rows.  A score that does not fit a long is an error.  Other columns
    are left out; without queries or candidates the result is empty.
    """
    spark = prepare(vectors.sparkSession)
    asked = F.expr(asked) if isinstance(asked, str) else asked
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    chunks = _packed(rows, chunk, ("ids", "asked", "matrix"), _vectors, "chunks")  # with their numbers, by which a row is told from others of its id
    blocks = _packed(chunks, block, ("rows", "ids", "matrix"), _asked, "blocks")
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-chunks.count() // GROUP))
    chunks = chunks.select("length", "no", "ids", "matrix", F.pmod("no", F.lit(groups)).cast("int").alias("g"))
    blocks = blocks.select(F.col("no").alias("block"), "length", F.col("rows").alias("query_rows"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))

    def joined(state: DataFrame | None) -> DataFrame:
        asked = blocks.withColumn("state", F.lit(None).cast(_STATE)) if state is None else blocks.join(state, "block", "left")
        asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return asked.join(chunks, ["length", "g"])  # blocks stream by, a group's chunks are held

    state = None
    for shift in SHIFTS:

        def histogram(batches: Iterator[pa.RecordBatch], shift=shift) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}

            def sent() -> Iterator[pa.RecordBatch]:
                for number, (need, found) in held.items():
                    q, bins, n = found
                    columns = [np.full(len(q), number), q, need[q], bins, n]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["block", "q", "need", "bin", "n"])
                held.clear()

            for batch in batches:
                for number, _, need, low, high, _, scores in _pairs(batch, k):
                    inside = (scores >= low[:, None]) & (scores <= high[:, None]) & (scores != _NONE)
                    inside &= scores >= _highest(np.where(inside, scores, _NONE), k)[:, None]
                    r, c = np.nonzero(inside)
                    held[number] = need, _add(held[number][1] if number in held else None, r, scores[r, c] >> shift, need)
                    if len(held) > HELD:
                        yield from sent()
            yield from sent()

        counts = joined(state).mapInArrow(histogram, "block long, q long, need long, bin long, n long").groupBy("block", "q", "need", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy("block", "q").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        located = counts.withColumn("above", above).where("above < need and above + n >= need")
        low = F.shiftleft("bin", shift)
        entry = F.struct(F.col("q").cast("int").alias("q"), (F.col("need") - F.col("above")).alias("need"), low.alias("low"), (low + ((1 << shift) - 1)).alias("high"))
        state = stage(located.groupBy("block").agg(F.collect_list(entry).alias("state")), "located")  # an entry a query of the block; none where all candidates are results

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, names, _, low, _, ids, scores in _pairs(batch, k):
                r, c = np.nonzero((scores > low[:, None]) & (scores != _NONE))
                ties, at = np.nonzero((scores == low[:, None]) & (scores != _NONE))
                order = np.lexsort((ids[at], ties))
                ties, at = ties[order], at[order]
                nearest = np.arange(len(ties)) - np.searchsorted(ties, ties) < k  # of each query the k smallest ids
                r, c = np.concatenate((r, ties[nearest])), np.concatenate((c, at[nearest]))
                columns = [np.full(len(r), number), r, names[r], ids[c], scores[r, c]]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["block", "q", "query_id", "vec_id", "score"])

    hits = joined(state).mapInArrow(select, "block long, q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "q").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
