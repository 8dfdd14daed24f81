"""Connected components by alternating large and small stars, as joins over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcube.storage import release, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b of one type with an order); root is the smallest node reachable.

    Loops, repeated and reversed edges do no harm; no edges give no rows.  A
    node's neighbours are only ever reduced to their minimum, never collected;
    a node with very many neighbours is a skewed join key, which adaptive
    execution splits.  Each round's edges are a table in the shared folder.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        earlier, current = current, stage(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(earlier)
        before, mark = mark, _mark(current)
        if before == mark:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and digest of a set of edges, to see that a round has changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first())
