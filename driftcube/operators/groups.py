"""Disjoint groups of descendants, counted and the best of them found by a recursive query in the JVM.

The search over a component tells the best group of a segment and how many
there are without listing them.  Here they are listed: a recursive common table
expression adds one descendant at a time, in the order of ids, to the groups
whose atoms it does not share.  That is exponential in the descendants, so it
is for as many as ``max_hierarchy_descendants`` allows, and holds the search to
its word.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcube.operators import coverage as cov
from driftcube.storage import stage

#: Rows that one recursion may have; more are an error of Spark's, never a result cut short.
MOST_ROWS = 10_000_000


def disjoint_groups(eligible: DataFrame, scores: DataFrame, max_descendants: int = 25, most_rows: int = MOST_ROWS) -> DataFrame:
    """(segment_id, descendant_count, group_count, group_score, group_ids), a row each segment that has eligible descendants.

    ``eligible`` is the coverage of the segments that take part (segment_id,
    segment_key, slice_depth, atom_id), ``scores`` has their (segment_id,
    anomaly_score).  Of groups of one score the smallest counts, then that of
    the lowest ids, which stand ascending.  More descendants than
    ``max_descendants`` are an error, as is a recursion beyond ``most_rows``.
    """
    spark = eligible.sparkSession
    atoms = eligible.groupBy("segment_id").agg(F.sort_array(F.collect_set("atom_id")).alias("atoms"))
    below = cov.descendants(eligible).select("segment_id", F.col("child_id"))
    child = atoms.join(scores.select("segment_id", "anomaly_score"), "segment_id").select(F.col("segment_id").alias("child_id"), "atoms", F.col("anomaly_score").alias("score"))
    below = stage(below.join(child, "child_id"), "descendants")
    sizes = below.groupBy("segment_id").agg(F.count("*").alias("descendant_count"))
    if large := sizes.where(F.col("descendant_count") > max_descendants).first():
        raise ValueError(f"segment {large['segment_id']}: {large['descendant_count']} eligible descendants exceed max_hierarchy_descendants={max_descendants}")
    name = f"descendants_{uuid.uuid4().hex}"
    below.createOrReplaceTempView(name)
    # a level adds one member, so there are no more levels than descendants
    found = spark.sql(f"""
        WITH RECURSIVE grown(segment_id, last_id, ids, atoms, score) MAX RECURSION LEVEL {max_descendants + 1} AS (
            SELECT segment_id, child_id, array(child_id), atoms, score FROM {name}
            UNION ALL
            SELECT g.segment_id, d.child_id, array_append(g.ids, d.child_id), concat(g.atoms, d.atoms), g.score + d.score
            FROM grown g JOIN {name} d ON d.segment_id = g.segment_id AND d.child_id > g.last_id AND NOT arrays_overlap(g.atoms, d.atoms))
        SELECT segment_id, count(*) AS group_count, min_by(struct(score, ids), struct(-score, size(ids), ids)) AS best FROM grown GROUP BY segment_id""")
    earlier = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", str(most_rows))
    try:
        found = stage(found, "groups")
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", earlier)
        spark.catalog.dropTempView(name)
    return sizes.join(found, "segment_id").select("segment_id", "descendant_count", "group_count", F.col("best.score").alias("group_score"), F.col("best.ids").alias("group_ids"))
