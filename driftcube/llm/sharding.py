"""Sharding by balanced label propagation.

Links are equal texts only, those of one text with each other: there is no
other edge table.  So a text's documents are one clique and a label travels one
step; further rounds move what found no room before, as long as links are won.  Labels are shards; in each round documents
move towards the shard that most of their neighbours are in, as far as that
shard's quota has room, so few links are cut while the numbers of rows stay
even.  Linked documents of one text and shard are alike, so a round works on
cells (text, shard, number of rows) by joins and aggregates, never on pairs.
Documents without a link, and what finds no room, fill the quotas up, so the
counts of any two shards differ by at most one: the law ``rows``.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcube.llm.common import stage, text_of, with_running_sum

#: Production parameters.
SHARDS, ROUNDS, SEED = 40, 8, 7
#: Least number of ranges of a hash, into which the rows of one text or shard are dealt to be numbered; there are eight a shuffle partition.
RANGES = 256
#: What a row is dealt by.
_OWN = ("doc_id", "size", "crc", "salt")


def _range(*columns: str) -> Column:
    partitions = int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*columns, F.lit("range")), F.lit(max(RANGES, 8 * partitions))).cast("int")


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int") + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Rows of each shard: one number a shard reaches the driver."""
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(b, 0) for b in range(shards)]


def _clamped(room: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), room))


def _links(cells: DataFrame) -> int:
    """Links that no shard's border cuts."""
    return cells.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]


def _round(cells: DataFrame, quota: list[int], shards: int) -> DataFrame:
    """Cells after one round: those that are not among a text's largest move to these, the one with most room first."""
    room = [max(0, q - load) for q, load in zip(quota, _loads(cells, shards))]
    of_text = Window.partitionBy("key", "crc")
    ranked = cells.withColumn("r", F.row_number().over(of_text.orderBy(F.col("n").desc(), F.xxhash64("key", "shard"), "shard")) - 1)
    ranked = ranked.withColumn("total", F.sum("n").over(of_text))
    #: a text with more rows than a shard may hold keeps as many target shards as it needs
    ranked = ranked.withColumn("m", F.greatest(F.lit(1), F.ceil(F.col("total") / max(1, min(quota)))).cast("int"))
    open_ = _at(room, F.col("shard"))
    targets = F.sort_array(F.collect_list(F.when((F.col("r") < F.col("m")) & (open_ > 0), F.struct((-open_).alias("room"), "r", "shard"))).over(of_text))
    ranked = ranked.withColumn("targets", targets)
    moving = (F.col("r") >= F.col("m")) & (F.size("targets") > 0)
    wanted = F.when(moving, F.element_at(F.col("targets"), ((F.col("r") - F.col("m")) % F.greatest(F.size("targets"), F.lit(1)) + 1).cast("int"))["shard"])
    ranked = stage(ranked.withColumn("wanted", wanted).select("key", "crc", "shard", "n", "wanted"), "proposals")
    asked = ranked.where("wanted is not null")
    asked = with_running_sum(asked, ["wanted"], ["key", "crc", "shard"], "n", _range("key"), "before")
    asked = asked.withColumn("taken", _clamped(_at(room, F.col("wanted")) - F.col("before")))
    stay = ranked.where("wanted is null").select("key", "crc", "shard", "n")
    left = asked.select("key", "crc", "shard", (F.col("n") - F.col("taken")).alias("n"))
    moved = asked.select("key", "crc", F.col("wanted").alias("shard"), F.col("taken").alias("n"))
    after = stay.union(left).union(moved).where("n > 0").groupBy("key", "crc", "shard").agg(F.sum("n").alias("n"))
    return stage(after, "cells")


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    size is the text's UTF-8 bytes plus 16.  Null texts count as empty, and all
    empty texts are linked; long texts are read whole.  Repeated rows and rows
    that share an id or have none are documents of their own, numbered among
    themselves in any order, as they are alike; rows without an id are dealt
    apart, so that many of them are no single task's.  Ties between shards go by a
    hash of text and shard.  slot numbers the rows of a shard from 0 without
    gaps.  Other columns are left out; an empty table gives an empty result;
    with fewer rows than shards some shards are empty.  :func:`cut_links` tells
    how many links a result cuts.
    """
    body = text_of(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("key"),
    )
    lost = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)  # rows without an id have one another, for as long as they are staged
    rows = rows.withColumn("salt", lost)
    rows = stage(rows.withColumn("shard", F.pmod(F.xxhash64(*_OWN, F.lit(SEED)), F.lit(shards)).cast("int")), "rows")
    total = rows.count()
    quota = [total // shards + (b < total % shards) for b in range(shards)]

    cells = rows.groupBy("key", "crc", "shard").agg(F.count("*").alias("n"))
    cells = cells.withColumn("all", F.sum("n").over(Window.partitionBy("key", "crc"))).where("all > 1").drop("all")
    cells = stage(cells, "cells")
    won = _links(cells)
    for _ in range(rounds):
        before, cells = won, _round(cells, quota, shards)
        if (won := _links(cells)) == before:
            break

    kept = with_running_sum(cells, ["shard"], ["key", "crc"], "n", _range("key"), "before")
    kept = kept.withColumn("n", _clamped(_at(quota, F.col("shard")) - F.col("before"))).where("n > 0")
    kept = stage(kept.select("key", "crc", "shard", "n"), "kept")
    rest = [q - load for q, load in zip(quota, _loads(kept, shards))]

    # the first rows of a text go to its first cell, and so on; the cells of a text are at most one a shard
    upto = F.sum("n").over(Window.partitionBy("key", "crc").orderBy("shard"))
    places = kept.withColumn("upto", upto).groupBy("key", "crc").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    linked = rows.join(places.select("key", "crc"), ["key", "crc"], "left_semi")
    linked = stage(linked, "linked")
    parts = linked.withColumn("b", _range(*_OWN)).groupBy("key", "crc", "b").agg(F.count("*").alias("w"))
    before = F.sum("w").over(Window.partitionBy("key", "crc").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).drop("w").join(places, ["key", "crc"])
    inner = F.row_number().over(Window.partitionBy("key", "crc", "b").orderBy("doc_id")) - 1
    ranged = linked.drop("shard").withColumn("b", _range(*_OWN)).repartition("key", "crc", "b")  # else the rows of a text go to one task
    numbered = ranged.withColumn("inner", inner).join(parts, ["key", "crc", "b"])
    place = F.filter("places", lambda p: p["upto"] > F.col("before") + F.col("inner"))
    placed = numbered.withColumn("shard", F.try_element_at(place, F.lit(1))["shard"]).select(*_OWN, "shard")
    single = rows.join(places.select("key", "crc"), ["key", "crc"], "left_anti").select(*_OWN, F.lit(None).cast("int").alias("shard"))
    placed = stage(placed.union(single), "placed")

    free = with_running_sum(placed.where("shard is null").drop("shard"), [], [*_OWN], F.lit(1).cast("long"), _range(*_OWN), "at")
    ends = [sum(rest[: b + 1]) for b in range(shards)]
    shard_of = F.aggregate(F.array(*(F.lit(e).cast("long") for e in ends)), F.lit(0), lambda n, e: n + (e <= F.col("at")).cast("int"))
    full = stage(placed.where("shard is not null").union(free.select(*_OWN, shard_of.alias("shard"))), "assigned")
    slots = with_running_sum(full, ["shard"], [*_OWN], F.lit(1).cast("long"), _range(*_OWN), "slot")
    return slots.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def cut_links(assigned: DataFrame) -> DataFrame:
    """One row (links, cut) of the result of :func:`assign`: pairs of equal texts, and those of them in different shards; counted, not listed.

    Equal texts are told by size and CRC here.
    """
    cells = assigned.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n"))
    texts = cells.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    links = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    return texts.agg(links.cast("long").alias("links"), (links - F.coalesce(F.sum("kept"), F.lit(0.0))).cast("long").alias("cut"))
