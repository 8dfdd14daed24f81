"""Mixing sources to target weights by capped water-filling.

A share of all sizes is dealt to the sources by weight; a source's target stops
at ``max_epochs`` times its size and the excess is dealt again by weight until
no target is above its stop.  The fixed point has a closed form: sorted by
stop / weight, a prefix of the sources is at its stop, and the others get the
rest by weight.  A source's documents are then repeated whole as often as its
target allows, and a seeded order of them fills the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.llm.common import stage, text_of, with_running_sum

#: Production parameters.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
#: Most sources for which their list is broadcast; beyond it the list is joined by a shuffle.
BROADCAST_SOURCES = 100_000

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Words of the text, 0 for a null one."""
    return F.regexp_count(text_of(text), F.lit(WORDS)).cast("long")


def drawn(doc_id: str, seed: str) -> Column:
    """The seeded hash of a document's id by which documents are ordered."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source, a null source last.

    Sources by code point take the weights in turn.  There is one row a source
    by then, so the windows without a partition stand over the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    per = per.withColumn("stop", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("stop").over(upto), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - below) / rest)
    #: the first source, in that order, whose stop isn't reached at the level of those from it on
    per = per.withColumn("free", F.col("stop") > F.col("level") * F.col("weight"))
    per = per.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), "source", "level"))).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("stop").cast("double"))
    target = target.otherwise(F.least(F.col("stop").cast("double"), F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **weights) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, part, taken, draw) of every row of ``docs``.

    Every document is repeated whole ``epochs`` = floor(target / source_size)
    times.  In the order of a seeded hash of the id, documents are taken once
    more until their words fill the fraction; ``part`` is the words of that
    repetition: all, none, or for one document a source what was still open.
    ``taken`` is the words in all.  A source of no words takes none, a null or
    empty text has none; long texts are counted whole.  Ties of the hash go by
    id and size, so repeated rows count as documents of their own and reruns
    agree; rows without an id have one hash together.  A null source is one,
    the last.  Other columns are left out; an empty table gives an empty result.

    Sums are accumulated over hash ranges first, then within a range, so no
    task sees a whole source.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), drawn(doc_id, seed).alias("draw"))
    rows = stage(rows, "sizes")
    goals = stage(targets(rows, **weights).withColumnRenamed("source", "s"), "targets")
    part = F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")
    rows = with_running_sum(rows, ["source"], ["draw", "doc_id", "size"], "size", part, "before")
    listed = goals.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(goals) if listed else goals, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    open_words = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), open_words - F.col("before")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), part.alias("part"), "draw")
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def take(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, **weights) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mixed` says, 0 times included.

    Texts are never cut: the one partial repetition of a source counts as whole
    if at least half of the text is in it, else not at all.  What is taken once
    more is a beginning of the order, so all that goes back to the documents is
    the last one taken of each source, and their texts stay where they are.
    Rows of one id and size are decided alike.  Null and empty texts are never
    taken once more, so they come only in whole repetitions; columns that clash
    with names used here stay as they are.
    """
    found = mixed(docs, doc_id, source, text, seed, **weights)
    place = F.struct("draw", "doc_id", "size")
    last = F.max(F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), place))
    ends = stage(found.groupBy("source").agg(F.first("epochs").alias("__epochs"), last.alias("__last")).withColumnRenamed("source", "__source"), "ends")
    rows = docs.withColumns({"__size": words(text), "__draw": drawn(doc_id, seed)})
    rows = rows.join(F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends, F.col(source).eqNullSafe(F.col("__source")))
    more = (F.col("__size") > 0) & F.coalesce(F.struct(F.col("__draw").alias("draw"), F.col(doc_id).alias("doc_id"), F.col("__size").alias("size")) <= F.col("__last"), F.lit(False))
    copies = F.col("__epochs") + F.when(more, 1).otherwise(0)
    again = F.explode(F.array_repeat(F.lit(0), copies.cast("int")))
    return rows.withColumn("__again", again).select(*(docs[c] for c in docs.columns))
