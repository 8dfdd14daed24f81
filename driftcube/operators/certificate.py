"""A proof of a packing that does not come from its search: prices of atoms.

Whatever is charged for atoms, no set of disjoint segments is worth more than
all prices and what segments score above the prices of their atoms.  Here the
prices are the chosen segments' own scores, each split over its atoms, so the
bound is the objective and what the other segments lack to be paid for.
Splits are moved towards the unpaid segments in rounds of joins over the
coverage: each atom by what the segments over it lack, with RELAX times the
step of Polyak's rule for nothing lacking, and projected back so that each split
keeps its sum.  Where nothing is lacking the optimum is proven; a worse packing
is never.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftcube.storage import release, stage

#: Rounds in which the gap must fall by a tenth for more to follow.
PATIENCE = 6
#: What Polyak's step is lengthened by; it closes in for any below 2.
RELAX = 1.5


def price_bounds(packing: DataFrame, coverage: DataFrame, tolerance: float = 1e-9, rounds: int | None = None) -> DataFrame:
    """(component_id, segment_count, objective, bound, gap, certified), a row a component.

    ``packing`` has component_id, segment_id, anomaly_score and selected, a row
    an eligible segment; ``coverage`` (segment_id, atom_id).  ``certified`` tells
    that the gap is at most ``tolerance``, absolute or of the objective.  The
    bound holds for any packing, also where it certifies nothing: the packing
    is not the best, or no prices prove it.  Rounds go on while the gap falls, or
    up to ``rounds``.  Scores that are not positive need no price.  Chosen
    segments that share an atom are an error.  No rows give no rows.  The driver
    sees one count and sum a round.
    """
    gaps, _, _ = prices_of(packing, coverage, tolerance, rounds)
    return stage(gaps.select("component_id", "segment_count", "objective", "bound", "gap", "certified"), "bounds")


def prices_of(packing: DataFrame, coverage: DataFrame, tolerance: float = 1e-9, rounds: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gaps, prices, short) of the round with the lowest sum of gaps, for the arguments of :func:`price_bounds`.

    ``prices`` (component_id, owner, atom_id, score, price) has the atoms of
    chosen segments, others have no price; ``short`` (component_id, segment_id,
    short) the segments whose score is above the prices of their atoms.
    """
    score, chosen = F.col("anomaly_score").cast("double"), F.coalesce("selected", F.lit(False))
    rows = stage(packing.select("component_id", "segment_id", score.alias("score"), chosen.alias("selected")), "packing")
    atoms = coverage.select("segment_id", "atom_id").join(rows, "segment_id")
    even = F.col("score") / F.count("*").over(Window.partitionBy("segment_id"))
    prices = stage(atoms.where("selected").select("component_id", F.col("segment_id").alias("owner"), "atom_id", "score", even.alias("price")), "prices")
    if twice := prices.groupBy("atom_id").count().where("count > 1").first():
        raise ValueError(f"chosen segments share the atom {twice['atom_id']}")
    others = stage(atoms.where("not selected and score > 0").drop("selected"), "others")
    objective = F.coalesce(F.sum(F.when(F.col("selected"), F.col("score"))), F.lit(0.0)).alias("objective")
    sums = stage(rows.groupBy("component_id").agg(F.count("*").alias("segment_count"), objective), "objectives")
    seen, best = [], None
    for n in count():
        short = stage(_lacking(prices, others), "lacking")
        gaps = _gaps(sums, short, tolerance)
        left = gaps.where("not certified").agg(F.count("*").alias("n"), F.sum("gap").alias("gap")).first()
        seen.append(left["gap"] or 0.0)
        earlier, last = best, (gaps, prices, short)
        best = last if best is None or seen[-1] <= min(seen) else best
        if not left["n"] or n == rounds or (n >= PATIENCE and not min(seen[-PATIENCE:]) < 0.9 * min(seen[:-PATIENCE])):
            break
        prices = stage(_moved(prices, others, short, gaps.where("not certified")), "prices")
        if earlier not in (None, best):
            release(*earlier[1:])
        if last is not best:
            release(*last[1:])
    return best


def _lacking(prices: DataFrame, others: DataFrame) -> DataFrame:
    """(component_id, segment_id, short) of the segments whose score is above the prices of their atoms."""
    priced = others.join(prices.select("atom_id", "price"), "atom_id", "left").groupBy("component_id", "segment_id")
    found = priced.agg((F.first("score") - F.coalesce(F.sum("price"), F.lit(0.0))).alias("short"))
    return found.where("short > 0")


def _gaps(sums: DataFrame, short: DataFrame, tolerance: float) -> DataFrame:
    found = short.groupBy("component_id").agg(F.sum("short").alias("gap"), F.sum(F.col("short") * F.col("short")).alias("squares"))
    rows = sums.join(found, "component_id", "left").withColumn("gap", F.coalesce("gap", F.lit(0.0)))
    return rows.withColumns({"bound": F.col("objective") + F.col("gap"), "certified": F.col("gap") <= tolerance * F.greatest(F.lit(1.0), F.abs("objective"))})


def _moved(prices: DataFrame, others: DataFrame, short: DataFrame, open_: DataFrame) -> DataFrame:
    """The prices after one round; those of proven components stay."""
    pull = others.select("segment_id", "atom_id").join(short.select("segment_id", "short"), "segment_id").groupBy("atom_id").agg(F.sum("short").alias("pull"))
    of_owner = Window.partitionBy("owner")
    rows = prices.join(pull, "atom_id", "left").withColumn("pull", F.coalesce("pull", F.lit(0.0)))
    rows = rows.withColumn("way", F.col("pull") - F.avg("pull").over(of_owner))
    lengths = rows.groupBy("component_id").agg(F.sum(F.col("way") * F.col("way")).alias("length")).where("length > 0")
    steps = open_.join(lengths, "component_id").select("component_id", (RELAX * F.col("squares") / F.col("length")).alias("step"))
    rows = rows.join(steps, "component_id", "left").withColumn("aim", F.col("price") + F.coalesce(F.col("step") * F.col("way"), F.lit(0.0)))
    # the nearest split of the same sum: what the largest are above it goes, from all that stay above 0
    down = of_owner.orderBy(F.col("aim").desc(), "atom_id")
    over = (F.sum("aim").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("score")) / F.row_number().over(down)
    rows = rows.withColumn("over", over)
    cut = F.max(F.when(F.col("aim") > F.col("over"), F.col("over"))).over(of_owner)
    return rows.select("component_id", "owner", "atom_id", "score", F.greatest(F.lit(0.0), F.col("aim") - cut).alias("price"))
