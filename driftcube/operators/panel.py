"""The dense panel of segments by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftcube.config import ADDITIVE, DIMENSIONS, RATIOS

META = ("segment_id", "segment_key", "segment_level", "slice_depth")


def calendar(history: DataFrame) -> list[int]:
    """Dates of the total layer, ascending: one number a window."""
    return [r[0] for r in history.where("slice_depth = 0").select("cal_date").distinct().orderBy("cal_date").collect()]


def full_grid(history: DataFrame, dates: list[int], dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Exactly segments x dates; absent rows have 0 in additive measures, null ratios and ``row_missing_in_source``.

    The dates are a literal list, so a segment's rows come from an explode and
    one join by (segment, date) fills them.  A segment whose rows do not agree
    on what describes it is an error.
    """
    own = F.struct(*META[1:], *dims)
    segments = history.groupBy("segment_id").agg(F.min(own).alias("own"), (F.min(own) != F.max(own)).alias("differ"))
    if bad := [r["segment_id"] for r in segments.where("differ").select("segment_id").limit(5).collect()]:
        raise ValueError(f"segments whose key, level, depth or dimensions differ between rows: {bad}")
    segments = segments.select("segment_id", *(F.col(f"own.{c}").alias(c) for c in (*META[1:], *dims)))
    grid = segments.withColumn("cal_date", F.explode(F.array(*(F.lit(d).cast("long") for d in dates))))
    known = history.select("segment_id", "cal_date", *ADDITIVE, *RATIOS, F.lit(True).alias("known"))
    rows = grid.join(known, ["segment_id", "cal_date"], "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ADDITIVE}
    return rows.withColumns(filled).withColumn("row_missing_in_source", F.col("known").isNull()).drop("known")


def totals(panel: DataFrame) -> DataFrame:
    """(cal_date, total_gmv)."""
    return panel.where("slice_depth = 0").groupBy("cal_date").agg(F.sum("gmv").alias("total_gmv"))


def missing_zero_report(panel: DataFrame, dates: list[int], current: int | None = None) -> DataFrame:
    """Segments with missing or zero windows, their counts and the last two windows' state, worst first."""
    current = dates[-1] if current is None else current
    previous = dates[dates.index(current) - 1]
    at = lambda date, c: F.max(F.when(F.col("cal_date") == date, F.col(c)))
    report = panel.groupBy(*META).agg(
        F.sum(F.col("row_missing_in_source").cast("int")).alias("missing_week_count"),
        F.count_if(F.col("gmv") == 0).alias("zero_week_count"),
        F.count_if(F.col("gmv") > 0).alias("nonzero_week_count"),
        at(previous, "gmv").alias("gmv_previous"),
        at(previous, "row_missing_in_source").alias("previous_row_missing"),
        at(current, "gmv").alias("gmv_current"),
        at(current, "row_missing_in_source").alias("current_row_missing"),
    )
    rows = report.where("missing_week_count > 0 or zero_week_count > 0")
    return rows.orderBy(F.col("missing_week_count").desc(), F.col("zero_week_count").desc(), "segment_key")
