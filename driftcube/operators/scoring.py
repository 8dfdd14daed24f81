"""Anomaly metrics of every segment's last transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.config import ADDITIVE, DIMENSIONS, RATIOS, AnomalyThresholds
from driftcube.operators.coverage import atomic_coverage, check_reconciliation
from driftcube.operators.panel import META

METRICS = (*ADDITIVE, *RATIOS)
#: Scale of the median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


def reliability(nonzero: Column) -> Column:
    """Trust in a history of so many windows above zero."""
    return F.when(nonzero >= 8, 1.0).when(nonzero >= 4, 0.7).when(nonzero >= 1, 0.4).otherwise(0.1)


def segment_metrics(panel: DataFrame, dates: list[int], current: int | None = None, thresholds: AnomalyThresholds = AnomalyThresholds(), dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row a segment: robust z of the last relative change, lifecycle state, reliability, changes of all metrics.

    All of it hangs on the segment, so one shuffle serves the windows and the
    aggregate.
    """
    thresholds.check()
    current = dates[-1] if current is None else current
    if current not in dates or current == dates[0]:
        raise ValueError(f"current date {current}: it must be in the calendar and not its first")
    previous = dates[dates.index(current) - 1]
    of = Window.partitionBy("segment_id")
    before = F.lag("gmv").over(of.orderBy("cal_date"))
    rows = panel.withColumn("before", before)
    rows = rows.withColumn("growth", F.when(F.col("before") > 0, (F.col("gmv") - F.col("before")) / F.col("before")))
    rows = rows.withColumn("past", F.when(F.col("cal_date") < current, F.col("growth")))
    rows = rows.withColumn("base", F.coalesce(F.median("past").over(of), F.lit(0.0)))
    rows = rows.withColumn("mad", F.coalesce(F.median(F.abs(F.col("past") - F.col("base"))).over(of), F.lit(0.0)))
    at = lambda date, c: F.max(F.when(F.col("cal_date") == date, F.col(c)))
    found = rows.groupBy(*META, *dims).agg(
        F.first("base").alias("baseline_growth"),
        F.first("mad").alias("mad_growth"),
        at(current, "growth").alias("relative_wow"),
        F.count_if((F.col("cal_date") < current) & (F.col("gmv") > 0)).alias("history_nonzero_weeks"),
        *(at(previous, m).alias(f"{m}_previous") for m in METRICS),
        *(at(current, m).alias(f"{m}_current") for m in METRICS),
    )
    c, p, n = F.col("gmv_current"), F.col("gmv_previous"), F.col("history_nonzero_weeks")
    state = F.when((c > 0) & (n == 0), "new").when((c > 0) & (p == 0) & (n > 0), "resumed")
    state = state.when((c == 0) & (p > 0), "vanished").otherwise("ordinary")
    scaled = F.col("mad_growth") * MAD_SCALE
    found = found.withColumns(
        {
            "wow_delta_gmv": c - p,
            "state": state,
            "reliability_factor": reliability(n),
            "robust_sigma": F.greatest(scaled, F.lit(thresholds.sigma_floor)),
            "z_scale_source": F.when(scaled < thresholds.sigma_floor, "SIGMA_FLOOR").otherwise("MAD"),
        }
    )
    lifecycle = F.when((F.col("state") != "ordinary") & (F.col("wow_delta_gmv") != 0), thresholds.lifecycle_z_score).otherwise(0.0)
    z = F.when(F.col("relative_wow").isNull(), lifecycle).otherwise((F.col("relative_wow") - F.col("baseline_growth")) / F.col("robust_sigma"))
    found = found.withColumn("robust_z", z).withColumn("abs_robust_z", F.abs("robust_z"))
    change = lambda m: F.when(F.col(f"{m}_previous") != 0, (F.col(f"{m}_current") - F.col(f"{m}_previous")) / F.col(f"{m}_previous"))
    return found.withColumns({f"{m}_wow_pct": change(m) for m in METRICS})


def candidates(metrics: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """``metrics`` with materiality, the initial filter as a flag, and the base score.

    Atoms are the segments of the largest depth that occurs; materiality is a
    change's share of all atoms' absolute changes.  Both are one broadcast row.
    """
    deepest = metrics.agg(F.max("slice_depth").alias("atom_depth"))
    rows = metrics.join(F.broadcast(deepest))
    moved = rows.where("slice_depth = atom_depth").agg(F.sum(F.abs("wow_delta_gmv")).alias("gross_atomic_movement"))
    rows = rows.join(F.broadcast(moved)).withColumn("is_atom", F.col("slice_depth") == F.col("atom_depth"))
    share = F.when(F.col("gross_atomic_movement") > 0, F.abs("wow_delta_gmv") / F.col("gross_atomic_movement")).otherwise(0.0)
    rows = rows.withColumn("materiality_share", share)
    passes = (
        (F.col("slice_depth") > 0)
        & (F.col("abs_robust_z") >= thresholds.min_z_score)
        & (F.col("materiality_share") >= thresholds.min_materiality_share)
        & (F.abs("wow_delta_gmv") >= thresholds.min_anomaly_abs)
    )
    base = F.col("abs_robust_z") * F.col("materiality_share") * F.col("reliability_factor")
    return rows.withColumn("passes_initial_anomaly_filter", passes).withColumn("base_anomaly_score", base)


def build_anomaly_candidates(
    panel: DataFrame,
    dates: list[int],
    current: int | None = None,
    thresholds: AnomalyThresholds = AnomalyThresholds(),
    dims: tuple[str, ...] = DIMENSIONS,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """The candidates of a panel whose totals are positive on every date and whose segments are the sums of their atoms; errors otherwise."""
    totals = panel.where("slice_depth = 0").groupBy("cal_date").agg(F.sum("gmv").alias("total"))
    known = {r["cal_date"]: r["total"] for r in totals.collect()}  # one number a date
    if bad := [d for d in dates if not known.get(d, 0.0) > 0]:
        raise ValueError(f"the total is not positive on {bad}")
    metrics = segment_metrics(panel, dates, current, thresholds, dims)
    check_reconciliation(panel, atomic_coverage(metrics, dims) if coverage is None else coverage, thresholds.hierarchy_reconciliation_abs_tolerance)
    return candidates(metrics, thresholds)
