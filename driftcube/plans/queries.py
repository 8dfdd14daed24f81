"""Registered queries over the transaction tables, one for each operator of the engine."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.config import AnomalyThresholds
from driftcube.functions import keys
from driftcube.operators import coverage as cov
from driftcube.operators import frontier, groups, mart, packing, panel
from driftcube.plans import reports
from driftcube.plans.engine import Analysis
from driftcube.storage import stage

#: The default z and materiality, for amounts of any size, and as many descendants as there are: the search needs no bound on them.
THRESHOLDS = AnomalyThresholds(min_anomaly_abs=0.0, max_hierarchy_descendants=1_000_000)
#: Thresholds under which the components of the test tables stay so small that SQL can list all their disjoint sets.
STRICT = AnomalyThresholds(min_anomaly_abs=0.0, min_z_score=3.0, min_materiality_share=0.005)
#: Periods of the mart that holds several.
PERIODS = ("1W", "4W", "13W")
DIMS = ["geo", "products", "merchants_type", "is_terminal_or_cpqr"]

_analyses: WeakKeyDictionary = WeakKeyDictionary()


def analysis(spark: SparkSession, sf_dir: str, thresholds: AnomalyThresholds = THRESHOLDS) -> Analysis:
    """The analysis of a folder; queries of one session share its steps."""
    held = _analyses.setdefault(spark, {})
    if (sf_dir, thresholds) not in held:
        held[sf_dir, thresholds] = Analysis.of_sales(spark, sf_dir, "13W", thresholds) if thresholds == THRESHOLDS else analysis(spark, sf_dir).under(thresholds)
    return held[sf_dir, thresholds]


def strict(spark: SparkSession, sf_dir: str) -> Analysis:
    return analysis(spark, sf_dir, STRICT)


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def complete_windows(spark, sf_dir):
    rows = mart.windowed_sales(spark, sf_dir)
    return rows.groupBy("idx", "cal_date").agg(F.count("*").alias("rows"), (F.sum("amount") / mart.UNIT).alias("gmv"))


def top_n_bucket(spark, sf_dir):
    rows = mart.bucketed(stage(mart.windowed_sales(spark, sf_dir), "windows"))  # read for the brands' ranks and for the result
    return rows.groupBy("merchants_type", "cal_date").agg(F.count("*").alias("rows"), (F.sum("amount") / mart.UNIT).alias("gmv"))


def cube_mart(spark, sf_dir):
    return analysis(spark, sf_dir).history.select("cal_date", "slice_depth", *DIMS, "gmv", "tx", "au", "am")


def mart_periods(spark, sf_dir):
    rows = stage(mart.windowed_sales(spark, sf_dir, PERIODS), "windows")
    return mart.cube(mart.bucketed(rows)).select("period", "cal_date", "slice_depth", *DIMS, "gmv", "tx", "au", "am", "aov", "tpm", "freq")


def top_brands_by_period(spark, sf_dir):
    rows = mart.top_brands(mart.windowed_sales(spark, sf_dir, PERIODS))
    return rows.select("period", "rank", "brand", (F.col("amount") / mart.UNIT).alias("gmv"))


def ratio_metrics(spark, sf_dir):
    return analysis(spark, sf_dir).history.select("segment_id", "cal_date", "aov", "tpm", "freq")


def share_of_total(spark, sf_dir):
    return _round(mart.with_share_of_total(analysis(spark, sf_dir).history).select("segment_id", "cal_date", "share_in_total_gmv"), 10, "share_in_total_gmv")


def coverage_by_keys(spark, sf_dir):
    return cov.coverage_by_keys(analysis(spark, sf_dir).metrics)


def component_stats(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return packing.component_stats(a.diagnosed, a.coverage).select("component_id", "segment_count", "atom_count", "conflict_pair_count", "min_depth", "max_depth", "variable_count", "constraint_count")


def component_stats_strict(spark, sf_dir):
    a = strict(spark, sf_dir)
    names = ("score_sum", "score_min", "score_max", "objective_value", "best_bound", "absolute_gap", "relative_gap", "score_dynamic_range")
    rows = packing.component_stats(a.diagnosed, a.coverage).select("component_id", "segment_count", "atom_count", "conflict_pair_count", "min_depth", "max_depth", "solver_name", "solver_status", *names)
    return _round(rows, 6, *names)


def segment_keys(spark, sf_dir):
    return analysis(spark, sf_dir).history.select("segment_id", "segment_key", "segment_level", "slice_depth").distinct()


def parse_segment_key(spark, sf_dir):
    rows = segment_keys(spark, sf_dir).select("segment_id", F.posexplode(keys.key_parts(F.col("segment_key"))).alias("part_no", "part"))
    return rows.select("segment_id", "part_no", "part.dim", "part.value")


def week_grid(spark, sf_dir):
    return analysis(spark, sf_dir).panel.select("segment_id", "cal_date", "gmv", "tx", "au", "am", "aov", "row_missing_in_source")


def missing_zero_report(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return panel.missing_zero_report(a.panel, a.dates, a.current)


def robust_z(spark, sf_dir):
    rows = analysis(spark, sf_dir).metrics.select("segment_id", "baseline_growth", "mad_growth", "relative_wow", "robust_z", "z_scale_source")
    return _round(_round(rows, 6, "baseline_growth", "mad_growth", "relative_wow"), 3, "robust_z")


def lifecycle_state(spark, sf_dir):
    return analysis(spark, sf_dir).metrics.select("segment_id", "state", "history_nonzero_weeks", "reliability_factor", "gmv_previous", "gmv_current")


def metric_wow(spark, sf_dir):
    names = [f"{m}_wow_pct" for m in ("gmv", "tx", "au", "am", "aov", "tpm", "freq")]
    return _round(analysis(spark, sf_dir).metrics.select("segment_id", *names), 6, *names)


def materiality(spark, sf_dir):
    rows = analysis(spark, sf_dir).candidates.select("segment_id", "wow_delta_gmv", "gross_atomic_movement", "materiality_share")
    return _round(_round(rows, 4, "wow_delta_gmv", "gross_atomic_movement"), 8, "materiality_share")


def initial_filter(spark, sf_dir):
    return analysis(spark, sf_dir).candidates.select("segment_id", "is_atom", "passes_initial_anomaly_filter")


def top_movers(spark, sf_dir):
    rows = analysis(spark, sf_dir).candidates.where("passes_initial_anomaly_filter")
    return _round(rows.select("segment_key", "slice_depth", "state", "base_anomaly_score"), 6, "base_anomaly_score")


def atomic_coverage(spark, sf_dir):
    return analysis(spark, sf_dir).coverage


def reconciliation(spark, sf_dir):
    a = analysis(spark, sf_dir)
    rows = cov.reconciliation(a.panel, a.coverage)
    return rows.select("segment_id", "cal_date", F.round("gmv", 4).alias("gmv"), (F.col("error") <= 1e-4).alias("reconciled"))


def descendants(spark, sf_dir):
    return cov.descendants(analysis(spark, sf_dir).eligible)


def conflict_pairs(spark, sf_dir):
    return cov.conflict_pairs(analysis(spark, sf_dir).eligible).select("left_key", "right_key", "shared_atomic_count")


def components(spark, sf_dir):
    return cov.components(analysis(spark, sf_dir).eligible)


def hierarchy_adjust_strict(spark, sf_dir):
    names = ("anomaly_score", "hierarchy_factor", "hierarchy_best_group_score", "hierarchy_capture", "hierarchy_score_cap", "hierarchy_unidirectionality", "hierarchy_dominant_share", "hierarchy_balance_max", "hierarchy_balance_eff", "hierarchy_coherence")
    rows = strict(spark, sf_dir).solved
    rows = rows.select("segment_id", *names, "hierarchy_descendant_count", "hierarchy_group_count", F.to_json("hierarchy_best_group_ids").alias("hierarchy_best_group_ids"), "hierarchy_cap_applied", "hierarchy_same_direction")
    return _round(rows, 6, *names)


def hierarchy_groups_strict(spark, sf_dir):
    a = strict(spark, sf_dir)
    rows = groups.disjoint_groups(a.eligible, a.solved, a.thresholds.max_hierarchy_descendants)
    return _round(rows.withColumn("group_ids", F.to_json("group_ids")), 6, "group_score")


def set_packing_selected_strict(spark, sf_dir):
    return strict(spark, sf_dir).diagnosed.where("is_eligible").select("segment_id", "component_id", "selected", "set_packing_status", "set_packing_global_status", "selected_atomic_count")


def packing_bound(spark, sf_dir):
    rows = analysis(spark, sf_dir).bounds.select("component_id", "segment_count", "objective", "bound", F.when(F.col("certified"), 0.0).otherwise(F.col("gap")).alias("gap"), "certified")
    return _round(rows, 4, "objective", "bound", "gap")  # a certified gap is within the tolerance


def packing_bound_strict(spark, sf_dir):
    rows = strict(spark, sf_dir).bounds.select("component_id", "segment_count", "objective", "bound", "certified")
    return _round(rows, 4, "objective", "bound")


def _by_frontier(a):
    """The packing of every component, none by the search: their adjusted scores and coverage, through the frontier."""
    rows = a.solved.join(a.candidates.select("segment_id", "segment_key"), "segment_id")
    return frontier.pack_frontier(rows, a.eligible)


def packing_frontier(spark, sf_dir):
    return _by_frontier(analysis(spark, sf_dir))


def packing_frontier_strict(spark, sf_dir):
    return _by_frontier(strict(spark, sf_dir))


def final_ranked(spark, sf_dir):
    return _round(analysis(spark, sf_dir).final.select("rank", "segment_key", "component_id", "anomaly_score"), 6, "anomaly_score")


def final_ranked_strict(spark, sf_dir):
    return _round(strict(spark, sf_dir).final.select("rank", "segment_key", "anomaly_score"), 6, "anomaly_score")


def decision_log_strict(spark, sf_dir):
    rows = strict(spark, sf_dir).log
    names = ("objective_value", "best_bound", "absolute_gap", "relative_gap", "score_sum", "score_min", "score_max", "score_dynamic_range", "anomaly_score")
    rows = rows.drop("solve_time_sec", "message", "segment_ids", "shared_atomic_ids", "selected_ids", "variable_count", "constraint_count")
    return _round(rows, 6, *names)


def history_selected_strict(spark, sf_dir):
    a = strict(spark, sf_dir)
    rows = reports.history_for_selected(a.panel, a.final)
    return _round(_round(rows, 4, "gmv", "total_gmv"), 8, "share_in_total", "share_delta")


def analysis_sheet_strict(spark, sf_dir):
    a = strict(spark, sf_dir)
    rows = reports.analysis_sheet(a.diagnosed, a.final, a.thresholds)
    return _round(rows, 6, *(f.name for f in rows.schema if f.dataType.typeName() == "double"))


def manager_summary_strict(spark, sf_dir):
    a = strict(spark, sf_dir)
    return _round(a.manager.select("section", "row_no", "segment_key", "wow_delta_gmv", "direction", "interpretation"), 4, "wow_delta_gmv")


def control_table_strict(spark, sf_dir):
    return _round(strict(spark, sf_dir).control, 4, "value")


def structure_changes(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return _round(reports.structure_changes(a.candidates).select("row_no", "state", "segment_key", "wow_delta_gmv"), 4, "wow_delta_gmv")


def dag_edges(spark, sf_dir):
    return cov.dag_edges(analysis(spark, sf_dir).candidates.where("passes_initial_anomaly_filter"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    of = (
        complete_windows, top_n_bucket, cube_mart, mart_periods, top_brands_by_period, ratio_metrics, share_of_total, segment_keys, parse_segment_key, week_grid, missing_zero_report, robust_z, lifecycle_state, metric_wow, materiality,
        initial_filter, top_movers, atomic_coverage, coverage_by_keys, reconciliation, descendants, conflict_pairs, components, component_stats, packing_bound, packing_frontier, final_ranked, dag_edges, structure_changes,
        hierarchy_adjust_strict, hierarchy_groups_strict, set_packing_selected_strict, component_stats_strict, packing_bound_strict, packing_frontier_strict, final_ranked_strict, decision_log_strict, history_selected_strict, analysis_sheet_strict, manager_summary_strict,
        control_table_strict,
    )
    return {f.__name__: f for f in of}
