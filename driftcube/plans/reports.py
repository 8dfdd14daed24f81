"""Report tables over the results of the analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.config import AnomalyThresholds
from driftcube.functions.keys import key_parts
from driftcube.operators.panel import totals
from driftcube.operators.ranks import with_rank

#: Order of the lifecycle states in the report of structure changes.
STATES = ("new", "resumed", "vanished")
#: Metric changes of the manager's table and their headings.
CHANGES = {
    "gmv_wow_pct": "GMV WoW %",
    "tx_wow_pct": "TX WoW %",
    "au_wow_pct": "AU WoW %",
    "am_wow_pct": "AM WoW %",
    "aov_wow_pct": "AOV WoW %",
    "tpm_wow_pct": "TPM WoW %",
    "freq_wow_pct": "Freq WoW %",
}
#: Columns of the final sheet, of which those that exist are written.
FINAL_COLUMNS = (
    "rank", "output_block", "segment_key", "slice_depth", "gmv_current", "gmv_previous", "wow_delta_gmv", "relative_wow", "share_current", "share_delta_current",
    "baseline_relative_growth", "robust_z", "abs_robust_z", "z_scale_source", "z_uses_sigma_floor", "materiality_share", "gross_atomic_movement", "base_anomaly_score",
    "hierarchy_eligible_descendant_count", "hierarchy_group_count", "hierarchy_best_group_size", "hierarchy_best_group_ids_json", "hierarchy_best_group_segment_keys",
    "hierarchy_best_group_score", "hierarchy_direction_unity", "hierarchy_dominant_share", "hierarchy_balance_max", "hierarchy_balance_effective", "hierarchy_balance",
    "hierarchy_coherence", "hierarchy_coherence_adjustment", "hierarchy_single_child_capture", "hierarchy_single_child_direction_match", "hierarchy_single_child_uncapped_score",
    "hierarchy_dominance_cap_score", "hierarchy_dominance_cap_applied", "hierarchy_score_factor", "anomaly_score", "selection_score", "reliability_factor", "history_nonzero_weeks",
    "state", "reason", "covered_atomic_count", "selected", "set_packing_global_status", "set_packing_component_id", "set_packing_solver", "set_packing_solver_status",
    "set_packing_reason", "set_packing_objective_value", "set_packing_best_bound", "set_packing_abs_gap", "set_packing_rel_gap", "set_packing_solve_time_sec",
    "set_packing_variable_count", "set_packing_constraint_count", "set_packing_component_score_min", "set_packing_component_score_max",
    "set_packing_component_score_dynamic_range", "conflict_count", "conflict_segment_ids", "conflict_segment_keys", "atomic_coverage_source", "atomic_coverage_validation_status",
    "is_resolved", "original_atomic_count", "selected_atomic_count", "original_atomic_descendants", "selected_atomic_descendants",
)
#: Columns of the analysis sheet.
ANALYSIS_COLUMNS = (
    "segment", "depth", "z_scope", "z_scale_source", "z_uses_sigma_floor", "base_anomaly_score", "hierarchy_eligible_descendant_count", "hierarchy_group_count",
    "hierarchy_best_group_size", "hierarchy_best_group_ids_json", "hierarchy_best_group_segment_keys", "hierarchy_best_group_score", "hierarchy_direction_unity",
    "hierarchy_dominant_share", "hierarchy_balance_max", "hierarchy_balance_effective", "hierarchy_balance", "hierarchy_coherence", "hierarchy_coherence_adjustment",
    "hierarchy_single_child_capture", "hierarchy_single_child_direction_match", "hierarchy_single_child_uncapped_score", "hierarchy_dominance_cap_score",
    "hierarchy_dominance_rule_matches", "hierarchy_dominance_cap_applied", "hierarchy_dominant_child_segment", "hierarchy_score_factor", "anomaly_score", "selected",
    "is_resolved", "set_packing_status", "set_packing_reason", "set_packing_global_status", "set_packing_component_id", "set_packing_solver", "set_packing_solver_status",
    "set_packing_abs_gap", "set_packing_rel_gap", "set_packing_component_score_min", "set_packing_component_score_max", "set_packing_component_score_dynamic_range",
    "conflict_count", "conflict_segment_keys", "selected_atomic_count", "manager_rank", "manager_exclusion_reason", "delta_gmv",
)


def history_for_selected(panel: DataFrame, final: DataFrame) -> DataFrame:
    """Every window of the selected segments with share of the total and its change."""
    rows = panel.join(final.select("segment_id"), "segment_id", "left_semi").join(F.broadcast(totals(panel)), "cal_date")
    rows = rows.withColumn("share_in_total", F.col("gmv") / F.col("total_gmv"))
    change = F.col("share_in_total") - F.lag("share_in_total").over(Window.partitionBy("segment_id").orderBy("cal_date"))
    rows = rows.withColumn("share_delta", change)
    return rows.select("segment_id", "segment_key", "slice_depth", "cal_date", "gmv", "total_gmv", "share_in_total", "share_delta", "row_missing_in_source")


def structure_changes(candidates: DataFrame) -> DataFrame:
    """Segments that are new, resumed or vanished, largest change first within each state."""
    place = F.when(F.col("state") == STATES[0], 0).when(F.col("state") == STATES[1], 1).otherwise(2)
    rows = candidates.where(F.col("state").isin(*STATES) & (F.col("slice_depth") > 0))
    rows = rows.select("state", "segment_id", "segment_key", "slice_depth", "wow_delta_gmv", "robust_z")
    rows = with_rank(rows, [place, F.abs("wow_delta_gmv").desc(), F.col("slice_depth").desc(), F.col("segment_key")], "row_no")
    return rows.select(F.col("row_no").cast("int").alias("row_no"), *rows.columns[:-1])


def money(value: Column) -> Column:
    """Whole units, thousands apart by spaces: 1234567.89 -> 1 234 568; ties go to the even number."""
    return F.replace(F.format_number(F.bround(value, 0), 0), F.lit(","), F.lit(" "))


def percent(value: Column) -> Column:
    """A share as percent: 0.1234 -> 12.34%; empty where there is none."""
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(known, F.concat(F.format_string("%.2f", value * 100), F.lit("%"))).otherwise("")


def manager_summary(final: DataFrame, candidates: DataFrame, panel: DataFrame, current: int, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """Heading, brief, at most ``max_manager_facts`` facts and structure changes, in order, with what the rows say in words."""
    thresholds.check()
    shape = lambda df, section, no, says: df.select(F.lit(section).alias("section"), no.cast("int").alias("row_no"), "segment_key", "wow_delta_gmv", "robust_z", *CHANGES, "direction", says.alias("interpretation"))
    none = {c: F.lit(None).cast("double") for c in (*CHANGES, "robust_z")}
    heading = totals(panel).where(F.col("cal_date") == current).withColumns({**none, "segment_key": F.lit("total"), "wow_delta_gmv": F.col("total_gmv"), "direction": F.lit("")})
    rows = shape(heading, "1 heading", F.lit(1), F.concat(F.lit("total GMV of the current window: "), money(F.col("total_gmv"))))
    facts = final.where(F.col("rank") <= thresholds.max_manager_facts).withColumn("direction", F.when(F.col("wow_delta_gmv") > 0, "up").otherwise("down"))
    moved = F.format_string("GMV of the segment went %s against the window before", F.col("direction"))
    empty = final.agg(F.count("*").alias("n")).where("n = 0").withColumns({**none, "segment_key": F.lit(""), "wow_delta_gmv": F.lit(None).cast("double"), "direction": F.lit("")})
    rows = rows.union(shape(facts.where("rank = 1"), "2 brief", F.lit(1), moved)).union(shape(empty, "2 brief", F.lit(1), F.lit("no material unusual segment under these thresholds")))
    changes = structure_changes(candidates).select("row_no", F.col("segment_id").alias("id")).join(candidates, F.col("id") == F.col("segment_id")).withColumn("direction", F.col("state"))
    return rows.union(shape(facts, "3 facts", F.col("rank"), moved)).union(shape(changes, "4 structure", F.col("row_no"), F.col("state")))


def manager_sheet(manager: DataFrame) -> DataFrame:
    """The manager's table as it is printed: money, percents and rounded z as text."""
    changes = [percent(F.col(c)).alias(title) for c, title in CHANGES.items()]
    delta = F.when(F.col("section") == "1 heading", "").otherwise(F.coalesce(money(F.col("wow_delta_gmv")), F.lit("")))
    return manager.select("section", "row_no", "segment_key", delta.alias("Delta GMV"), *changes, F.round("robust_z", 2).alias("z_score"), "interpretation").orderBy("section", "row_no")


def dominant_child_suffix(parent: Column, child: Column) -> Column:
    """The values by which a child's key goes beyond its parent's, joined by ``*``."""
    own = F.filter(key_parts(child), lambda p: ~F.array_contains(key_parts(parent), p))
    return F.array_join(F.transform(own, lambda p: p["value"]), "*")


def with_report_names(diagnosed: DataFrame, thresholds: AnomalyThresholds) -> DataFrame:
    """``diagnosed`` with the names and the derived columns of the sheets."""
    rule = F.coalesce((F.size("hierarchy_best_group_ids") == 1) & (F.col("hierarchy_capture") >= thresholds.dominant_child_capture_threshold) & F.col("hierarchy_same_direction"), F.lit(False))
    listed = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    names = {
        "z_uses_sigma_floor": F.col("z_scale_source") == "SIGMA_FLOOR",
        "hierarchy_eligible_descendant_count": F.coalesce("hierarchy_descendant_count", F.lit(0)),
        "hierarchy_group_count": F.coalesce("hierarchy_group_count", F.lit(0)),
        "hierarchy_best_group_size": F.coalesce(F.size("hierarchy_best_group_ids"), F.lit(0)),
        "hierarchy_best_group_ids_json": listed("hierarchy_best_group_ids"),
        "hierarchy_best_group_segment_keys": listed("hierarchy_best_group_keys"),
        "hierarchy_direction_unity": F.col("hierarchy_unidirectionality"),
        "hierarchy_balance_effective": F.col("hierarchy_balance_eff"),
        "hierarchy_coherence_adjustment": F.when(F.size("hierarchy_best_group_ids") > 1, thresholds.aggregation_bonus_lambda * (F.col("hierarchy_coherence") - 0.5)),
        "hierarchy_single_child_capture": F.col("hierarchy_capture"),
        "hierarchy_single_child_direction_match": F.col("hierarchy_same_direction"),
        "hierarchy_single_child_uncapped_score": F.when(F.size("hierarchy_best_group_ids") == 1, F.col("hierarchy_uncapped_score")),
        "hierarchy_dominance_cap_score": F.col("hierarchy_score_cap"),
        "hierarchy_dominance_rule_matches": rule,
        "hierarchy_dominance_cap_applied": F.coalesce("hierarchy_cap_applied", F.lit(False)),
        "hierarchy_dominant_child_segment": F.when(rule, F.element_at("hierarchy_best_group_keys", 1)).otherwise(""),
        "hierarchy_score_factor": F.coalesce("hierarchy_factor", F.lit(1.0)),
        "reason": F.col("set_packing_reason"),
        "set_packing_component_id": F.coalesce("component_id", F.lit("")),
        "set_packing_solver": F.coalesce("solver_name", F.lit("")),
        "set_packing_solver_status": F.coalesce("solver_status", F.lit("")),
        "set_packing_objective_value": F.col("objective_value"),
        "set_packing_best_bound": F.col("best_bound"),
        "set_packing_abs_gap": F.col("absolute_gap"),
        "set_packing_rel_gap": F.col("relative_gap"),
        "set_packing_solve_time_sec": F.col("solve_time_sec"),
        "set_packing_variable_count": F.col("variable_count"),
        "set_packing_constraint_count": F.col("constraint_count"),
        "baseline_relative_growth": F.col("baseline_growth"),
    }
    return diagnosed.select("*", *(v.alias(f"__{k}") for k, v in names.items())).drop(*names).withColumnsRenamed({f"__{k}": k for k in names})


def final_sheet(final: DataFrame, history: DataFrame, current: int, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """The selected segments by rank, with the columns of the sheet; shares come from ``history``, that of the selected segments."""
    shares = history.where(F.col("cal_date") == current).select("segment_id", F.col("share_in_total").alias("share_current"), F.col("share_delta").alias("share_delta_current"))
    rows = with_report_names(final, thresholds).join(shares, "segment_id", "left")
    return rows.select(*(c for c in FINAL_COLUMNS if c in rows.columns)).orderBy("rank")


def analysis_sheet(diagnosed: DataFrame, final: DataFrame, thresholds: AnomalyThresholds = AnomalyThresholds()) -> DataFrame:
    """Every segment above the thresholds with what made its score, and its place in the manager's facts or why it has none."""
    shown = final.select("segment_id", F.when(F.col("rank") <= thresholds.max_manager_facts, F.col("rank")).alias("manager_rank"))
    rows = diagnosed.where(F.col("passes_initial_anomaly_filter") & (F.abs("wow_delta_gmv") >= thresholds.min_anomaly_abs))
    rows = with_report_names(rows, thresholds).join(shown, "segment_id", "left")
    reason = F.when(F.col("manager_rank").isNotNull(), "shown to the manager")
    reason = reason.when(F.col("selected"), F.lit(f"selected, but below the {thresholds.max_manager_facts} facts of the manager")).otherwise(F.col("selection_exclusion_reason"))
    made = {
        "segment": F.col("segment_key"),
        "depth": F.col("slice_depth"),
        "z_scope": F.round("robust_z", 2),
        "conflict_segment_keys": F.coalesce(F.array_join("conflict_segment_keys", " || "), F.lit("")),
        "manager_exclusion_reason": reason,
        "delta_gmv": F.bround("wow_delta_gmv", 0).cast("long"),
    }
    return rows.select(*(made[c].alias(c) if c in made else c for c in ANALYSIS_COLUMNS))


def control_table(history: DataFrame, panel: DataFrame, diagnosed: DataFrame, final: DataFrame, coverage: DataFrame, dates: list[int], current: int) -> DataFrame:
    """(metric, value, text): totals that let a reader check the run, one aggregate for each source table; text only for what is no number."""
    chosen = final.select("segment_id").join(coverage, "segment_id").agg(
        F.count_distinct("atom_id").alias("selected_atomic_unique_count"), (F.count("*") - F.count_distinct("atom_id")).alias("double_count_violation_count")
    )
    packed = final.agg(F.count("*").alias("selected_count"), F.coalesce(F.sum("selection_score"), F.lit(0.0)).alias("set_packing_objective_value"))
    is_part = F.col("component_id").isNotNull()
    counted = diagnosed.agg(
        F.count("*").alias("candidate_count"),
        F.count_if("is_eligible").alias("eligible_candidate_count"),
        F.count_if(F.col("is_eligible") & ~F.col("is_resolved")).alias("set_packing_unresolved_count"),
        F.count_if(F.col("set_packing_status") == "SET_PACKING_NOT_PROVEN").alias("set_packing_not_proven_count"),
        F.count_if("is_atom").alias("atomic_count"),
        F.max("set_packing_global_status").alias("set_packing_global_status"),
        F.count_distinct("component_id").alias("set_packing_component_count"),
        F.count_distinct(F.when(is_part & (F.col("solver_status") != "OPTIMAL"), F.col("component_id"))).alias("set_packing_non_optimal_component_count"),
        (F.sum("conflict_count") / 2).alias("set_packing_conflict_pair_count"),
    )
    rows = history.agg(F.count("*").alias("source_rows"))
    filled = panel.agg(
        F.count("*").alias("panel_rows"),
        F.count_if("row_missing_in_source").alias("filled_missing_rows"),
        F.sum(F.when((F.col("slice_depth") == 0) & (F.col("cal_date") == current), F.col("gmv"))).alias("current_total_gmv"),
    )
    fixed = {"week_count": len(dates), "previous_cal_date": dates[dates.index(current) - 1], "current_cal_date": current}
    one = rows.join(F.broadcast(filled)).join(F.broadcast(counted)).join(F.broadcast(packed)).join(F.broadcast(chosen)).withColumns({k: F.lit(v) for k, v in fixed.items()})
    text = lambda c: F.col(c) if c == "set_packing_global_status" else F.lit(None).cast("string")
    value = lambda c: F.lit(None).cast("double") if c == "set_packing_global_status" else F.col(c).cast("double")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), value(c).alias("value"), text(c).alias("text")) for c in one.columns)))
    return one.select(pairs.alias("x")).select("x.metric", "x.value", "x.text")


def parameters_and_control(thresholds: AnomalyThresholds, dims: tuple[str, ...], current: int, control: DataFrame) -> DataFrame:
    """(section, metric, value) of the run's parameters and of the control table, as text."""
    rows = [("dimensions", " × ".join(dims)), *((k, str(v)) for k, v in vars(thresholds).items()), ("current_cal_date", str(current))]
    listed = F.explode(F.array(*(F.struct(F.lit("parameters").alias("section"), F.lit(k).alias("metric"), F.lit(v).alias("value")) for k, v in rows)))
    own = control.sparkSession.range(1).select(listed.alias("x")).select("x.*")
    return own.union(control.select(F.lit("control"), "metric", F.coalesce("text", F.col("value").cast("string"))))
