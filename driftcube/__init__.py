"""A Spark-native segment anomaly engine."""

from driftcube.config import DIMENSIONS, AnomalyThresholds
from driftcube.functions.keys import build_segment_key_and_level, normalize_dim_value, parse_segment_key_parts, segment_id_from_row
from driftcube.operators.coverage import atomic_coverage as build_atomic_coverage
from driftcube.operators.coverage import candidate_covers_atomic, coverage_by_keys
from driftcube.operators.coverage import check_reconciliation as validate_hierarchy_reconciliation
from driftcube.operators.mart import period_to_weeks
from driftcube.operators.packing import apply_hierarchy_score_adjustment, decision_log, diagnostics, final, search_anomal, solve
from driftcube.operators.packing import validate as validate_set_packing_solution
from driftcube.operators.panel import full_grid as build_full_week_grid
from driftcube.operators.panel import missing_zero_report as build_missing_zero_report
from driftcube.operators.scoring import build_anomaly_candidates
from driftcube.operators.scoring import segment_metrics as calculate_segment_anomaly
from driftcube.plans.engine import Analysis
from driftcube.plans.pipeline import build_anomaly_tree_from_excel, highlight_manager_rows_on_anomaly_analysis, run_anomaly_analysis, run_pipeline, write_tables, write_tree
from driftcube.plans.pipeline import write_report as write_anomaly_excel
from driftcube.plans.reports import analysis_sheet as build_anomaly_analysis_sheet
from driftcube.plans.reports import control_table as build_control_table
from driftcube.plans.reports import history_for_selected as build_history_for_selected
from driftcube.plans.reports import manager_summary as build_manager_summary
from driftcube.sources.history import infer_anomaly_dimension_columns, load_history_table

__all__ = [
    "DIMENSIONS",
    "Analysis",
    "AnomalyThresholds",
    "apply_hierarchy_score_adjustment",
    "build_anomaly_analysis_sheet",
    "build_anomaly_candidates",
    "build_anomaly_tree_from_excel",
    "build_atomic_coverage",
    "build_control_table",
    "build_full_week_grid",
    "build_history_for_selected",
    "build_manager_summary",
    "build_missing_zero_report",
    "build_segment_key_and_level",
    "calculate_segment_anomaly",
    "candidate_covers_atomic",
    "coverage_by_keys",
    "decision_log",
    "diagnostics",
    "final",
    "highlight_manager_rows_on_anomaly_analysis",
    "infer_anomaly_dimension_columns",
    "load_history_table",
    "normalize_dim_value",
    "parse_segment_key_parts",
    "period_to_weeks",
    "run_anomaly_analysis",
    "run_pipeline",
    "search_anomal",
    "segment_id_from_row",
    "solve",
    "validate_hierarchy_reconciliation",
    "validate_set_packing_solution",
    "write_anomaly_excel",
    "write_tables",
    "write_tree",
]
