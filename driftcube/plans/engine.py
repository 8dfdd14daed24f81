"""The analysis end to end: history -> panel -> metrics -> coverage -> packing -> reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS, AnomalyThresholds
from driftcube.operators import coverage as cov
from driftcube.operators import mart, packing, panel, scoring
from driftcube.plans import reports
from driftcube.storage import stage


@dataclass
class Analysis:
    """Each step once, on demand; what several steps read is a staged table."""

    history: DataFrame
    dates: list[int]
    thresholds: AnomalyThresholds = AnomalyThresholds()
    dims: tuple[str, ...] = DIMENSIONS
    current_cal_date: int | None = None

    @classmethod
    def of_sales(cls, spark: SparkSession, sf_dir: str, period: str = "13W", thresholds: AnomalyThresholds = AnomalyThresholds()) -> "Analysis":
        """From the transaction tables in ``sf_dir``, through the mart."""
        return cls.of_periods(spark, sf_dir, [period], thresholds)[period]

    @classmethod
    def of_periods(cls, spark: SparkSession, sf_dir: str, periods: Sequence[str], thresholds: AnomalyThresholds = AnomalyThresholds()) -> dict[str, "Analysis"]:
        """An analysis for each of ``periods``, of one mart that reads the sales once; a period without a complete window has no rows."""
        rows = stage(mart.windowed_sales(spark, sf_dir, periods), "windows")
        history = stage(mart.with_segment(mart.cube(mart.bucketed(rows))), "history")
        own = {p: history.where(F.col("period") == p.strip().upper()) for p in periods}
        return {p: cls(rows, panel.calendar(rows), thresholds) for p, rows in own.items()}

    def under(self, thresholds: AnomalyThresholds) -> "Analysis":
        """The same panel under other thresholds of the filter and what follows; its metrics, too, where those agree on what they need."""
        other = replace(self, thresholds=thresholds)
        other.__dict__ |= {"panel": self.panel, "coverage": self.coverage}
        if (thresholds.sigma_floor, thresholds.lifecycle_z_score) == (self.thresholds.sigma_floor, self.thresholds.lifecycle_z_score):
            other.__dict__["metrics"] = self.metrics
        return other

    @property
    def current(self) -> int:
        return self.dates[-1] if self.current_cal_date is None else self.current_cal_date

    @cached_property
    def panel(self) -> DataFrame:
        return stage(panel.full_grid(self.history, self.dates, self.dims), "panel")

    @cached_property
    def metrics(self) -> DataFrame:
        return stage(scoring.segment_metrics(self.panel, self.dates, self.current, self.thresholds, self.dims), "metrics")

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(scoring.candidates(self.metrics, self.thresholds), "candidates")

    @cached_property
    def coverage(self) -> DataFrame:
        return stage(cov.atomic_coverage(self.metrics, self.dims), "coverage")

    @cached_property
    def eligible(self) -> DataFrame:
        return stage(cov.eligible_coverage(self.candidates, self.coverage), "eligible")

    @cached_property
    def solved(self) -> DataFrame:
        cov.check_reconciliation(self.panel, self.coverage, self.thresholds.hierarchy_reconciliation_abs_tolerance)
        return packing.solve(self.candidates, self.coverage, self.thresholds)  # a staged table

    @cached_property
    def diagnosed(self) -> DataFrame:
        return stage(packing.diagnostics(self.candidates, self.coverage, self.solved, self.thresholds), "diagnosed")

    @cached_property
    def final(self) -> DataFrame:
        best = stage(packing.final(self.diagnosed), "final")
        packing.validate(self.diagnosed, self.coverage, self.solved, best, self.thresholds, self.bounds)
        return best

    @cached_property
    def bounds(self) -> DataFrame:
        return packing.certified(self.diagnosed, self.coverage, self.thresholds)  # a staged table

    @cached_property
    def manager(self) -> DataFrame:
        return reports.manager_summary(self.final, self.candidates, self.panel, self.current, self.thresholds)

    @cached_property
    def log(self) -> DataFrame:
        return packing.decision_log(self.diagnosed, self.coverage)

    @cached_property
    def control(self) -> DataFrame:
        return reports.control_table(self.history, self.panel, self.diagnosed, self.final, self.coverage, self.dates, self.current)

    def results(self) -> dict[str, DataFrame]:
        return {
            "history": self.history,
            "panel": self.panel,
            "candidates": self.diagnosed,
            "final": self.final,
            "manager": self.manager,
            "optimization_decision_log": self.log,
            "control": self.control,
        }

    def sheets(self) -> dict[str, DataFrame]:
        """The nine report tables in their order."""
        history = reports.history_for_selected(self.panel, self.final)
        return {
            "00_parameters_and_control": reports.parameters_and_control(self.thresholds, self.dims, self.current, self.control),
            "01_manager": reports.manager_sheet(self.manager),
            "02_final": reports.final_sheet(self.final, history, self.current, self.thresholds),
            "analysis": reports.analysis_sheet(self.diagnosed, self.final, self.thresholds).orderBy(*_analysis_order()),
            "03_history": history.orderBy("segment_key", "cal_date"),
            "04_candidates": self.diagnosed.orderBy("slice_depth", "segment_key"),
            "05_missing_and_zero": panel.missing_zero_report(self.panel, self.dates, self.current),
            "06_control": self.control,
            "07_decision_log": self.log,
        }


def _analysis_order() -> list:
    return [F.col("depth").desc(), F.col("anomaly_score").desc(), F.col("delta_gmv").desc(), F.col("segment")]
