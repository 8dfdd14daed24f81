"""File in, report out: the engine's public entry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS, AnomalyThresholds
from driftcube.plans import figure
from driftcube.plans.engine import Analysis
from driftcube.sources import workbook
from driftcube.sources.history import load_history_table


def highlight_manager_rows_on_anomaly_analysis(columns: Sequence[str], rows: Sequence[Sequence]) -> set[int]:
    """The rows of the analysis sheet, from 0, that the manager's table shows; the workbook fills them green."""
    at = list(columns).index("manager_rank")
    return {i for i, r in enumerate(rows) if r[at] is not None}


#: Rows of one sheet and of a whole workbook that the driver writes at most, and boxes of a graph; a sheet of the format ends at 1,048,576.
MOST_ROWS, MOST_IN_ALL, MOST_BOXES = 1_048_575, 2_000_000, 5_000


def _held(sheets: dict[str, DataFrame], most: int, in_all: int) -> None:
    """An error for tables that are too large for the driver; they are counted by one job, before any row of them is collected."""
    counts = reduce(DataFrame.unionAll, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sheets.items()))
    found = {r["name"]: r["n"] for r in counts.collect()}
    large = {name: n for name, n in found.items() if n > most}
    if large or sum(found.values()) > in_all:
        raise ValueError(f"too many rows for the driver, {large or found}; write_tables writes them as Parquet")


def write_report(analysis: Analysis, path: str | Path) -> None:
    """The nine sheets as one workbook; an error, before anything is collected, where they do not fit a sheet or the driver."""
    tables = analysis.sheets()
    _held(tables, MOST_ROWS, MOST_IN_ALL)
    sheets, marked = {}, {}
    for name, df in tables.items():
        rows = [list(r) for r in df.collect()]
        sheets[name] = df.columns, rows
        if name == "analysis":
            marked[name] = highlight_manager_rows_on_anomaly_analysis(df.columns, rows)
    workbook.write(path, sheets, marked)


def write_tables(analysis: Analysis, folder: str) -> None:
    """The same sheets as Parquet folders, for cubes of any size."""
    for name, df in analysis.sheets().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_tree(analysis: Analysis, path: str | Path) -> Path:
    """The graph of the segments above the thresholds; more than a graph can show are an error."""
    shown = analysis.sheets()["analysis"]
    _held({"analysis": shown}, MOST_BOXES, MOST_BOXES)
    rows = [r.asDict() for r in shown.collect()]
    return figure.write(path, _boxes(rows))


def build_anomaly_tree_from_excel(report_path: str | Path, path: str | Path, sheet: str = "analysis") -> Path:
    """The same graph from a report that :func:`write_report` has written."""
    columns, rows = workbook.read(report_path, sheet)
    return figure.write(path, _boxes([dict(zip(columns, r)) for r in rows]))


def _boxes(rows: list[dict]) -> list[figure.Box]:
    true = lambda v: str(v).strip().lower() in ("true", "1", "1.0", "yes")
    number = lambda v: float(v) if v not in (None, "") else 0.0
    return [
        figure.Box(
            str(r["segment"]), int(number(r["depth"])), number(r["z_scope"]), number(r["anomaly_score"]), number(r["delta_gmv"]), true(r["selected"]),
            true(r["hierarchy_dominance_rule_matches"]) and true(r["hierarchy_dominance_cap_applied"]), r["hierarchy_dominant_child_segment"] or "",
        )
        for r in rows
    ]


def run_pipeline(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    tree_path: str | None = None,
    *,
    period: str = "1W",
    sheet: str | int = 0,
    dims: Sequence[str] = DIMENSIONS,
    current_cal_date: int | None = None,
    thresholds: AnomalyThresholds = AnomalyThresholds(),
) -> dict[str, DataFrame]:
    """Analyse a history file; returns the seven result tables and writes the report and the graph if asked to."""
    history, names, dates = load_history_table(spark, input_path, sheet, period=period, dims=dims)
    analysis = Analysis(history, dates, thresholds.check(), tuple(names), current_cal_date)
    if output_path:
        write_report(analysis, output_path)
    if tree_path:
        write_tree(analysis, tree_path)
    return analysis.results()


run_anomaly_analysis = run_pipeline
