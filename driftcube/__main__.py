"""python -m driftcube INPUT [--period 1W] [--report OUT.xlsx] [--tree OUT.svg]: analyse a history file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from driftcube.plans.pipeline import run_pipeline


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="driftcube", description=__doc__)
    parser.add_argument("input")
    parser.add_argument("--sheet", default="0", help="name or position of a workbook's sheet")
    parser.add_argument("--period", default="1W")
    parser.add_argument("--report")
    parser.add_argument("--tree")
    parser.add_argument("--date", type=int, help="current date, in days since the epoch; the last one if not given")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("driftcube").getOrCreate()
    sheet = int(a.sheet) if a.sheet.isdigit() else a.sheet
    results = run_pipeline(spark, a.input, a.report, a.tree, period=a.period, sheet=sheet, current_cal_date=a.date)
    shown = ("candidate_count", "eligible_candidate_count", "selected_count")
    for row in results["control"].where(results["control"]["metric"].isin(*shown)).collect():
        print(f"{row['metric']}: {row['value']:.0f}")


if __name__ == "__main__":
    main()
