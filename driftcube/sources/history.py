"""Reading a pre-aggregated history and holding it to its contract."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from driftcube.config import DIMENSIONS, KEY_SEPARATOR, RATIOS
from driftcube.functions.keys import clean_dimension, depth
from driftcube.operators.mart import period_to_weeks, with_segment
from driftcube.sources import workbook
from driftcube.storage import stage

NUMBERS = ("cal_date", "slice_depth", "gmv", "tx", "au", "am")
REQUIRED = ("period", *NUMBERS)
#: Spellings of a missing value in text files.
MISSING = ("", "NA", "N/A", "n/a", "#N/A", "NaN", "nan", "NULL", "null", "None", "<NA>")
LEAST_DATES, EXAMPLES = 4, 5
#: The column of a row's faulty numbers while the history is written.
_BAD = "__bad"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def read_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A history file as text columns: .csv, .xlsx or (beyond the contract) .parquet; the suffix in either case."""
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if suffix == ".xlsx":
        columns, rows = workbook.read(path, sheet)
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"{path}: expected a .csv, .xlsx or .parquet file")


def _text(name: str) -> Column:
    value = F.regexp_replace(F.col(name).cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(~value.isin(*MISSING), value)


def _number(name: str) -> Column:
    """A finite number, or null."""
    text = _text(name)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def infer_anomaly_dimension_columns(columns: Sequence[str], dims: Sequence[str] = DIMENSIONS) -> list[str]:
    """The dimensions of a history, in their order; an error names those that its columns lack."""
    if missing := sorted(set(dims) - set(columns)):
        raise ValueError(f"required columns are missing: {missing}")
    return list(dims)


def load_history_table(spark: SparkSession, path: str, sheet: str | int = 0, *, period: str, dims: Sequence[str] = DIMENSIONS) -> tuple[DataFrame, list[str], list[int]]:
    """(history, dimensions, dates): the rows of one period, typed and validated; a ValueError names what is wrong.

    Extra columns are carried along.  The input is read once: its rows are
    checked while the typed history is written, of which the rest is told.
    """
    if not isinstance(period, str):
        raise ValueError("period: expected <N>W")
    weeks = period_to_weeks(period)
    return _validated(read_table(spark, path, sheet), weeks, period.strip().upper(), tuple(dims))


def _validated(raw: DataFrame, weeks: int, period: str, dims: tuple[str, ...]) -> tuple[DataFrame, list[str], list[int]]:
    """The typed history, written once while its rows are held to the contract: the only scan of ``raw``.

    All faults of all columns stand in one error.  What spans rows (duplicates,
    calendar) is told from the written table, and only if its numbers are whole.
    """
    if missing := sorted({*REQUIRED, *dims} - set(raw.columns)):
        raise ValueError(f"required columns are missing: {missing}")
    rows = raw.where(~_text("period").eqNullSafe(F.lit("string")))  # a row of type names under the header
    rows = rows.where(F.upper(_text("period")) == period)
    bad = F.array_compact(F.array(*(F.when(_number(c).isNull(), F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("shown"))) for c in NUMBERS)))
    typed = {c: _number(c) for c in NUMBERS} | {c: clean_dimension(F.when(~F.col(c).cast("string").isin(*MISSING), F.col(c).cast("string"))) for c in dims}
    typed |= {c: _number(c) if c in raw.columns else F.lit(None).cast("double") for c in RATIOS}
    rows = rows.withColumn(_BAD, bad).withColumns(typed).withColumns({"cal_date": F.col("cal_date").cast("long"), "slice_depth": F.col("slice_depth").cast("int")})
    rows = with_segment(rows, dims)
    wrong_depth = F.coalesce(F.col("slice_depth") != depth(dims), F.lit(False))
    unsafe = F.coalesce(F.greatest(*(F.coalesce(F.contains(F.col(d), F.lit(KEY_SEPARATOR)), F.lit(False)) for d in dims)), F.lit(False))
    seen = Observation()
    found = [F.count("*").alias("rows"), F.min("period").alias("first"), F.max("period").alias("last"), F.count_if(wrong_depth).alias("depth"), F.count_if(unsafe).alias("separator"), F.count_if(F.size(_BAD) > 0).alias("numbers")]
    written = stage(rows.observe(seen, *found), "history")
    n = seen.get
    if not n["rows"]:
        raise ValueError(f"period {period}: no rows")
    faults = []
    if n["first"] != n["last"]:
        faults.append(f"period {period}: more than one spelling, {[n['first'], n['last']]}")
    if n["numbers"]:
        place = F.row_number().over(Window.partitionBy("column").orderBy("shown"))  # cut to the examples before the shuffle
        some = written.select(F.explode(_BAD).alias("b")).select("b.column", "b.shown").withColumn("no", place).where(F.col("no") <= EXAMPLES)
        shown = {}
        for r in sorted(some.collect(), key=lambda r: (NUMBERS.index(r["column"]), r["no"])):
            shown.setdefault(r["column"], []).append(r["shown"])
        faults.append(f"columns with values that are not finite numbers: {shown}")
    example = lambda where, *columns: [tuple(r) for r in written.where(where).select(*columns).limit(EXAMPLES).collect()]
    if n["depth"]:
        faults.append(f"slice_depth is not the number of dimensions: {example(wrong_depth, 'segment_key', 'slice_depth')}")
    if n["separator"]:
        faults.append(f"a dimension value holds the separator of keys: {example(unsafe, 'segment_key')}")
    written = written.drop(_BAD)
    dates: list[int] = []
    if not n["numbers"]:
        twice = written.groupBy("segment_id", "cal_date").count().where("count > 1").limit(EXAMPLES).collect()
        if twice:
            faults.append(f"duplicate rows of a segment and date: {[(r['segment_id'], r['cal_date']) for r in twice]}")
        of_total = F.col("slice_depth") == 0
        layer = written.groupBy("cal_date").agg(F.count_if(of_total).alias("n"), F.sum(F.when(of_total, F.col("gmv"))).alias("total")).collect()  # a row a date
        dates = sorted(r["cal_date"] for r in layer if r["n"])
        faults += _calendar_faults(dates, layer, weeks, period)
    if faults:
        raise ValueError("; ".join(faults))
    return written, list(dims), dates


def _calendar_faults(dates: list[int], layer: list, weeks: int, period: str) -> list[str]:
    if not dates:
        return ["there is no total layer (slice_depth 0)"]
    faults = []
    if len(dates) < LEAST_DATES:
        faults.append(f"the calendar has {len(dates)} dates; at least {LEAST_DATES} are needed")
    if steps := sorted({b - a for a, b in zip(dates, dates[1:])} - {7 * weeks}):
        faults.append(f"calendar steps of {steps} days; {period} expects {7 * weeks}")
    if low := sorted(r["cal_date"] for r in layer if r["n"] and not r["total"] > 0):
        faults.append(f"the total is not positive on {low}")
    if orphan := sorted(r["cal_date"] for r in layer if not r["n"])[:EXAMPLES]:
        faults.append(f"dates without a total: {orphan}")
    return faults
