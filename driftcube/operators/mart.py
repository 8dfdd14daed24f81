"""From transactions to the cube: complete windows, top-N buckets, all grouping sets, ratios."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftcube.config import ADDITIVE, DIMENSIONS, RATIOS
from driftcube.functions.keys import clean_dimension, depth, segment_id, segment_key, segment_level
from driftcube.operators.ranks import with_rank
from driftcube.storage import stage

#: Parameters of the mart: windows kept, brands kept by name, name of the rest and of values that are not known.
WINDOWS, TOP, OTHER, UNKNOWN = 13, 5, "Other", "Unknown"
#: Amounts are summed as integers of this fraction, so sums do not depend on their order.
UNIT = 10_000


def period_to_weeks(period: str) -> int:
    """``4W`` -> 4."""
    if not (m := re.fullmatch(r"([1-9][0-9]*)W", period.strip().upper())):
        raise ValueError(f"period {period!r}: expected <N>W")
    return int(m[1])


def _known(name: str) -> Column:
    """A dimension's value; null and blank become UNKNOWN, so that null is left to what is rolled up."""
    return F.coalesce(clean_dimension(F.col(name)), F.lit(UNKNOWN))


def sales_days(spark: SparkSession, sf_dir: str) -> tuple[int, int] | None:
    """First and last day of the sales, since the epoch; a scan of one column."""
    day = F.unix_date(F.to_date("l_shipdate"))
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
    return None if found["first"] is None else (found["first"], found["last"])


def transactions(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """One row a sale: day (since the epoch), amount in 1/UNIT, order, user, merchant and the raw dimensions.

    ``since`` is the first day that is read; it reaches the scan of the sales.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem")
    if since is not None:
        line = line.where(F.col("l_shipdate") >= F.lit(datetime(1970, 1, 1) + timedelta(days=since)).cast("timestamp_ntz"))
    line = line.select(
        F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))).alias("amount"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("merchant_id"),
        "l_partkey",
        _known("l_returnflag").alias("is_terminal_or_cpqr"),
    )
    place = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", _known("r_name").alias("geo"))
    users = read("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "geo")
    orders = read("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    parts = read("part").select("p_partkey", _known("p_type").alias("products"), _known("p_brand").alias("brand"))
    return (
        line.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("order_id") == F.col("o_orderkey"))
        .join(users, F.col("user_id") == F.col("c_custkey"))
        .select("day", "amount", "order_id", "user_id", "merchant_id", "geo", "products", "brand", "is_terminal_or_cpqr")
    )


def complete_windows(sales: DataFrame, period: str | Sequence[str] = "13W", windows: int = WINDOWS, days: tuple[int, int] | None = None) -> DataFrame:
    """``sales`` with ``period``, ``idx`` (0: current) and ``cal_date`` (last day) of windows that lie wholly in the data.

    Windows are anchored at the last day.  Of several periods a sale gets a row
    for each that has a window for its day.  ``days`` are the data's first and
    last day; without them ``sales`` is read for them first.
    """
    if days is None:
        found = sales.agg(F.min("day"), F.max("day")).first()
        days = (found[0], found[1]) if found[0] is not None else (0, 0)
    first, last = days

    def window(period: str) -> Column:
        span = 7 * period_to_weeks(period)
        idx = F.floor((last - F.col("day")) / span).cast("long")
        complete = (idx < windows) & (last - span * idx - (span - 1) >= first)
        return F.when(complete, F.struct(F.lit(period).alias("period"), idx.alias("idx"), (last - span * idx).alias("cal_date")))

    periods = _periods(period)
    if len(periods) == 1:
        rows = sales.withColumn("__window", window(periods[0])).where("__window is not null")
    else:
        rows = sales.withColumn("__window", F.explode(F.array_compact(F.array(*map(window, periods)))))
    return rows.select(*sales.columns, "__window.period", "__window.idx", "__window.cal_date")


def _periods(period: str | Sequence[str]) -> list[str]:
    """The periods in upper case, each once."""
    return list(dict.fromkeys(p.strip().upper() for p in ([period] if isinstance(period, str) else period)))


def windowed_sales(spark: SparkSession, sf_dir: str, period: str | Sequence[str] = "13W", windows: int = WINDOWS) -> DataFrame:
    """The sales of the complete windows of one or several periods, by one scan that reads no older days."""
    days = sales_days(spark, sf_dir)
    if days is None:
        return complete_windows(transactions(spark, sf_dir), period, windows)
    longest = max(7 * period_to_weeks(p) for p in _periods(period))
    since = max(days[0], days[1] - windows * longest + 1)
    return complete_windows(transactions(spark, sf_dir, since), period, windows, days)


def top_brands(rows: DataFrame, top: int = TOP) -> DataFrame:
    """(period, brand, amount, rank) of each period's largest by amount over its complete windows but the current one.

    Ranks are cut to ``top`` before the shuffle, so a period's brands never meet in one task.
    """
    sums = rows.where("idx >= 1").groupBy("period", "brand").agg(F.sum("amount").alias("amount"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.col("amount").desc(), "brand"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top)


def bucketed(rows: DataFrame, top: int = TOP) -> DataFrame:
    """``rows`` with ``merchants_type``: the brand if among its period's top, else OTHER. At most ``top`` rows a period are broadcast."""
    named = stage(top_brands(rows, top).select(F.col("period").alias("__p"), F.col("brand").alias("b")), "top")  # once, however often the rows are read
    joined = rows.join(F.broadcast(named), (F.col("period") == F.col("__p")) & (F.col("brand") == F.col("b")), "left")
    return joined.withColumn("merchants_type", F.coalesce("b", F.lit(OTHER))).drop("__p", "b", "brand")


#: Values of the dimensions up to which they are numbered by the driver and broadcast; beyond it they are ranked and joined by shuffles.
BROADCAST_VALUES = 100_000
#: Values of one dimension up to which they stand in the plan as a list, which needs no join.
LITERAL_VALUES = 64
#: What is counted apart, and of what.
DISTINCT = {"tx": "order_id", "au": "user_id", "am": "merchant_id"}


@dataclass
class _Codes:
    """The codes of a dimension, from 1: a literal list of few values, else a table (value, code)."""

    column: str
    n: int
    values: list | None = None
    table: DataFrame | None = None

    def coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the code of its column as ``c_`` and the name."""
        if self.values is not None:
            known = [v for v in self.values if v is not None]
            code = F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), F.col(self.column).cast("string")) + (len(self.values) - len(known))
            return df.withColumn(f"c_{self.column}", F.when(F.col(self.column).isNull(), 1).otherwise(code).cast("long"))
        table = self.table.select(F.col("value").alias("__value"), F.col("code").alias(f"c_{self.column}"))
        return df.join(table, F.col(self.column).eqNullSafe(F.col("__value"))).drop("__value")

    def named(self, df: DataFrame, code: Column) -> DataFrame:
        """``df`` with the value of a code as the column; null for code 0."""
        if self.values is not None:
            return df.withColumn(self.column, F.get(F.array(*map(F.lit, self.values)).cast("array<string>"), (code - 1).cast("int")))
        return df.join(self.table.select(F.col("value").alias(self.column), F.col("code").alias("__code")), code == F.col("__code"), "left").drop("__code")


def _codes(sums: DataFrame, columns: tuple[str, ...]) -> dict[str, _Codes]:
    """The codes of the values of each column, a null one's first."""
    listed = sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))).alias("x")).select("x.*").distinct()
    found = sorted(listed.limit(BROADCAST_VALUES + 1).collect(), key=lambda r: (r["dim"], r["value"] is not None, r["value"]))  # bounded
    out = {}
    if len(found) <= BROADCAST_VALUES:
        for i, c in enumerate(columns):
            values = [r["value"] for r in found if r["dim"] == i]
            if len(values) <= LITERAL_VALUES:
                out[c] = _Codes(c, len(values), values=values)
            else:
                out[c] = _Codes(c, len(values), table=F.broadcast(sums.sparkSession.createDataFrame([(v, n) for n, v in enumerate(values, 1)], "value string, code long")))
        return out
    ranked = stage(with_rank(listed, [F.col("dim"), F.col("value")], "no"), "codes")
    firsts = {r["dim"]: (r["first"], r["n"]) for r in ranked.groupBy("dim").agg(F.min("no").alias("first"), F.count("*").alias("n")).collect()}  # a row a column
    for i, c in enumerate(columns):
        first, n = firsts.get(i, (1, 0))
        out[c] = _Codes(c, n, table=ranked.where(F.col("dim") == i).select("value", (F.col("no") - first + 1).cast("long").alias("code")))
    return out


def cube(rows: DataFrame, period: str = "13W", dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The mart: every combination of dimensions by period and window, with additive measures and ratios.

    ``rows`` without a ``period`` are of the one given.  Values become codes
    and a combination one number, 0 in the place of a rolled-up dimension.
    Amounts are summed by atom before the grouping sets expand.  Ids are
    reduced to one row for each window and atom, so one id in a third of all
    rows is no more than its atoms, and dealt by window and id: what an id
    expands to is told apart where it lies, and only counts are shuffled on.
    """
    if "period" not in rows.columns:
        rows = rows.withColumn("period", F.lit(period))
    rows = rows.withColumn("window", F.concat_ws("|", "period", "cal_date"))
    sums = stage(rows.groupBy("window", *dims).agg(F.sum("amount").alias("amount")), "amounts")
    lists, strides, stride = _codes(sums, ("window", *dims)), {}, 1
    for d in dims:
        strides[d] = stride, lists[d].n + 1
        stride *= lists[d].n + 1
    if stride >= 1 << 62:
        raise ValueError("the dimensions have too many combinations to be numbered")

    def coded(df: DataFrame, *columns: str) -> DataFrame:
        for codes in lists.values():
            df = codes.coded(df)
        atom = sum((F.col(f"c_{d}") * F.lit(strides[d][0]) for d in dims), F.lit(0).cast("long"))
        return df.select(F.col("c_window").alias("window"), atom.alias("atom"), *columns)

    places = [_digit(F.col("atom"), low, n) * low for low, n in strides.values()]
    masked = F.array(*(sum((p for p, keep in zip(places, how) if keep), F.lit(0).cast("long")) for how in product((True, False), repeat=len(dims))))
    expanded = F.explode(masked).alias("combination")

    totals = coded(sums, "amount").select("window", "amount", expanded).groupBy("window", "combination").agg(F.sum("amount").alias("amount"))
    ids = F.explode(F.array(*(F.struct((F.col("window") * len(DISTINCT) + i).alias("of"), F.col(c).alias("id")) for i, c in enumerate(DISTINCT.values())))).alias("x")
    found = coded(rows, *DISTINCT.values()).select("atom", ids).select("x.of", "x.id", "atom").where("id is not null").distinct()
    found = found.repartition("of", "id").select("of", "id", expanded).distinct()  # no shuffle of its own
    number = lambda i: F.count_if(F.col("of") % len(DISTINCT) == i).cast("double")
    counts = found.groupBy(F.call_function("div", F.col("of"), F.lit(len(DISTINCT))).alias("window"), "combination").agg(*(number(i).alias(name) for i, name in enumerate(DISTINCT)))
    out = totals.join(counts, ["window", "combination"], "left").fillna(0.0, list(DISTINCT))
    for d in dims:
        out = lists[d].named(out, _digit(F.col("combination"), *strides[d]))
    out = lists["window"].named(out.withColumnRenamed("window", "__no"), F.col("__no"))
    place = {"period": F.substring_index("window", "|", 1), "cal_date": F.substring_index("window", "|", -1).cast("long")}
    out = out.withColumns(place).withColumn("gmv", F.col("amount") / UNIT)
    return with_ratios(out.select("period", "cal_date", depth(dims).alias("slice_depth"), *dims, *ADDITIVE))


def _digit(number: Column, low: int, n: int) -> Column:
    """One place of a mixed-radix number: ``number div low % n``."""
    return F.call_function("div", number, F.lit(low)) % n


def with_ratios(df: DataFrame) -> DataFrame:
    """aov, tpm and freq; null, never 0, where the denominator is 0."""
    return df.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in RATIOS.items()})


def with_segment(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    return df.withColumns({"segment_id": segment_id(dims), "segment_key": segment_key(dims), "segment_level": segment_level(dims)})


def with_share_of_total(history: DataFrame) -> DataFrame:
    """``history`` with ``share_in_total_gmv``: of the window's total; a window is one row of totals."""
    keys = [c for c in ("period", "cal_date") if c in history.columns]
    total = history.where("slice_depth = 0").select(*keys, F.col("gmv").alias("__total"))
    return history.join(F.broadcast(total), keys).withColumn("share_in_total_gmv", F.try_divide("gmv", "__total")).drop("__total")


def save_mart(history: DataFrame, path: str) -> None:
    """Replace the stored mart, one folder a window."""
    history.write.mode("overwrite").partitionBy("cal_date").parquet(path)


def window_digests(rows: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(period, cal_date, rows, sum, mix): what tells whether the bucketed sales of a window have changed, in whatever order they come."""
    one = F.xxhash64("amount", *DISTINCT.values(), *dims)
    other = F.xxhash64(F.lit("other"), "amount", *DISTINCT.values(), *dims)
    return rows.groupBy("period", "cal_date").agg(F.count("*").alias("rows"), F.sum(one.cast("decimal(20,0)")).cast("string").alias("sum"), F.bit_xor(other).alias("mix"))


def refresh_mart(rows: DataFrame, path: str, dims: tuple[str, ...] = DIMENSIONS) -> list[tuple[str, int]]:
    """Bring the mart stored at ``path`` up to ``rows``, the bucketed sales of all its windows; the (period, cal_date) that were written.

    A digest of each window's sales is stored beside the mart.  Only windows
    whose digest is new or another are cubed and overwritten, by dynamic
    partition overwrite; windows that ``rows`` no longer hold are removed.
    Buckets are part of the digest, so a brand that enters the top renews what
    it touches.  Digests are written last: a refresh that was cut off is done
    anew by the next one.  Without a stored mart all windows are written.
    """
    spark, digests = rows.sparkSession, f"{path}_digests"
    rows = stage(rows, "bucketed")
    now = stage(window_digests(rows, dims), "digests")
    keys = ["period", "cal_date"]
    if _exists(spark, digests) and _exists(spark, path):
        held = spark.read.parquet(digests)
        changed = now.join(held, now.columns, "left_anti").select(*keys)
        gone = [tuple(r) for r in held.join(now, keys, "left_anti").select(*keys).collect()]  # windows are few
    else:
        changed, gone = now.select(*keys), []
    changed = stage(changed, "changed")
    written = sorted(tuple(r) for r in changed.collect())
    if written:
        new = cube(rows.join(F.broadcast(changed), keys, "left_semi"), dims=dims)
        new.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    for period, cal_date in gone:
        _remove(spark, f"{path}/period={period}/cal_date={cal_date}")
    if written or gone:
        now.coalesce(1).write.mode("overwrite").parquet(digests)
    return written


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)
