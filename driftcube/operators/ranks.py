"""Global ranks and numbers without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftcube.storage import stage

#: Columns that a result does not have.
_PART, _PLACE = "__part", "__place"


def with_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the order of ``order``.

    Rows are dealt into ranges of the order and numbered in each; what the
    ranges before a row's own hold is added.  Rows that tie fall into one range
    and get places of their own in an order that a rerun may change, so
    ``order`` should tell all rows apart.  Nulls come as the order has them.
    The ranges are a staged table: which row is in which does not change.  The
    driver sees one number of rows a range.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parted = stage(df.repartitionByRange(*columns).withColumn(_PART, F.spark_partition_id()), "ranges")
    sizes = sorted((r[_PART], r["count"]) for r in parted.groupBy(_PART).count().collect())  # a row a range
    before, upto = {}, 0
    for part, n in sizes:
        before[part] = upto
        upto += n
    inner = F.row_number().over(Window.partitionBy(_PART).orderBy(*columns)).cast("long")
    if not before:
        return parted.drop(_PART).withColumn(name, F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(list(before.items()), f"{_PART} int, __before long")
    rows = parted.withColumn(_PLACE, inner).join(F.broadcast(offsets), _PART)
    return rows.withColumn(name, F.col(_PLACE) + F.col("__before")).drop(_PART, _PLACE, "__before")
