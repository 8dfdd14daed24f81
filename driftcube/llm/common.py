"""What the operators of this subpackage share: shared storage, shipping code, mapping over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftcube.storage import release, shared_dir, ship, stage

#: Rows and bytes of one Arrow batch: a batch of very long texts must fit a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, "16m"


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, and bound the Arrow batches of its session by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark)


def with_columns_mapped(
    df: DataFrame,
    fields: list[T.StructField],
    rows: Callable[[], Callable[[list], tuple]],
    of: str,
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``fields`` made from column ``of`` by ``mapInArrow``.

    ``rows()`` runs once per task and gives a function from a batch's values to
    one list (or array) per field.  A column of ``df`` named like a field is
    replaced; those in ``drop`` don't come back from Python.
    """
    names = {*(f.name for f in fields), *drop}
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    made = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = rows()
        for batch in batches:
            out = function(batch.column(of).to_pylist())
            new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, made)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *new], names=[*kept, *made.names]
            )

    return df.select(*{c: 0 for c in [*kept, of]}).mapInArrow(run, schema)


def text_of(column: str = "text") -> F.Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> F.Column:
    """A hash by which equal texts meet; a null text counts as empty."""
    return F.xxhash64(text_of(column))


def with_running_sum(df: DataFrame, keys: list[str], order: list, value: Column | str, bucket: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of equal ``keys`` before a row, by (bucket, order).

    ``bucket`` is an integer of bounded range.  Sums are accumulated over
    (keys, bucket) first and inside each then, so no task orders all rows of a
    key.  ``df`` is read twice and should be a staged table.
    """
    df = df.withColumn("__b", bucket)
    value = F.expr(value) if isinstance(value, str) else value
    parts = df.groupBy(*keys, "__b").agg(F.sum(value).alias("__w"))
    before = F.sum("__w").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__b").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.sum(value).over(Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    on = F.col("__b") == F.col("__p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    total = F.col("__before") + F.coalesce(F.col("__inner"), F.lit(0))
    joined = df.withColumn("__inner", inner).join(parts, on).withColumn(name, total)
    return joined.drop("__b", "__p", "__before", "__inner", *(f"__k_{k}" for k in keys))


__all__ = ["prepare", "release", "shared_dir", "stage", "text_key", "text_of", "with_columns_mapped", "with_running_sum"]
