"""What the operators of this package share: bucketed ranks, text columns, memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.scratch import release, written

#: Rows that a bucket of a two-level rank holds on average, and the most buckets there are.
BUCKET_ROWS, MAX_BUCKETS = 256, 65536

BATCH_ROWS = 1000

def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python a thousand at a time at most: both sides hold a batch or two in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bucket_count(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))


def md5_bucket(key: Column, buckets: int) -> Column:
    """The bucket of an md5 key in hex; buckets follow the order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2.0**32)).cast("int")


def prefix(df: DataFrame, groups: list[str], bucket: str, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Adds the sum of value over the rows before each row of its group, and the group's total if asked for.

    bucket is an integer column that follows the order, so a group is never gathered in one task: bucket sums are
    taken first (with partial sums on the map side), summed up over the few buckets, and added to the sums in a bucket.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("__sum"))
    over = Window.partitionBy(*groups).orderBy(bucket) if groups else Window.orderBy(bucket)
    sums = sums.withColumn("__base", F.sum("__sum").over(over) - F.col("__sum"))
    if total:
        sums = sums.withColumn(total, F.sum("__sum").over(Window.partitionBy(*groups)))
    sums = sums.drop("__sum")
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(sums, [*groups, bucket])
    return df.withColumn(out, F.col("__base") + F.sum(value).over(inside) - value).drop("__base")


def trim() -> None:
    """Gives memory that a worker has freed back to the system; workers live on, and an executor's memory is for all."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group, its memory given back after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    return run


def tidy2(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As tidy, of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        trim()
        return out

    return run


__all__ = ["bucket_count", "md5_bucket", "prefix", "release", "small_batches", "text_bytes", "text_or_empty", "tidy", "tidy2", "trim", "written"]
