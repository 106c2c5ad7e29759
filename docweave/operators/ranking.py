"""Running sums and ranks that need no single task where there is no key to partition by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def running(df: DataFrame, value: Column, order: list[Column], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the sum of value up to and with each row, in the given order, in each group of `by`.

    Without `by` rows are sorted by ranges, the ranges' sums are summed up, and added to the sums inside: the order has
    to end in a unique key, or rows that tie meet in one task.
    """
    if by:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    ranged = written(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("__s"))  # a row a range
    sums = sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__base"))
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(sums), "__part").withColumn(out, F.col("__base") + inside).drop("__v", "__part", "__base")


def numbered(df: DataFrame, order: list[Column], out: str, by: Sequence[str] = (), kind: str = "int") -> DataFrame:
    """Adds the rank from 1 in the given order, in each group of `by`. Ranks over tables of any size are longs (kind)."""
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return running(df, F.lit(1).cast("long"), order, out).withColumn(out, F.col(out).cast(kind))


def numbered_in(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """As numbered, where a group of `by` may hold a third of all rows: ranks over all rows less those of the groups before."""
    every = written(numbered(df, [*map(F.col, by), *order], "__g", kind="long"))
    first = every.groupBy(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by))).agg(F.min("__g").alias("__first"))
    joined = every.join(first, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)])
    return joined.select(*df.columns, (F.col("__g") - F.col("__first") + 1).alias(out))
