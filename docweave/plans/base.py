"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew if the input has fewer splits than there are cores, for queries that do much with each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
