"""Operator 2, sharding by proportional stratified interleaving. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, md5_bucket, prefix, text_or_empty

SHARDS, SEED = 16, 17


def interleave(df: DataFrame, stratum: str, row_id: str, shards: int, seed: int = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard (int, 0 to shards-1) and slot (long, gapless from 0 in each shard) so that every shard matches the mixture.

    Rows are ranked in their stratum by a seeded shuffle key (md5 of seed and row id), sorted over all strata by
    fractional rank (rank + 1/2) / size, and the sequence is cut into runs whose lengths are at most one apart.
    Two shuffles of the given columns; both ranks go through buckets of about 256 rows, so neither a hot stratum nor
    the global order meets in one task. A null stratum is a stratum of its own, null ids share one key. Rows with equal
    id are ordered by `ties`; rows equal in all of these are interchangeable. An empty table gives an empty table.
    Columns of df named shard or slot, or one of the helpers __s, __k, __r, __n, __b, __f, __c, __g, are overwritten.
    """
    rows = df.count()
    buckets = bucket_count(rows)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))
    df = df.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit(""))).withColumn("__k", key)
    df = df.withColumn("__b", md5_bucket(F.col("__k"), buckets))
    tied = [F.col("__k"), F.col(row_id), *map(F.col, ties)]
    df = prefix(df, ["__s"], "__b", tied, F.lit(1), "__r", total="__n").drop("__b")
    df = df.withColumn("__f", (2 * F.col("__r") + 1).cast("double") / (2 * F.col("__n")).cast("double"))
    df = df.withColumn("__c", F.least(F.floor(F.col("__f") * buckets), F.lit(buckets - 1)).cast("int"))
    df = prefix(df, [], "__c", [F.col("__f"), F.col("__s"), *tied], F.lit(1), "__g")
    df = df.withColumn("shard", F.floor(F.col("__g") * shards / F.lit(max(rows, 1))).cast("int") if rows * shards < 2**52 else F.expr(f"cast(cast(__g as decimal(38)) * {shards} div {max(rows, 1)} as int)"))
    first = F.expr(f"cast(ceil(cast(shard as decimal(38)) * {rows} / {shards}) as bigint)")
    return df.withColumn("slot", F.col("__g") - first).drop("__s", "__k", "__r", "__n", "__f", "__c", "__g")


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents under the law `rows`: counts at most one apart, each shard with the sources' mixture.

    Groups of equal texts are not kept together: a group of a third of all rows could not be, under this law.
    Null text: size 1, crc32 0. doc_ids that repeat, null doc_ids and null sources keep all their rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_or_empty()
    df = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    df = interleave(df, "source", "doc_id", SHARDS, ties=("size", "text_crc32"))
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
