"""Operator 1, mixing sources to target weights: temperature mixing with budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count, md5_bucket, prefix, text_or_empty, written

#: Production parameters: no source is passed over more than twice as often as the largest; tokens of an output block.
MAX_EPOCHS, BLOCK_TOKENS, SEED, STEPS = 2.0, 1 << 18, 23, 60
#: Source totals up to this many are handled on the driver; beyond it every step of the bisection is a Spark aggregate.
DRIVER_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(text: str = "text") -> Column:
    """Words of a text and one end token, so that an empty or null text counts as one."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long") + 1


def bisect(holds: Callable[[float], bool], steps: int = STEPS) -> float:
    """The least exponent in [0, 1], to 2^-steps, that holds.

    holds is false for small exponents and true from some exponent on, at 1 in any case.
    """
    low, high = 0.0, 1.0
    if holds(0.0):
        return 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent(totals: DataFrame, max_epochs: float | None = None, entropy: float | None = None) -> float:
    """The temperature exponent for a repetition limit or a target entropy (nats) of the weights share^exponent.

    The smallest exponent (the flattest mixture) that keeps every source within max_epochs passes while the largest has
    one pass; or the smallest exponent whose entropy is at most the target (1 if even the natural mixture has more).
    """
    if (max_epochs is None) == (entropy is None):
        raise ValueError("give max_epochs or entropy")
    if max_epochs is not None:
        if max_epochs < 1:
            raise ValueError("max_epochs is below 1")
        low, high = totals.agg(F.min("total"), F.max("total")).first()
        return 1.0 if not low else bisect(lambda a: (high / low) ** (1 - a) <= max_epochs)
    few = [r[0] for r in totals.select("total").limit(DRIVER_SOURCES + 1).collect()]
    if not few:
        return 1.0
    top = max(few) if len(few) <= DRIVER_SOURCES else totals.agg(F.max("total")).first()[0]

    def spread(a: float) -> float:
        if len(few) <= DRIVER_SOURCES:
            z = math.fsum((x / top) ** a for x in few)
            s = math.fsum((x / top) ** a * math.log(x / top) for x in few)
        else:
            x = F.col("total") / F.lit(float(top))
            z, s = totals.agg(F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.log(x))).first()
        return math.log(z) - a * s / z

    return 1.0 if spread(1.0) > entropy else bisect(lambda a: spread(a) <= entropy)


def budgets(df: DataFrame, max_epochs: float | None = None, entropy: float | None = None) -> DataFrame:
    """One row a source (__s): total tokens and budget, from rows with __s and tokens.

    Normalised weights are share^exponent / sum; their scale is the least at which each source gets one pass at least,
    so that mixing repeats rows but loses none.
    """
    totals = df.groupBy("__s").agg(F.sum("tokens").alias("total"))
    a = exponent(totals, max_epochs, entropy)
    top = totals.agg(F.max("total")).first()[0] or 1
    passes = F.pow(F.lit(float(top)) / F.col("total"), F.lit(1.0 - a))
    return totals.withColumn("budget", F.greatest("total", F.floor(F.round(F.col("total") * passes, 3))).cast("long"))


def keyed(df: DataFrame, seed: int) -> DataFrame:
    """Adds the shuffle key of a row in its epoch, as __k."""
    return df.withColumn("__k", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def draws(df: DataFrame, max_epochs: float | None = None, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """Each row of df (doc_id, source, tokens > 0) once for every pass that reaches it: epoch, __before, __budget, __k.

    A pass of a source is a permutation by a key of seed, epoch and doc_id; __before counts the tokens that its source
    has given before, over all passes, and a draw is made while that is under the source's budget.
    """
    df = df.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    buckets = bucket_count(df.count())
    by = budgets(df, max_epochs, entropy).select("__s", F.col("total").alias("__total"), F.col("budget").alias("__budget"))
    df = df.join(F.broadcast(by) if by.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES else by, "__s")
    df = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__budget") / F.col("__total")) - 1).cast("int"))))
    df = keyed(df, seed).withColumn("__b", md5_bucket(F.col("__k"), buckets))
    df = prefix(df, ["__s", "epoch"], "__b", [F.col("__k"), F.col("doc_id"), F.col("tokens")], F.col("tokens"), "__p").drop("__b")
    return df.withColumn("__before", F.col("__p") + F.col("epoch") * F.col("__total")).where("__before < __budget")


def mixed(df: DataFrame, max_epochs: float | None = None, entropy: float | None = None, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture of df (doc_id, source, tokens) as blocks: doc_id, source, tokens, epoch, block, slot.

    Each block gets of every source the share that its weight gives; in a block the draws are permuted by a seeded key,
    slots are gapless from 0. A null source is a source of its own. Equal doc_ids keep all their rows; their order is
    that of their tokens. An empty table gives no rows.
    """
    all_tokens = budgets(df.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))), max_epochs, entropy).agg(F.sum("budget")).first()[0] or 1
    blocks = max(1, math.ceil(all_tokens / block_tokens))
    d = draws(df, max_epochs, entropy, seed)
    d = d.withColumn("block", F.least(F.floor(F.col("__before").cast("double") / F.col("__budget").cast("double") * blocks), F.lit(blocks - 1)).cast("long"))
    d = d.withColumn("__o", F.md5(F.concat(F.lit("slot:"), F.col("__k"))))
    over = Window.partitionBy("block").orderBy("__o", "doc_id", "epoch", "source", "tokens")
    return d.select("doc_id", "source", "tokens", "epoch", "block", (F.row_number().over(over) - 1).cast("long").alias("slot"))


def mix_documents(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mixture draws it, all columns kept.

    A pass that the budget cuts short is a prefix of its source's permutation, so the last key drawn in each source and
    pass says which rows it has: texts are not shuffled. Rows of one doc_id, or without one, have one key in a source, so
    all of them are drawn with the last. Null texts count one token, an empty table gives no rows.
    """
    names = docs.columns
    small = written(docs.select("doc_id", "source", tokens_of().alias("tokens")))
    last = draws(small, max_epochs, seed=seed).groupBy("__s", "epoch").agg(F.max("__k").alias("__last"))
    last = last.withColumnRenamed("epoch", "__e")
    last = F.broadcast(last) if last.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES else last
    rows = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row")
    df = docs.select(rows, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("__s"), "doc_id").join(last, "__s")
    df = keyed(df.withColumnRenamed("__e", "epoch"), seed).where("__k <= __last")
    return df.select("__row.*")


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed over their sources with at most two passes a source, in blocks of 2^18 tokens (words and ends)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(written(docs.select("doc_id", "source", tokens_of().alias("tokens"))), MAX_EPOCHS)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens
  FROM documents),
t AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY s),
m AS (SELECT min(total)::DOUBLE AS lo, max(total)::DOUBLE AS hi FROM t),
b(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN hi / lo <= 2.0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END FROM m
  UNION ALL
  SELECT step + 1,
         CASE WHEN pow(hi / lo, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(hi / lo, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM b, m WHERE step < 60),
e AS (SELECT high AS a FROM b WHERE step = 60),
g AS (SELECT s, total, greatest(total, CAST(floor(round(total * pow(hi / total, 1.0 - a), 3)) AS BIGINT)) AS budget FROM t, m, e),
n AS (SELECT greatest(1, CAST(ceil(sum(budget) / 262144.0) AS BIGINT)) AS blocks FROM g),
x AS (SELECT d.*, total, budget, unnest(range(CAST(ceil(budget / total) AS BIGINT))) AS epoch FROM d JOIN g USING (s)),
k AS (SELECT *, md5('23:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM x),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY s, epoch ORDER BY k, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens + epoch * total AS before FROM k),
q AS (SELECT *, CAST(least(floor(before::DOUBLE / budget::DOUBLE * blocks), blocks - 1) AS BIGINT) AS block FROM p, n WHERE before < budget)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY md5('slot:' || k), doc_id, epoch, source, tokens) - 1 AS BIGINT) AS slot
FROM q
"""
