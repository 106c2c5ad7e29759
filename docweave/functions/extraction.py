"""Rows of extracted text: entity and relation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import COMPLETION_MARKER, TUPLE_DELIMITER
from .names import entity_type, is_good_name, path_reason, quality_reason, short_identifier
from .text import is_float, let, normalize_name, repair_delimiters, sanitize, split_markers, strip

_D = TUPLE_DELIMITER


def record_fields(text: Column) -> Column:
    """array<array<string>>: the non-blank fields of each record of an answer, delimiters repaired.

    Records end at a line's end or the completion marker; records that run together are cut where one starts.
    """
    lines = split_markers(text, ["\n", COMPLETION_MARKER, COMPLETION_MARKER.lower()])
    # A part behind a cut gets its head again, but not a whole delimiter; one that had no head has a field too few then.
    entities = F.flatten(F.transform(lines, lambda x: split_markers(x, [f"{_D}entity{_D}"])))
    headed = F.transform(entities, lambda x: F.when(x.startswith("entity") | x.startswith("relation"), x).otherwise(F.concat(F.lit("entity<|"), x)))
    relations = F.flatten(F.transform(headed, lambda x: split_markers(x, [f"{_D}relationship{_D}", f"{_D}relation{_D}"])))
    records = F.transform(relations, lambda x: F.when(x.startswith("entity") | x.startswith("relation"), x).otherwise(F.concat(F.lit(f"relation{_D}"), x)))
    return F.transform(records, lambda x: split_markers(repair_delimiters(strip(x)), [_D]))


def records(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row a record: record_order and fields. Keys of df stay; the text doesn't."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(record_fields(F.col(text))).alias("record_order", "fields"))


def entities(df: DataFrame, entities_in_text: bool = False) -> DataFrame:
    """Entity rows of records(): four fields, a good name, a valid type, a description."""
    f = F.col("fields")
    clean = lambda c, q=False: normalize_name(sanitize(c, entities_in_text), q)
    df = df.where((F.size(f) == 4) & F.contains(F.get(f, F.lit(0)), F.lit("entity")))
    df = df.withColumn("entity_name", short_identifier(clean(f[1], True))).withColumn("entity_type", entity_type(clean(f[2], True))).withColumn("description", clean(f[3]))
    fine = F.struct("entity_name", "entity_type", "description")
    good = let(fine, lambda x: (x["entity_name"] != "") & is_good_name(x["entity_name"]) & x["entity_type"].isNotNull() & (x["description"] != ""))
    return df.where(good).drop("fields")


def relations(df: DataFrame, entities_in_text: bool = False) -> DataFrame:
    """Relation rows of records(): five fields, two good, different names. The weight is the last field if it is a number, else 1."""
    f = F.col("fields")
    clean = lambda c, q=False: normalize_name(sanitize(c, entities_in_text), q)
    df = df.where((F.size(f) == 5) & F.contains(F.get(f, F.lit(0)), F.lit("relation")))
    df = df.withColumn("src_id", short_identifier(clean(f[1], True))).withColumn("tgt_id", short_identifier(clean(f[2], True)))
    df = df.withColumn("keywords", F.translate(clean(f[3], True), "，", ",")).withColumn("description", clean(f[4]))
    last = F.regexp_replace(f[4], "^[\"']+|[\"']+$", "")
    df = df.withColumn("weight", F.when(is_float(last), F.expr("try_cast(regexp_replace(fields[4], '^[\"\\']+|[\"\\']+$', '') as double)")).otherwise(F.lit(1.0)))
    good = lambda c: let(F.col(c), lambda x: (x != "") & is_good_name(x))
    return df.where(good("src_id") & good("tgt_id") & (F.col("src_id") != F.col("tgt_id"))).drop("fields")


def gleaned(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Records of a second extraction take a key's place only if its first description is strictly longer; new keys are added."""
    def lead(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by(F.length("description"), "record_order").alias("size"))

    chosen = lead(first).alias("a").join(lead(second).alias("b"), keys, "full").select(*keys, F.coalesce(F.col("b.size") > F.col("a.size"), F.col("b.size").isNotNull()).alias("later"))
    return first.join(chosen.where(~F.col("later")).drop("later"), keys).unionByName(second.join(chosen.where("later").drop("later"), keys))


def best_answers(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of a key's records from several answers of one chunk, those of the answer whose first description is longest, the earliest of those tied."""
    lead = df.groupBy(*keys, order).agg(F.min_by(F.length("description"), "record_order").alias("__size"))
    chosen = lead.groupBy(*keys).agg(F.max_by(order, F.struct("__size", -F.col(order))).alias(order))
    return df.join(chosen, [*keys, order], "left_semi")


__all__ = ["best_answers", "entities", "gleaned", "path_reason", "quality_reason", "record_fields", "records", "relations"]
