"""Keyed tables: upserts, deletes, status tables, pages of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SORTS = ("created_at", "updated_at", "id", "file_path")


def missing_keys(keys: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Keys that are not stored."""
    return keys.select(key).distinct().join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of new replace those of their key; of several new ones, the last by version. create_time stays as it was."""
    if version:
        last = Window.partitionBy(*key).orderBy(F.desc(version))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    if "create_time" in stored.columns and "create_time" in new.columns:
        new = new.join(stored.select(*key, F.col("create_time").alias("__c")), key, "left").withColumn("create_time", F.coalesce("__c", "create_time")).drop("__c")
    return stored.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_columns(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """As upsert, but columns that new leaves null, or lacks, keep their stored value."""
    names = [*stored.columns, *(c for c in new.columns if c not in stored.columns)]
    n = new.select(*key, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in key))
    value = lambda c: F.coalesce(*([F.col(f"__{c}")] if c in new.columns else []), *([F.col(c)] if c in stored.columns else [])).alias(c)
    return stored.join(n, key, "full").select(*(F.col(c) if c in key else value(c) for c in names))


def delete(stored: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows a status, and of `all`."""
    return df.rollup(status).agg(F.count("*").alias("n"), F.grouping(status).alias("__g")).select(F.when(F.col("__g") == 1, "all").otherwise(F.col(status)).alias("status"), "n")


def collated(c: Column, locale: str | None) -> Column:
    """A text that sorts as a language has it (`zh`: by the sound of its characters; `de`, ...); without one by its bytes."""
    return c if locale is None else F.collate(c, locale)


def page(df: DataFrame, page_no: int = 1, size: int = 50, sort: str = "updated_at", descending: bool = True, status: str | None = None, row_id: str = "id", locale: str | None = None) -> DataFrame:
    """A page with the total; numbers out of range and unknown sorts fall back: page 1 at least, 10 to 200 rows, updated_at.

    locale: the language in whose order texts (id, file_path) are sorted.
    """
    page_no, size = max(1, page_no), min(200, max(10, size))
    sort = sort if sort in SORTS else "updated_at"
    df = df if status is None else df.where(F.col("status") == status)
    total = df.agg(F.count("*").alias("total"))
    key = collated(F.col(sort), locale) if isinstance(df.schema[sort].dataType, StringType) else F.col(sort)
    order = key.desc() if descending else key.asc()
    return df.orderBy(order, row_id).offset((page_no - 1) * size).limit(size).join(F.broadcast(total))


def shown_status(status: Column, multimodal_done: Column) -> Column:
    """Processed documents whose multimodal part isn't done show as preprocessed."""
    return F.when((status == "processed") & ~F.coalesce(multimodal_done, F.lit(True)), F.lit("preprocessed")).otherwise(status)


def to_process(status: DataFrame, contents: DataFrame, row_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Documents to work on (pending, processing, failed, with content), and statuses to drop: no content and not failed."""
    has = contents.select(row_id)
    waiting = status.where(F.col("status").isin("pending", "processing", "failed")).join(has, row_id, "left_semi")
    return waiting, status.where(F.col("status") != "failed").join(has, row_id, "left_anti")


def queue(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of lists of one schema; of a key in several the row of the last list."""
    every = None
    for k, df in enumerate(lists):
        df = df.withColumn("__k", F.lit(k))
        every = df if every is None else every.unionByName(df)
    rest = [c for c in every.columns if c not in (key, "__k")]
    return every.groupBy(key).agg(F.max_by(F.struct(*rest), "__k").alias("x")).select(key, "x.*")


def tail(df: DataFrame, latest_first: list[Column], by: list[str], keep: int = 5000, over: int = 10000) -> DataFrame:
    """The last `keep` rows of each group that has more than `over`; all rows of the others."""
    counts = df.groupBy(*by).agg(F.count("*").alias("__n"))
    ranked = df.join(counts, by).withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*latest_first)))
    return ranked.where((F.col("__n") <= over) | (F.col("__r") <= keep)).drop("__n", "__r")


def sizes(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def iso_time(c: Column) -> Column:
    """A time of UTC as ISO-8601."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def selected(df: DataFrame, status: str | None = None, track_id: str | None = None, file_path: str | None = None) -> DataFrame:
    """Documents of a status, a track, a file."""
    for c, v in (("status", status), ("track_id", track_id), ("file_path", file_path)):
        df = df if v is None else df.where(F.col(c) == v)
    return df


def extend_cache_lists(chunks: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with the cache keys of new (chunk_id, cache_key) that their lists lack, behind those they have."""
    more = new.groupBy(key).agg(F.array_sort(F.collect_set("cache_key")).alias("__m"))
    none = F.array().cast("array<string>")
    return chunks.join(more, key, "left").withColumn("llm_cache_list", F.array_distinct(F.concat(F.coalesce("llm_cache_list", none), F.coalesce("__m", none)))).drop("__m")
