"""Documents from enqueue to chunks, vectors and graph: in one batch, or as files arrive.

State is a Store: a run publishes what it adds and changes as one version, so it is seen whole or not at all, whatever
step it stops at, and a repeated run changes nothing. What a model answers goes into the store's cache in the version of
the records made of it; an answer of a document that failed is kept too, so a second run asks only what failed.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docweave.functions import extraction
from docweave.functions.text import content_id, sanitize, summary
from docweave.operators import chunking, models, multimodal
from docweave.operators.answering import Knowledge
from docweave.operators.scratch import written

from . import state
from .store import TABLES, Change, Snapshot, Store

WAITING = ("pending", "processing", "failed")
#: What a model is told to make of an answer that may lack records.
GLEAN = "Some records were missed or malformed. Give only these, in the same form."


def enqueued(docs: DataFrame) -> DataFrame:
    """(id, file_path, content, content_summary, content_length, status): sanitized documents, each content once, empty ones left out."""
    d = docs.select("file_path", sanitize(F.col("text")).alias("content")).where("content != ''").withColumn("id", content_id("doc-", F.col("content")))
    d = d.groupBy("id").agg(F.min_by(F.struct("file_path", "content"), "file_path").alias("d"))
    return d.select("id", "d.file_path", "d.content", summary(F.col("d.content")).alias("content_summary"), F.length("d.content").alias("content_length"), F.lit("pending").alias("status"))


def failed(files: DataFrame) -> DataFrame:
    """Status rows of files that could not be read (path, error)."""
    return files.where("error is not null").select(content_id("error-", F.col("path")).alias("id"), F.col("path").alias("file_path"), F.lit("failed").alias("status"), F.col("error").alias("error_msg"))


def chunked(docs: DataFrame, chunks: Column | None = None) -> DataFrame:
    """A row a chunk: full_doc_id, chunk_order_index, tokens, content, chunk_id, file_path."""
    made = chunking.windows(F.col("content")) if chunks is None else chunks
    rows = docs.select(F.col("id").alias("full_doc_id"), "file_path", F.explode(made).alias("c")).select("full_doc_id", "file_path", "c.*")
    return rows.withColumn("chunk_id", content_id("chunk-", F.col("content")))


STATUS = {c.split()[0]: c.split()[1] for c in TABLES["docs"][0].split(", ")}


def _statuses(df: DataFrame, version: int) -> DataFrame:
    given = df.drop("version")
    return given.select(*((F.col(c) if c in given.columns else F.lit(None)).cast(t).alias(c) for c, t in STATUS.items() if c != "version"), F.lit(version).alias("version"))


def enqueue(store: Store, docs: DataFrame, track_id: str | None = None) -> int:
    """Stores documents (file_path, text, error?) that are new as pending, unreadable ones as failed; returns how many were."""
    base = store.at()
    new = enqueued(docs if "error" not in docs.columns else docs.where("error is null"))
    lost = failed(docs.withColumnRenamed("file_path", "path")) if "error" in docs.columns else None
    version = base.version + 1
    new = written(new)  # what is stored is computed once
    rows = _statuses(new.withColumn("track_id", F.lit(track_id)), version)
    rows = rows if lost is None else rows.unionByName(_statuses(lost, version))
    old = base.of("docs", rows)
    rows = written(rows if old is None else rows.join(old.select("id"), "id", "left_anti"))
    n = rows.count()
    if n:
        store.publish([Change("contents", new.select("id", "content").join(rows.select("id"), "id", "left_semi")), Change("docs", rows)], base)
    return n


def fragments(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What records (chunk_id, full_doc_id, file_path, chunk_order_index, record_order, fields, answer_order?) say of entities and of pairs.

    Of a chunk that was asked more than once, each entity and relation is that of one answer.
    """
    e = extraction.entities(records).withColumnRenamed("entity_name", "entity_id")
    r = extraction.relations(records)
    r = r.withColumns({"src": F.least("src_id", "tgt_id"), "tgt": F.greatest("src_id", "tgt_id")})
    if "answer_order" in records.columns:
        chunk = ["full_doc_id", "chunk_order_index"]
        e, r = extraction.best_answers(e, [*chunk, "entity_id"], "answer_order"), extraction.best_answers(r, [*chunk, "src", "tgt"], "answer_order")
    return e.select(*state._columns("entity_fragments")), r.select(*state._columns("relation_fragments"))


def process(store: Store, extract: models.Asker, chunks: Column | None = None, embedder: models.Embedder | None = None, dims: int = 0, glean: str | None = None, now: int | None = None, summarize: state.Summarizer | None = None) -> int:
    """Works on all documents that wait (failed and interrupted ones again); returns how many were processed.

    extract: prompt column -> answer column of a model (models.asker makes one of a function). A null answer fails its
    document, of which nothing is stored then but the answers that were given. glean: what each chunk is asked for a
    second time, behind its text and the first answer; GLEAN is a text for it. Prompts in the store's cache are not asked
    again; calls are counted in the store's table `usage`. now: seconds, the time of new answers. summarize: makes one
    description of an entity's or a relation's; give it to delete() too.
    """
    base = store.at()
    docs, contents = base.table("docs"), base.table("contents")
    if docs is None or contents is None:
        return 0
    now, version = int(time.time()) if now is None else now, base.version + 1
    waiting = written(docs.where(F.col("status").isin(*WAITING)).join(contents, "id"))
    if not waiting.limit(1).count():
        return 0
    cut = written(chunked(waiting, chunks))
    answers, cached, used = _answers(base, cut, extract, glean, now)
    bad = answers.where("answer is null").select(F.col("full_doc_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    done = waiting.join(bad, "id", "left").withColumn("status", F.when(F.col("bad"), "failed").otherwise("processed")).withColumn("error_msg", F.when(F.col("bad"), "no answer for a chunk"))
    done = written(_statuses(done, version))
    fine = done.where("status = 'processed'").select(F.col("id").alias("full_doc_id"))
    n = fine.count()
    keys = answers.groupBy("full_doc_id", "chunk_order_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("answer_order", "cache_key"))), lambda x: x["cache_key"]).alias("llm_cache_list"))
    fresh = written(cut.join(fine, "full_doc_id", "left_semi").join(keys, ["full_doc_id", "chunk_order_index"]))
    records = written(extraction.records(answers.join(fine, "full_doc_id", "left_semi").select("chunk_id", "full_doc_id", "file_path", "chunk_order_index", "answer_order", F.col("answer").alias("text"))))
    changes = [Change("docs", done, done.select("id")), Change("cache", cached), Change("usage", _usage(store, used, version)), Change("chunks", fresh)]
    store.publish([*changes, *_graph(base, fresh, fragments(records if glean else records.drop("answer_order")), embedder, dims, summarize)], base)
    return n


def _answers(base: Snapshot, cut: DataFrame, extract: models.Asker, glean: str | None, now: int) -> tuple[DataFrame, DataFrame, list[Observation]]:
    """cut with answer_order, answer, cache_key, a row an answer; new rows of the cache; what was counted."""
    rounds, new, used, rows = [], None, [], cut.withColumn("prompt", F.col("content"))
    for k in range(2 if glean else 1):
        used.append(Observation(f"calls_{k}"))
        cache = base.of("cache", rows.select(models.prompt_key(F.col("prompt")).alias("cache_key")))
        rows, more = models.asked(rows, "prompt", extract, cache, chunk="chunk_id", now=now + k, calls=used[-1])
        rows = written(rows)
        rounds.append(rows.withColumn("answer_order", F.lit(k)).drop("prompt"))
        new = more if new is None else new.unionByName(more)
        rows = rows.where("answer is not null").select(*cut.columns, F.concat_ws("\n", "prompt", "answer", F.lit(glean)).alias("prompt"))
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every, new, used


def _usage(store: Store, used: list[Observation], version: int) -> DataFrame:
    """A row of what was asked in this run."""
    sums = [sum(o.get[c] for o in used) for c in ("call_count", "prompt_tokens", "completion_tokens")]
    return store.spark.createDataFrame([(version, *sums)], TABLES["usage"][0])


def _graph(base: Snapshot, chunks: DataFrame, parts: tuple[DataFrame, DataFrame], embedder: models.Embedder | None, dims: int, summarize: state.Summarizer | None = None) -> list[Change]:
    """What new chunks and their fragments change in vectors and graph."""
    out = state.added(base, *parts, embedder, dims, summarize=summarize)
    if embedder is not None:
        ids = chunks.select(F.col("chunk_id").alias("vec_id"), "content").dropDuplicates(["vec_id"])
        old = base.of("vectors", ids)
        ids = ids if old is None else ids.join(old.select("vec_id"), "vec_id", "left_anti")
        out.append(Change("vectors", written(models.embedded(ids, F.col("content"), embedder, dims).select("vec_id", "embedding"))))
    return out


def ingest(store: Store, docs: DataFrame, extract: models.Asker, chunks: Column | None = None, embedder: models.Embedder | None = None, dims: int = 0, **more) -> int:
    """Takes in documents (file_path, text, error?) that are new, and those that wait; returns how many were processed."""
    enqueue(store, docs)
    return process(store, extract, chunks, embedder, dims, **more)


def ingest_blocks(store: Store, blocks: DataFrame, files: DataFrame, extract: models.Asker, describe, embedder: models.Embedder | None = None, dims: int = 0, now: int | None = None) -> int:
    """Parsed documents: blocks (doc_id, position, type, text, ...) and files (doc_id, file_path).

    Texts go through ingest; other blocks, described by `describe` (a column of struct<description, entity_name,
    entity_type, summary>), become chunks behind those of their document, with their entity and its relations.
    """
    texts, others = multimodal.separated(blocks)
    n = ingest(store, texts.join(files, "doc_id").select("file_path", F.col("content").alias("text")), extract, None, embedder, dims, now=now)
    base = store.at()
    made = written(multimodal.modal_chunks(others.join(files, "doc_id"), describe))
    ids = base.table("docs").where("status = 'processed'").select("file_path", F.col("id").alias("full_doc_id"))
    new = written(made.join(ids, "file_path"))
    old = base.of("chunks", new)
    counts = old.groupBy("full_doc_id").agg((F.max("chunk_order_index") + 1).alias("base"))
    new = new.join(counts, "full_doc_id", "left").withColumn("chunk_order_index", (F.coalesce("base", F.lit(0)) + F.col("chunk_order_index")).cast("int"))
    new = written(new.join(old.select("full_doc_id", "chunk_id"), ["full_doc_id", "chunk_id"], "left_anti").drop("base"))
    if not new.limit(1).count():
        return n
    answers, cached, used = _answers(base, new, extract, None, int(time.time()) if now is None else now)
    read = answers.where("answer is not null").select("chunk_id", "full_doc_id", "file_path", "chunk_order_index", F.col("answer").alias("text"))
    records = multimodal.with_main_entities(extraction.records(read), new)
    chunks = answers.withColumn("llm_cache_list", F.array("cache_key"))
    changes = [Change("cache", cached), Change("usage", _usage(store, used, base.version + 1)), Change("chunks", chunks)]
    store.publish([*changes, *_graph(base, new, fragments(records), embedder, dims)], base)
    return n


def delete(store: Store, doc_ids: DataFrame, embedder: models.Embedder | None = None, dims: int = 0, summarize: state.Summarizer | None = None) -> None:
    """Documents (id) taken out with their chunks, vectors and what they say: what is left is as if they had never come.

    Cached answers stay, so a document that comes back is not asked about again.
    """
    base, gone = store.at(), written(doc_ids.select("id").distinct())
    by_doc = gone.select(F.col("id").alias("full_doc_id"))
    changes = [Change(t, None, gone) for t in ("contents", "docs") if t in base.heads] + state.removed(base, by_doc, embedder, dims, summarize=summarize)
    chunks = base.of("chunks", by_doc)
    if chunks is not None:
        ids = written(chunks.select("chunk_id").distinct())
        changes.append(Change("chunks", None, by_doc))
        if "vectors" in base.heads:  # but those of chunks that other documents have too
            others = base.table("chunks").select("chunk_id", "full_doc_id").join(ids, "chunk_id", "left_semi").join(by_doc, "full_doc_id", "left_anti")
            changes.append(Change("vectors", None, written(ids.join(others, "chunk_id", "left_anti").select(F.col("chunk_id").alias("vec_id")))))
    store.publish(changes, base)


def merged(store: Store) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the store's graph."""
    base = store.at()
    empty = lambda t: store.spark.createDataFrame([], TABLES[t][0])
    return tuple(empty(t) if (df := base.table(t)) is None else df for t in ("nodes", "edges"))


def rebuilt(cache: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the cached answers of chunks (chunk_id, full_doc_id, file_path, chunk_order_index, llm_cache_list).

    Of a chunk's answers, in the order they were made, a later one takes an entity's place if its first description is longer.
    """
    found = models.cache_entries(chunks, cache).join(chunks.select("chunk_id", "full_doc_id", "file_path", "chunk_order_index"), "chunk_id")
    read = found.select("chunk_id", "full_doc_id", "file_path", "chunk_order_index", F.col("create_time").alias("answer_order"), F.col("answer").alias("text"))
    e, r = fragments(extraction.records(read))
    return state.merged(written(e), state.ENTITY), state.merged(written(r), state.PAIR)


def rebuild(store: Store, embedder: models.Embedder | None = None, dims: int = 0) -> int:
    """Makes the graph of all chunks anew from the store's cached answers, asking nothing; main entities of blocks are not in them and go. Returns the new version."""
    base = store.at()
    chunks, cache = base.table("chunks"), base.table("cache")
    found = models.cache_entries(chunks.select("chunk_id", "llm_cache_list"), cache)
    read = found.join(chunks.select("chunk_id", "full_doc_id", "file_path", "chunk_order_index"), "chunk_id")
    read = read.select("chunk_id", "full_doc_id", "file_path", "chunk_order_index", F.col("create_time").alias("answer_order"), F.col("answer").alias("text"))
    parts, changes = fragments(extraction.records(read)), []
    for new, (key, kind, *_) in zip(parts, state.KINDS, strict=True):
        old = base.table(kind)
        gone = None if old is None else written(old.select(*key, "full_doc_id").distinct())
        changes += state.touched(base, key, written(new.select(*state._columns(kind))), gone, embedder, dims)
    return store.publish(changes, base)


def knowledge(store: Store, embedder: models.Embedder, dims: int) -> Knowledge:
    """What the store has, to be searched: graph, chunks, and vectors of all of them. Vectors that lack are made and stored; no other text is embedded."""
    state.embed_missing(store, embedder, dims)
    base = store.at()
    chunks = base.table("chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "content", "file_path")
    texts, old = chunks.select(F.col("chunk_id").alias("vec_id"), "content"), base.table("vectors")
    lacking = texts if old is None else texts.join(old.select("vec_id"), "vec_id", "left_anti")
    if lacking.limit(1).count():
        store.publish([Change("vectors", written(models.embedded(lacking, F.col("content"), embedder, dims).select("vec_id", "embedding")))], base)
        base = store.at()
    nodes, edges = merged(store)
    found = [base.table(t) for t in ("entity_vectors", "relation_vectors")]
    empty = [store.spark.createDataFrame([], TABLES[t][0]) for t in ("entity_vectors", "relation_vectors")]
    e, r = (a if a is not None else b for a, b in zip(found, empty, strict=True))
    return Knowledge(nodes, edges, chunks, e.select(F.col("entity_id").alias("vec_id"), "embedding"), r.select("src", "tgt", "embedding"), base.table("vectors"))


def index_files(store: Store, files: DataFrame, extract: models.Asker, dry_run: bool = False, **more) -> DataFrame:
    """Files as read (path, text, error) taken in; (status, n) of what became of them. dry_run: of what would be read."""
    if dry_run:
        return files.groupBy(F.when(F.col("error").isNull(), "readable").otherwise("failed").alias("status")).agg(F.count("*").alias("n"))
    ingest(store, files.select(F.col("path").alias("file_path"), "text", "error"), extract, **more)
    return store.table("docs").join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").groupBy("status").agg(F.count("*").alias("n"))


def follow(store: Store, path: str, extract: models.Asker, checkpoint: str, chunks: Column | None = None, **more):
    """Takes in text files as they arrive below a path, all that are there and then ends; a batch that is repeated adds nothing. more: as for process()."""
    files = store.spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    return files.writeStream.foreachBatch(lambda df, _: ingest(store, df, extract, chunks, **more) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["GLEAN", "Store", "delete", "enqueue", "enqueued", "failed", "follow", "fragments", "index_files", "ingest", "ingest_blocks", "knowledge", "merged", "process", "rebuild", "rebuilt"]
