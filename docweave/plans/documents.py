"""Queries over documents: ingest, identities, chunks, status, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.operators import chunking, evaluation, multimodal, ranking, tables

from .base import registry, spread, table

QUERIES, SQL, query = registry()

# White space as the tables have it; SQL's class.
_WS = r"[ \t\n\r\f\v]"
_STRIP = lambda c: rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
# The same for a document's text with the control characters gone and HTML entities untouched.
_CLEAN = _STRIP(r"regexp_replace(" + _STRIP("text") + r", '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")


def _clean_docs(spark, sf):
    return spread(table(spark, sf, "documents")).withColumn("content", T.sanitize(F.col("text"), entities=False))


@query(f"""
WITH d AS (SELECT *, {_CLEAN} AS content FROM documents),
u AS (SELECT arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang, content FROM d GROUP BY content),
c AS (SELECT source, lang, content, unnest(range(0, length(content), 1100)) AS s FROM u)
SELECT source, lang, count(DISTINCT content) AS n_docs, count(*) AS n_chunks, CAST(sum(least(1200, length(content) - s)) AS BIGINT) AS n_tokens
FROM c GROUP BY source, lang""")
def chunk_rollup(spark, sf):
    """Distinct documents, chunks and tokens by source and language, from text to id to windows.

    Windows are counted before the shuffle, so that texts are not in it.
    """
    w = chunking.window_tokens(F.col("content"))
    d = _clean_docs(spark, sf).select("doc_id", "source", "lang", T.content_id("doc-", F.col("content")).alias("id"), w.alias("w"))
    tokens = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x)
    d = d.select("doc_id", "source", "lang", "id", F.size("w").alias("n"), tokens.alias("t"))
    c = d.groupBy("id").agg(F.min_by(F.struct("source", "lang", "n", "t"), "doc_id").alias("d")).select("d.*").where("n > 0")
    return c.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.sum("t").alias("n_tokens"))


@query(f"""
WITH d AS (SELECT *, 'doc-' || md5({_CLEAN}) AS id FROM documents)
SELECT id, min(doc_id) AS doc_id, count(*) AS n_copies FROM d GROUP BY id""")
def doc_exact_dedup(spark, sf):
    """Content ids of sanitized texts, the first document of each."""
    return _clean_docs(spark, sf).groupBy(T.content_id("doc-", F.col("content")).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query(f"""
WITH d AS (SELECT doc_id, {_STRIP('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 250 THEN substring(t, 1, 250) || '...' ELSE t END AS summary FROM d""")
def doc_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query(f"""
WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1100)) AS s FROM documents)
SELECT doc_id, CAST(s // 1100 AS INTEGER) AS chunk_order_index, CAST(least(1200, length(text) - s) AS INTEGER) AS tokens,
       'chunk-' || md5({_STRIP('substring(text, s + 1, 1200)')}) AS chunk_id FROM c""")
def chunk_token_windows(spark, sf):
    """Windows of 1,200 characters that overlap by 100, with content ids."""
    c = chunking.exploded(spread(table(spark, sf, "documents")), chunking.windows(F.col("text")), "doc_id")
    return c.select("doc_id", "chunk_order_index", "tokens", T.content_id("chunk-", F.col("content")).alias("chunk_id"))


@query(rf"""
WITH p AS (SELECT doc_id, unnest(string_split(text, '{chr(10)}')) AS part, generate_subscripts(string_split(text, '{chr(10)}'), 1) AS k FROM documents),
w AS (SELECT doc_id, k, part, unnest(CASE WHEN length(part) > 300 THEN range(0, length(part), 250) ELSE [0] END) AS s FROM p),
c AS (SELECT doc_id, k, s, CASE WHEN length(part) > 300 THEN least(300, length(part) - s) ELSE length(part) END AS tokens,
             CASE WHEN length(part) > 300 THEN substring(part, s + 1, 300) ELSE part END AS content FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, s) - 1 AS INTEGER) AS chunk_order_index, CAST(tokens AS INTEGER) AS tokens, md5({_STRIP('content')}) AS digest FROM c""")
def chunk_split_by_char(spark, sf):
    """Lines, those over 300 characters in windows that overlap by 50."""
    c = chunking.exploded(spread(table(spark, sf, "documents")), chunking.delimited(F.col("text"), "\n", 300, 50), "doc_id")
    return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"))


@query("""
WITH r AS (SELECT doc_id, length(text) AS n FROM documents),
c AS (SELECT CASE WHEN n <= 1920 THEN 1 ELSE 1 + CAST(ceil((n - 1920) / 1792.0) AS INTEGER) END AS k FROM r)
SELECT k AS windows, count(*) AS n_docs FROM c GROUP BY k""")
def chunk_counts(spark, sf):
    """How many documents give how many windows to a reranker."""
    w = chunking.rerank_windows(F.col("text"))
    return table(spark, sf, "documents").groupBy(F.size(w).alias("windows")).agg(F.count("*").alias("n_docs"))


@query("""
WITH r AS (SELECT doc_id, text, length(text) AS n FROM documents),
s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 1920 THEN [0] ELSE range(0, CAST(ceil((n - 1920) / 1792.0) AS BIGINT) * 1792 + 1, 1792) END) AS s FROM r)
SELECT doc_id, CAST(s // 1792 AS INTEGER) AS window_no, md5(CASE WHEN n <= 1920 THEN text ELSE substring(text, s + 1, 1920) END) AS digest FROM s""")
def rerank_char_windows(spark, sf):
    """Windows of 480 tokens of four characters that overlap by 32; the last ends with the text."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(chunking.rerank_windows(F.col("text"))).alias("window_no", "w")).select("doc_id", "window_no", F.md5("w").alias("digest"))


@query("""
WITH l AS (SELECT doc_id, length(text) AS n FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(greatest(0, least(1200, n - s) - CASE WHEN s + 1100 < n THEN 0 ELSE 0 END)) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN s > 0 THEN least(100, n - s) ELSE 0 END) AS BIGINT) AS n_overlap
FROM (SELECT doc_id, n, unnest(range(0, n, 1100)) AS s FROM l) GROUP BY doc_id""")
def chunk_overlap_stats(spark, sf):
    """Tokens of a document's windows and how many of them the window before has too."""
    c = chunking.exploded(spread(table(spark, sf, "documents")), chunking.windows(F.col("text")), "doc_id")
    shared = F.when(F.col("chunk_order_index") > 0, F.least(F.lit(100), F.col("tokens"))).otherwise(0)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("n_tokens"), F.sum(shared).alias("n_overlap"))


def _strategy(name):
    def run(spark, sf):
        docs = spread(table(spark, sf, "documents"))
        c = chunking.exploded(docs, chunking.chunk_udf(name, 400, 60)(F.col("text")), "doc_id")
        return c.select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"))

    run.__name__ = f"chunk_{name}"
    return run


for _name in ("recursive", "sentence", "paragraph", "semantic"):
    query()(_strategy(_name))


@query("""
SELECT CASE WHEN GROUPING(event_type) = 1 THEN 'all' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type)""")
def doc_status_counts(spark, sf):
    return tables.status_counts(table(spark, sf, "events"), "event_type")


@query("""
SELECT event_id, CAST(count(*) OVER () AS BIGINT) AS total FROM events WHERE event_type = 'error'
ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40""")
def doc_status_paginated(spark, sf):
    """The third page of twenty of one status, latest first."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"))
    return tables.page(e, 3, 20, status="error").select(F.col("id").alias("event_id"), "total")


@query("""
WITH s AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'preprocessed' WHEN event_type = 'purchase' THEN 'processed' ELSE event_type END AS status FROM events)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def doc_shown_status(spark, sf):
    """Statuses as they are shown: processed without its multimodal part is preprocessed."""
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "purchase", "processed").otherwise(F.col("event_type"))
    return e.groupBy(tables.shown_status(status, F.col("value") <= 50).alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 7 = 0 THEN 'failed' WHEN d.doc_id % 3 = 0 THEN 'processed' ELSE 'pending' END AS status, l.doc_id AS has
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT id, CASE WHEN has IS NULL THEN 'drop' ELSE 'process' END AS what FROM s
WHERE (has IS NOT NULL AND status IN ('pending', 'failed')) OR (has IS NULL AND status <> 'failed')""")
def doc_consistency(spark, sf):
    """Documents to work on, and statuses without content to drop; failed ones are kept."""
    n = F.col("doc_id")
    s = table(spark, sf, "documents").select(n.alias("id"), F.when(n % 7 == 0, "failed").when(n % 3 == 0, "processed").otherwise("pending").alias("status"))
    work, gone = tables.to_process(s, table(spark, sf, "labels").select(n.alias("id")))
    return work.select("id", F.lit("process").alias("what")).unionByName(gone.select("id", F.lit("drop").alias("what")))


@query("""
SELECT source, lang, count(*) AS n FROM documents d ANTI JOIN labels l USING (doc_id) GROUP BY source, lang""")
def filter_keys_anti(spark, sf):
    """Keys that are not stored."""
    docs = table(spark, sf, "documents")
    missing = tables.missing_keys(docs, table(spark, sf, "labels"), "doc_id")
    return docs.join(missing, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"))


_JUDGED = """
j AS (SELECT l.doc_id, l.quality AS score, CAST(l.doc_id % 229 AS INTEGER) AS file_no,
  ['text-only', 'multimodal-f', 'multimodal-t', 'meta-data', 'una-web', 'other'][1 + l.doc_id % 6] AS type FROM labels l)"""


def _judged(spark, sf):
    kinds = F.array(*map(F.lit, ("text-only", "multimodal-f", "multimodal-t", "meta-data", "una-web", "other")))
    j = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("score"), (F.col("doc_id") % 229).cast("int").alias("file_no"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("type"))
    return j.withColumn("domain", evaluation.domain(F.col("file_no"))).withColumn("type_group", evaluation.type_group(F.col("type")))


@query(f"""
WITH {_JUDGED},
g AS (SELECT *, CASE WHEN file_no <= 48 THEN 'aca' WHEN file_no <= 88 THEN 'fin' WHEN file_no <= 132 THEN 'gov' WHEN file_no <= 178 THEN 'law' ELSE 'new' END AS domain,
  CASE WHEN type = 'text-only' THEN 'Txt.' WHEN type IN ('multimodal-f', 'multimodal-t', 'meta-data') THEN 'Mm.' WHEN type = 'una-web' THEN 'Una.' END AS type_group FROM j),
k AS (SELECT 'overall' AS level, 'all' AS value, score FROM g UNION ALL SELECT 'type', type, score FROM g UNION ALL
      SELECT 'type_group', type_group, score FROM g WHERE type_group IS NOT NULL UNION ALL SELECT 'domain', domain, score FROM g)
SELECT level, value, CAST(sum(score) AS BIGINT) AS correct, count(*) AS total, round(100.0 * sum(score) / count(*), 6) AS accuracy FROM k GROUP BY level, value""")
def eval_accuracy_groupings(spark, sf):
    """Accuracy overall, by type, type group and domain, in one pass."""
    return evaluation.accuracy(_judged(spark, sf), ["type", "type_group", "domain"])


@query(f"""
WITH {_JUDGED},
v AS (SELECT *, CASE WHEN score = 1 THEN '1: right, as 0 of the parts lack' ELSE 'score 0' END AS eval FROM j),
k AS (SELECT *, CASE WHEN type = 'text-only' THEN 'text' WHEN type LIKE 'multimodal%' THEN 'mm' WHEN type = 'meta-data' THEN 'meta' ELSE 'una' END AS kind, substring(eval, 1, 20) AS h FROM v)
SELECT 'micro' AS kind, round(avg(CASE WHEN contains(h, '1') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS total FROM k
UNION ALL SELECT kind, round(1 - sum(CASE WHEN contains(h, '0') THEN 1 ELSE 0 END) / count(*), 6), count(*) FROM k GROUP BY kind""")
def eval_official(spark, sf):
    """The published roll-up of verdict texts."""
    j = _judged(spark, sf).withColumn("eval", F.when(F.col("score") == 1, "1: right, as 0 of the parts lack").otherwise("score 0"))
    return evaluation.official(j)


@query("""
WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END AS faithfulness, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 2 END AS recall FROM events),
l AS (SELECT 'faithfulness' AS measure, faithfulness AS v FROM e UNION ALL SELECT 'recall', recall FROM e)
SELECT measure, round(avg(v) FILTER (NOT isnan(v)), 4) AS mean, min(v) FILTER (NOT isnan(v)) AS least, max(v) FILTER (NOT isnan(v)) AS greatest, count(v) FILTER (NOT isnan(v)) AS n FROM l GROUP BY measure""")
def eval_nan_means(spark, sf):
    e = table(spark, sf, "events")
    nan = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return evaluation.nan_means(e.select(nan.alias("faithfulness"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 2).alias("recall")), ["faithfulness", "recall"])


_VERDICTS = ("```json\n{\"accuracy\": 1}\n```", '{"accuracy": "0", "why": "x"}', "Accuracy: 1, since", "I give 0 here", "no verdict", "10 of 10")


@query("""
WITH v AS (SELECT doc_id % 6 AS k FROM documents)
SELECT CAST(k AS INTEGER) AS k, CASE WHEN k IN (0, 2) THEN 1 ELSE 0 END AS score, count(*) AS n FROM v GROUP BY k""")
def eval_score_parse(spark, sf):
    """Zeros and ones of judges' texts."""
    v = F.element_at(F.array(*map(F.lit, _VERDICTS)), (F.col("doc_id") % 6 + 1).cast("int"))
    d = table(spark, sf, "documents").select((F.col("doc_id") % 6).cast("int").alias("k"), T.answer_score(v).alias("score"))
    return d.groupBy("k", "score").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, CAST(sum(length(role) + length(text) + 4) AS BIGINT) AS tokens, count(*) AS n FROM conversations
WHERE role IN ('system', 'user', 'assistant') AND trim(text) <> '' GROUP BY conv_id""")
def history_tokens(spark, sf):
    """Cost of the messages of a history that count."""
    c = table(spark, sf, "conversations").where(F.col("role").isin("system", "user", "assistant") & (T.strip(F.col("text")) != ""))
    return c.groupBy("conv_id").agg(F.sum(T.history_tokens(F.col("role"), F.col("text"))).cast("long").alias("tokens"), F.count("*").alias("n"))


_BLOCKS = """
b AS (SELECT conv_id AS doc_id, turn AS position, CAST(turn // 2 AS INTEGER) AS page_idx,
      CASE WHEN turn % 4 = 3 THEN 'image' ELSE 'text' END AS type, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text FROM conversations)"""


def _blocks(spark, sf):
    kind = F.when(F.col("turn") % 4 == 3, "image").otherwise("text")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.floor(F.col("turn") / 2).cast("int").alias("page_idx"), kind.alias("type"), F.when(kind == "image", "").otherwise(F.col("text")).alias("text"))


@query(f"""
WITH {_BLOCKS}
SELECT a.doc_id, a.position, coalesce(string_agg(o.text, '{chr(10)}' ORDER BY o.page_idx, o.position), '') AS context
FROM b a LEFT JOIN b o ON a.doc_id = o.doc_id AND o.page_idx BETWEEN a.page_idx - 1 AND a.page_idx + 1 AND o.position <> a.position AND o.text <> ''
GROUP BY a.doc_id, a.position""")
def page_context_window(spark, sf):
    """The texts of the pages around each block."""
    return multimodal.page_context(_blocks(spark, sf)).select("doc_id", "position", "context")


@query(f"""
WITH {_BLOCKS}
SELECT doc_id, string_agg(text, '{chr(10)}{chr(10)}' ORDER BY position) AS content FROM b WHERE type = 'text' AND trim(text) <> '' GROUP BY doc_id""")
def separate_content(spark, sf):
    """Documents' texts without their other blocks."""
    return multimodal.separated(_blocks(spark, sf))[0]


@query(f"""
WITH {_BLOCKS}
SELECT doc_id, position, CASE WHEN type = 'image' THEN '{chr(10)}Image Content Analysis:{chr(10)}Image Path: p' || position || '.png{chr(10)}Captions: '
  || CASE WHEN position % 8 = 3 THEN 'None' ELSE 'a, b' END || '{chr(10)}Footnotes: None{chr(10)}{chr(10)}Visual Analysis: d'
  ELSE 'Text Content Analysis:{chr(10)}Content: ' || text || '{chr(10)}{chr(10)}Analysis: d' END AS chunk FROM b""")
def modal_chunk_templates(spark, sf):
    """The chunk texts that stand for blocks."""
    none = F.array().cast("array<string>")
    captions = F.when(F.col("position") % 8 == 3, none).otherwise(F.array(F.lit("a"), F.lit("b")))
    chunk = multimodal.described(F.col("type"), F.concat(F.lit("p"), F.col("position"), F.lit(".png")), captions, none, F.lit(""), F.col("text"), F.lit(""), F.lit("d"))
    return _blocks(spark, sf).select("doc_id", "position", chunk.alias("chunk"))


@query("""
WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source || '_' || lpad(CAST(n AS VARCHAR), 6, '0') AS file_name FROM p""")
def unique_file_names(spark, sf):
    """Names made unique by a number in the order of ids."""
    d = ranking.numbered_in(table(spark, sf, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], "n")
    return d.select("doc_id", F.concat("source", F.lit("_"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("file_name"))
