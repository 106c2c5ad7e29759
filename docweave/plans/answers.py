"""Queries over requests: search by mode, budgets, contexts, results, reranking, caches. A region is a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import answering, evaluation, graph, models, tables
from docweave.operators.answering import BY, QueryParam
from docweave.operators.ranking import numbered
from docweave.operators.scratch import written

from .base import registry, table
from .graphs import _DEGREES, _EDGES, _edges

QUERIES, SQL, query = registry()

PARAM = QueryParam(max_entity_tokens=900, max_relation_tokens=1500, max_total_tokens=3600, chunk_top_k=12)
_FIXED = len(PARAM.template.format(entities="", relations="", chunks="", references="")) + answering.SPARE
_SHAPE = len(', "is_multimodal": false, "page_idx": null')

_REQUESTS = f"""
{_EDGES}, {_DEGREES},
q AS (SELECT r_regionkey AS query_id, r_name AS query FROM region),
n AS (SELECT 'S' || s_suppkey AS entity_id, 'supplier' AS entity_type, s_name AS description FROM supplier UNION ALL SELECT 'P' || p_partkey, 'part', p_name || ', ' || p_type FROM part),
low AS (SELECT * FROM (SELECT n_regionkey AS query_id, 'S' || s_suppkey AS entity_id, s_acctbal AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS rank
        FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rank <= 10),
high AS (SELECT * FROM (SELECT n_regionkey AS query_id, src, tgt, weight AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY weight DESC, src, tgt) AS rank
        FROM e JOIN supplier ON tgt = 'S' || s_suppkey JOIN nation ON s_nationkey = n_nationkey) WHERE rank <= 10),
near AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, weight DESC, a.degree + b.degree DESC, src, tgt) AS rank
        FROM e JOIN low ON tgt = low.entity_id JOIN d a ON src = a.entity_id JOIN d b ON tgt = b.entity_id),
seen AS (SELECT query_id, entity_id, min(rank * 2 + p) AS f FROM (SELECT query_id, src AS entity_id, rank, 0 AS p FROM high UNION ALL SELECT query_id, tgt, rank, 1 FROM high) GROUP BY 1, 2),
ends AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY f, entity_id) AS rank FROM seen),
el AS (SELECT query_id, entity_id, rank, 0 AS l FROM low UNION ALL SELECT query_id, entity_id, rank, 1 FROM ends),
ef AS (SELECT query_id, entity_id, min(rank * 2 + l) AS f FROM el GROUP BY 1, 2),
ents AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY f, entity_id) AS position FROM ef),
rl AS (SELECT query_id, src, tgt, rank, 0 AS l FROM near UNION ALL SELECT query_id, src, tgt, rank, 1 FROM high),
rf AS (SELECT query_id, src, tgt, min(rank * 2 + l) AS f FROM rl GROUP BY 1, 2, 3),
rels AS (SELECT query_id, src, tgt, row_number() OVER (PARTITION BY query_id ORDER BY f, src, tgt) AS position FROM rf)"""

_CUT = f"""{_REQUESTS},
eline AS (SELECT query_id, entity_id, position, entity_type, description, '{{"entity": ' || to_json(entity_id) || ', "type": ' || to_json(entity_type) || ', "description": ' || to_json(description) || '}}' AS line FROM ents JOIN n USING (entity_id)),
rline AS (SELECT query_id, src, tgt, position, weight, n || ' lines' AS description, '{{"entity1": ' || to_json(src) || ', "entity2": ' || to_json(tgt) || ', "description": ' || to_json(n || ' lines') || '}}' AS line FROM rels JOIN e USING (src, tgt)),
ecut AS (SELECT * FROM (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY position) AS used FROM eline) WHERE used <= {PARAM.max_entity_tokens}),
rcut AS (SELECT * FROM (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY position) AS used FROM rline) WHERE used <= {PARAM.max_relation_tokens})"""

_PACKED = f"""{_CUT},
texts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o_totalprice DESC, o_orderkey) AS position FROM (
  SELECT n_regionkey AS query_id, 'c' || o_orderkey AS chunk_id, 'f' || (o_orderkey % 50) AS file_path, o_totalprice, o_orderkey, 'An order of "' || c_name || '", ' || o_orderpriority || ', state ' || o_orderstatus AS content
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)),
budget AS (SELECT q.query_id, greatest(0, {PARAM.max_total_tokens} - ({_FIXED} + length(q.query) + coalesce((SELECT sum(length(line) + 1) - 1 FROM ecut WHERE ecut.query_id = q.query_id), 0)
           + coalesce((SELECT sum(length(line) + 1) - 1 FROM rcut WHERE rcut.query_id = q.query_id), 0))) AS budget FROM q),
cost AS (SELECT texts.*, budget, sum(length('{{"content": ' || to_json(content) || ', "file_path": ' || to_json(file_path) || ', "chunk_id": ' || to_json(chunk_id) || '}}') + {_SHAPE}) OVER (PARTITION BY query_id ORDER BY position) AS used
         FROM texts JOIN budget USING (query_id) WHERE position <= {PARAM.chunk_top_k}),
fit AS (SELECT * FROM cost WHERE used <= budget),
ref AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(position)) AS reference_id FROM fit GROUP BY 1, 2),
packed AS (SELECT query_id, 'DC' || position AS id, position, chunk_id, content, file_path, CAST(reference_id AS VARCHAR) AS reference_id FROM fit JOIN ref USING (query_id, file_path))"""


def _hits(spark, sf, edges):
    home = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_acctbal").alias("score"), "s_suppkey")
    low = numbered(home, [F.desc("score"), F.col("s_suppkey")], "rank", BY).where("rank <= 10").select("query_id", "entity_id", "score", "rank")
    high = edges.join(home.select("query_id", F.col("entity_id").alias("tgt")), "tgt")
    return low, numbered(high, [F.desc("weight"), F.col("src"), F.col("tgt")], "rank", BY).where("rank <= 10").select("query_id", "src", "tgt", F.col("weight").alias("score"), "rank")


def _nodes(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("description"))
    return s.unionByName(table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"), F.lit("part").alias("entity_type"), F.concat("p_name", F.lit(", "), "p_type").alias("description")))


def _searched(spark, sf):
    edges, nodes = written(_edges(spark, sf)), _nodes(spark, sf)
    entities, relations = answering.merged_search(*_hits(spark, sf, edges), nodes.select("entity_id"), edges)
    return written(entities.join(nodes, "entity_id")), written(relations.join(edges.select("src", "tgt", "weight", F.concat("n", F.lit(" lines")).alias("description")), ["src", "tgt"]))


def _packed(spark, sf):
    q = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("query"), F.lit("mix").alias("mode"), F.array("r_name").alias("high"), F.array().cast("array<string>").alias("low"))
    entities, relations = (written(df) for df in answering.truncated(*_searched(spark, sf), PARAM))
    c = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    content = F.concat(F.lit('An order of "'), "c_name", F.lit('", '), "o_orderpriority", F.lit(", state "), "o_orderstatus")
    c = c.select(F.col("n_regionkey").alias("query_id"), "o_orderkey", "o_totalprice", F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), content.alias("content"), F.concat(F.lit("f"), F.col("o_orderkey") % 50).alias("file_path"))
    c = numbered(c, [F.desc("o_totalprice"), F.col("o_orderkey")], "position", BY).where(F.col("position") <= 50).drop("o_orderkey", "o_totalprice")
    return q, entities, relations, written(answering.packed_chunks(c, answering.chunk_budget(q, entities, relations, PARAM), PARAM))


@query(f"WITH {_REQUESTS} SELECT query_id, 'entity' AS kind, entity_id AS key, CAST(position AS INTEGER) AS position FROM ents UNION ALL SELECT query_id, 'relation', src || ' ' || tgt, CAST(position AS INTEGER) FROM rels")
def hybrid_search(spark, sf):
    """Entities and relations of each region's hits, local and global lists in turn."""
    e, r = _searched(spark, sf)
    return e.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), "position").unionByName(r.select("query_id", F.lit("relation").alias("kind"), F.concat("src", F.lit(" "), "tgt").alias("key"), "position"))


@query(f"WITH {_CUT} SELECT query_id, 'entity' AS kind, line, CAST(position AS INTEGER) AS position FROM ecut UNION ALL SELECT query_id, 'relation', line, CAST(position AS INTEGER) FROM rcut")
def truncated_context(spark, sf):
    """What budgets leave of the entities and relations, as lines of JSON."""
    e, r = answering.truncated(*_searched(spark, sf), PARAM)
    return e.select("query_id", F.lit("entity").alias("kind"), "line", "position").unionByName(r.select("query_id", F.lit("relation").alias("kind"), "line", "position"))


_HEAD, _MID1, _MID2, _MID3, _TAIL = PARAM.template.replace("{entities}", "\0").replace("{relations}", "\0").replace("{chunks}", "\0").replace("{references}", "\0").split("\0")


@query(f"""
WITH {_PACKED}
SELECT query_id, '{_HEAD}' || coalesce((SELECT string_agg(line, '{chr(10)}' ORDER BY position) FROM ecut WHERE ecut.query_id = q.query_id), '') || '{_MID1}'
  || coalesce((SELECT string_agg(line, '{chr(10)}' ORDER BY position) FROM rcut WHERE rcut.query_id = q.query_id), '') || '{_MID2}'
  || coalesce((SELECT string_agg('{{"id": ' || to_json(id) || ', "reference_id": ' || to_json(reference_id) || ', "content": ' || to_json(content) || '}}', '{chr(10)}' ORDER BY position) FROM packed WHERE packed.query_id = q.query_id), '') || '{_MID3}'
  || coalesce((SELECT string_agg('[' || reference_id || '] ' || file_path, '{chr(10)}' ORDER BY reference_id) FROM ref WHERE ref.query_id = q.query_id), '') || '{_TAIL}' AS context
FROM q""")
def context_string(spark, sf):
    """The whole context of each region's request."""
    return answering.context_strings(*_packed(spark, sf), PARAM)


@query(f"""
WITH {_PACKED}
SELECT query_id, 'success' AS status, 'mix' AS query_mode,
  (SELECT string_agg(entity_id || ':' || entity_type || ':unknown_source', ',' ORDER BY position) FROM ecut WHERE ecut.query_id = q.query_id) AS entities,
  (SELECT string_agg(src || '-' || tgt || ':' || CAST(weight AS BIGINT), ',' ORDER BY position) FROM rcut WHERE rcut.query_id = q.query_id) AS relationships,
  (SELECT string_agg(id || ':' || chunk_id, ',' ORDER BY position) FROM packed WHERE packed.query_id = q.query_id) AS chunks,
  (SELECT string_agg(reference_id || ':' || file_path, ',' ORDER BY reference_id) FROM ref WHERE ref.query_id = q.query_id) AS refs
FROM q""")
def user_result(spark, sf):
    """The result of each region's request as a user gets it, its lists as texts."""
    q, e, r, c = _packed(spark, sf)
    none = F.array().cast("array<string>")
    e = e.withColumns({"source_ids": none, "file_paths": none})
    r = r.withColumns({"source_ids": none, "file_paths": none, "keywords": F.lit(None).cast("string")})
    d = answering.user_format(q, e, r, c)
    listed = lambda name, f: F.array_join(F.transform(f"data.{name}", f), ",").alias(name)
    return d.select(
        "query_id", "status", "metadata.query_mode", listed("entities", lambda x: F.concat_ws(":", x["entity_name"], x["entity_type"], x["file_path"])),
        listed("relationships", lambda x: F.concat(x["src_id"], F.lit("-"), x["tgt_id"], F.lit(":"), x["weight"].cast("long"))), listed("chunks", lambda x: F.concat_ws(":", x["id"], x["chunk_id"])),
        listed("references", lambda x: F.concat_ws(":", x["reference_id"], x["file_path"])).alias("refs"),
    )


_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_NAIVE = f"""{_V},
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score >= 0.2)"""


def _chunk_hits(spark, sf, k):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return answering.chunk_hits(q, e, QueryParam(chunk_top_k=k))


@query(f"""
WITH {_NAIVE},
c AS (SELECT query_id, rank, chunk_id, coalesce(source, 'unknown_source') AS file_path, sum(length('{{"content": ' || to_json(text) || ', "file_path": ' || to_json(coalesce(source, 'unknown_source')) || ', "chunk_id": "' || chunk_id || '"}}') + {_SHAPE})
      OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM c WHERE used <= 20000),
r AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(n)) AS reference_id FROM f GROUP BY 1, 2)
SELECT query_id, 'DC' || n AS id, CAST(chunk_id AS VARCHAR) AS chunk_id, CAST(reference_id AS VARCHAR) AS reference_id FROM f JOIN r USING (query_id, file_path)""")
def naive_context(spark, sf):
    """Chunks alone: the twenty most similar texts of every hundredth vector's request, packed in a budget, with references."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.coalesce("source", F.lit("unknown_source")).alias("file_path"))
    hits = _chunk_hits(spark, sf, 20).join(docs, "chunk_id").select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "content", "file_path", F.col("rank").alias("position"))
    budgets = hits.select("query_id", F.lit(20000).cast("long").alias("budget")).distinct()
    return answering.packed_chunks(hits, budgets, QueryParam()).select("query_id", "id", "chunk_id", "reference_id")


def _longest_first(query: str, documents: list[str], top_n: int | None) -> list[dict]:
    order = sorted(range(len(documents)), key=lambda i: (-len(documents[i]), i))
    return [{"index": i, "relevance_score": float(len(documents[i]))} for i in order[:top_n]]


@query(f"""
WITH {_NAIVE}, c AS (SELECT query_id, rank, chunk_id, length(text) AS score FROM h JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM c)
SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS rerank_score, CAST(position AS INTEGER) AS position FROM o WHERE position <= 8""")
def rerank_join(spark, sf):
    """Hits in the order of a reranker that prefers long texts; its places in the list are joined back to the texts."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    hits = _chunk_hits(spark, sf, 20).join(docs, "chunk_id").withColumnRenamed("rank", "position")
    asked = hits.select("query_id", F.lit("q").alias("query")).distinct()
    return models.reranked(hits, asked, _longest_first, BY, 8).select("query_id", "chunk_id", "rerank_score", "position")


@query(f"""
WITH {_REQUESTS},
x AS (SELECT query_id, 'entity' AS kind, entity_id AS key, position, length(entity_id || ': ' || description) AS score FROM ents JOIN n USING (entity_id)
      UNION ALL SELECT query_id, 'relation', src || ' ' || tgt, position, length(src || ' → ' || tgt || ': ' || n || ' lines') FROM rels JOIN e USING (src, tgt))
SELECT query_id, kind, key, CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, position) AS INTEGER) AS position FROM x""")
def graph_rerank(spark, sf):
    """Entities and relations in the order of a reranker over names and descriptions."""
    q = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("query"))
    e, r = answering.rerank_graph(*_searched(spark, sf), q, _longest_first)
    return e.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("key"), "position").unionByName(r.select("query_id", F.lit("relation").alias("kind"), F.concat("src", F.lit(" "), "tgt").alias("key"), "position"))


@query("""
SELECT conv_id AS query_id, CAST(sum(length(trim(role)) + length(trim(text)) + 4) AS BIGINT) AS tokens,
       md5('[' || string_agg('{"content": ' || to_json(trim(text)) || ', "role": ' || to_json(trim(role)) || '}', ', ' ORDER BY turn) || ']') AS signature
FROM conversations WHERE trim(role) IN ('system', 'user', 'assistant') AND trim(text) <> '' GROUP BY conv_id""")
def history_signature(spark, sf):
    """Cost and signature of conversations."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    return answering.history_signature(answering.history(c))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS n, count(*) OVER (PARTITION BY role) AS total FROM conversations)
SELECT role, conv_id, turn FROM c WHERE n <= CASE WHEN total > 100 THEN 50 ELSE total END""")
def message_tail(spark, sf):
    """The last fifty messages of each role that has over a hundred."""
    return tables.tail(table(spark, sf, "conversations").select("role", "conv_id", "turn"), [F.desc("conv_id"), F.desc("turn")], ["role"], 50, 100)


_CACHE = """
c AS (SELECT 'default:extract:' || md5(text || conv_id) AS cache_key, CASE WHEN role = 'user' THEN 'extract' ELSE 'summary' END AS cache_type, CAST(conv_id AS VARCHAR) AS chunk_id, turn * 7 % 5 AS create_time, text AS answer FROM conversations)"""


def _cache(spark, sf):
    c = table(spark, sf, "conversations")
    key = F.concat(F.lit("default:extract:"), F.md5(F.concat("text", F.col("conv_id").cast("string")).cast("binary")))
    return c.select(key.alias("cache_key"), F.when(F.col("role") == "user", "extract").otherwise("summary").alias("cache_type"), F.col("conv_id").cast("string").alias("chunk_id"), (F.col("turn") * 7 % 5).alias("create_time"), F.col("text").alias("answer"), "turn")


@query(f"""
WITH {_CACHE}, f AS (SELECT * FROM c WHERE cache_type = 'extract')
SELECT cache_key, chunk_id, create_time, min(create_time) OVER (PARTITION BY chunk_id) AS earliest FROM f""")
def cached_extractions(spark, sf):
    """Cached answers of chunks by the lists that chunks have of them, and when a chunk's first was made."""
    c = _cache(spark, sf)
    chunks = c.groupBy("chunk_id").agg(F.collect_set("cache_key").alias("llm_cache_list"))
    return models.cache_entries(chunks, c).select("cache_key", "chunk_id", "create_time", "earliest")


@query("""
WITH c AS (SELECT ['mix', 'local', 'default'][1 + CAST(turn % 3 AS INTEGER)] || ':' || CASE WHEN role = 'user' THEN 'query' ELSE 'extract' END || ':' || md5(text) AS cache_key FROM conversations)
SELECT cache_key, count(*) AS n FROM c WHERE NOT (cache_key LIKE 'mix:query:%' OR cache_key LIKE 'local:query:%') GROUP BY 1""")
def cache_clean(spark, sf):
    """A cache without the query entries of two modes."""
    mode = F.element_at(F.array(*map(F.lit, ("mix", "local", "default"))), (F.col("turn") % 3 + 1).cast("int"))
    c = table(spark, sf, "conversations").select(F.concat_ws(":", mode, F.when(F.col("role") == "user", "query").otherwise("extract"), F.md5(F.col("text").cast("binary"))).alias("cache_key"))
    return models.clean_cache(c, ["mix", "local"], ["query"]).groupBy("cache_key").agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE f AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p(conv_id, k, turn, pack, n, used, next_pack, next_n, next_used) AS (
  SELECT conv_id, k, turn, 0, 1, size, 0, 1, size FROM f WHERE k = 1
  UNION ALL
  SELECT f.conv_id, f.k, f.turn,
    CASE WHEN p.next_n > 1 AND p.next_used + f.size > 300 THEN p.next_pack + 1 ELSE p.next_pack END, 0, 0,
    CASE WHEN p.next_n > 1 AND p.next_used + f.size > 300 THEN p.next_pack + 1 WHEN p.next_n = 1 AND p.next_used + f.size > 300 THEN p.next_pack + 1 ELSE p.next_pack END,
    CASE WHEN p.next_n > 1 AND p.next_used + f.size > 300 THEN 1 WHEN p.next_n = 1 AND p.next_used + f.size > 300 THEN 0 ELSE p.next_n + 1 END,
    CASE WHEN p.next_n > 1 AND p.next_used + f.size > 300 THEN f.size WHEN p.next_n = 1 AND p.next_used + f.size > 300 THEN 0 ELSE p.next_used + f.size END
  FROM p JOIN f ON f.conv_id = p.conv_id AND f.k = p.k + 1)
SELECT conv_id, turn, CAST(pack AS INTEGER) AS pack FROM p""")
def summary_packs(spark, sf):
    """Texts of conversations in packs of up to 300 characters and two texts at least, for summaries by map and reduce."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("text").alias("description"))
    return models.packs(c, ["conv_id"], 300).select("conv_id", F.col("position").alias("turn"), "pack")


@query("SELECT CAST(sum(user_id) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 50) AS BIGINT) AS completion_tokens, CAST(sum(user_id + event_id % 50) AS BIGINT) AS total_tokens, count(*) AS call_count FROM events")
def token_usage(spark, sf):
    return models.usage(table(spark, sf, "events").select(F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens")))


@query("""
SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL
SELECT 'text_bytes', CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents""")
def workspace_stats(spark, sf):
    """Rows of the tables of a workspace, and bytes of its texts."""
    d = table(spark, sf, "documents")
    counts = tables.sizes({n: table(spark, sf, n) for n in ("documents", "labels", "conversations")})
    return counts.unionByName(d.agg(F.sum(F.octet_length("text")).alias("n")).select(F.lit("text_bytes").alias("name"), "n"))


@query("""
WITH l AS (SELECT conv_id AS file_no, text AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id AS file_no, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT file_no, CAST(k AS INTEGER) AS line, md5(question || '|' || answer) AS digest FROM l JOIN a USING (file_no, k)""")
def answers_by_line(spark, sf):
    """Answers and the lines of questions they belong to, by place."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file_no"), "turn", "role", "text")
    q, a = (c.where(F.col("role") == r).select("file_no", "turn", F.col("text").alias(n)) for r, n in (("user", "question"), ("assistant", "answer")))
    return evaluation.by_line(q, a, ["file_no"], "turn").select("file_no", "line", F.md5(F.concat_ws("|", "question", "answer").cast("binary")).alias("digest"))


@query("""
WITH p AS (SELECT 'failed' AS status, 1 AS pri, doc_id, source FROM documents WHERE lang < 'es' UNION ALL SELECT 'processing', 0, doc_id, source FROM documents WHERE n_chars > 1000 UNION ALL SELECT 'pending', 2, doc_id, source FROM documents WHERE source < 'src12')
SELECT doc_id AS id, arg_max(status, pri) AS status FROM p GROUP BY 1""")
def process_queue(spark, sf):
    """What is to be worked on: being processed, failed, pending; the later list wins."""
    d = table(spark, sf, "documents")
    lists = [d.where(c).select(F.col("doc_id").alias("id"), F.lit(s).alias("status")) for s, c in (("processing", "n_chars > 1000"), ("failed", "lang < 'es'"), ("pending", "source < 'src12'"))]
    return tables.queue(lists)


@query(f"WITH {_EDGES}, {_DEGREES}, n AS (SELECT 'S' || s_suppkey AS entity_id, s_suppkey AS k FROM supplier) SELECT n.entity_id, coalesce(degree, 0) AS degree, v.vec_id IS NOT NULL AS has_vector FROM n LEFT JOIN d USING (entity_id) LEFT JOIN embeddings v ON v.vec_id = n.k")
def entity_info(spark, sf):
    """Nodes with their degrees, and whether they have a vector."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("S"), "vec_id").alias("vec_id"), "embedding")
    return graph.entity_info(s, written(_edges(spark, sf)), v).select("entity_id", "degree", F.col("embedding").isNotNull().alias("has_vector"))


@query("""
WITH m AS (SELECT 'N' || s_nationkey AS entity_id, s_suppkey, s_name, s_acctbal FROM supplier)
SELECT entity_id, string_agg(s_name, '<SEP>' ORDER BY 'S' || s_suppkey) AS description, arg_min('S' || s_suppkey, 'S' || s_suppkey) AS first, CAST(max(s_acctbal) AS DOUBLE) AS best FROM m GROUP BY 1""")
def kg_merge_nodes(spark, sf):
    """Suppliers merged by nation: descriptions joined, the first name, the greatest balance."""
    s = table(spark, sf, "supplier")
    names = s.select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.concat(F.lit("N"), "s_nationkey").alias("target"))
    n = s.select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("description"), F.concat(F.lit("S"), "s_suppkey").alias("first"), F.col("s_acctbal").alias("best"))
    return graph.merge_entity_nodes(n, names, {"description": "join_unique", "first": "keep_first", "best": "max"})


@query("""
WITH r AS (SELECT l_orderkey AS doc, 'P' || l_partkey AS name FROM lineitem UNION SELECT o_orderkey, 'C' || o_custkey FROM orders)
SELECT doc AS full_doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM r GROUP BY 1""")
def entity_names_by_doc(spark, sf):
    """The names that each document gave or had added."""
    r = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("full_doc_id"), F.concat(F.lit("P"), "l_partkey").alias("entity_id"))
    more = table(spark, sf, "orders").select(F.col("o_orderkey").alias("full_doc_id"), F.concat(F.lit("C"), "o_custkey").alias("entity_id"))
    return graph.names_by_doc(r, more).select("full_doc_id", F.size("names").cast("long").alias("n"), F.array_join("names", ",").alias("names"))


_TRIANGLES = """
WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS tgt FROM (
  SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'C' || c_custkey, 'R' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING')),
n AS (SELECT 'C' || c_custkey AS id FROM customer UNION SELECT src FROM e UNION SELECT tgt FROM e UNION SELECT 'P' || p_partkey FROM part WHERE p_size = 1),
b AS (SELECT src AS x, tgt AS y FROM e UNION ALL SELECT tgt, src FROM e),
d AS (SELECT id, count(y) AS g FROM n LEFT JOIN b ON id = x GROUP BY 1),
reach(x, y) AS (SELECT x, y FROM b WHERE x LIKE 'R%' UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x),
t AS (SELECT p.x AS id, count(*) / 2 AS k FROM b p JOIN b q ON p.x = q.x AND p.y <> q.y JOIN b r ON r.x = p.y AND r.y = q.y GROUP BY 1),
l AS (SELECT id, g, CASE WHEN g > 1 THEN 2.0 * coalesce(k, 0) / (g * (g - 1)) END AS c FROM d LEFT JOIN t USING (id)),
s AS (SELECT count(*) AS size FROM reach GROUP BY x),
m AS (SELECT avg(size) AS mean_size FROM s)
SELECT (SELECT count(*) FROM d) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, round((SELECT avg(g) FROM d), 6) AS average_degree, round(2.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1)), 9) AS density,
  (SELECT count(*) FROM s) + (SELECT count(*) FROM d WHERE g = 0) AS num_components, (SELECT max(size) FROM s) AS giant_size, round((SELECT avg(c) FROM l), 6) AS average_clustering, CAST('inf' AS DOUBLE) AS diameter,
  round((SELECT mean_size FROM m), 6) AS mean_size, round((SELECT median(size) FROM s), 6) AS median_size, round((SELECT (sum(size) - max(size) - min(size)) / (count(*) - 2) FROM s), 6) AS trimmed_mean_size,
  round((SELECT exp(avg(ln(size))) FROM s), 6) AS geometric_mean_size, round((SELECT count(*) / sum(1.0 / size) FROM s), 6) AS harmonic_mean_size, (SELECT count(*) FROM s) AS num_components_excluding_isolated,
  (SELECT count(*) FROM s, m WHERE size > mean_size) AS num_components_above_mean, (SELECT count(*) FROM d WHERE g > 0) AS num_nodes_excluding_isolated, (SELECT count(*) FROM d WHERE g = 0) AS isolated,
  (SELECT count(*) FROM d WHERE g > 1) AS degree_over_1, (SELECT count(*) FROM d WHERE g > 2) AS degree_over_2, (SELECT count(*) FROM d WHERE g > 3) AS degree_over_3"""


@query(_TRIANGLES)
def graph_metrics(spark, sf):
    """All twenty measures of a graph of regions, nations and customers, which has triangles, several components and lone nodes."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    name = lambda p, c: F.concat(F.lit(p), c)
    e = nation.select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("tgt")).unionByName(customer.select(name("C", "c_custkey").alias("src"), name("N", "c_nationkey").alias("tgt")))
    e = e.unionByName(customer.where("c_mktsegment = 'BUILDING'").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("C", "c_custkey").alias("src"), name("R", "n_regionkey").alias("tgt")))
    nodes = e.select(F.explode(F.array("src", "tgt")).alias("entity_id")).unionByName(customer.select(name("C", "c_custkey").alias("entity_id"))).unionByName(table(spark, sf, "part").where("p_size = 1").select(name("P", "p_partkey").alias("entity_id"))).distinct()
    m = graph.metrics(nodes, e)
    return m.select(*(F.round(c, 9 if c == "density" else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes))


@query("SELECT count(*) AS graphs, avg(CAST(p_size AS DOUBLE)) AS num_nodes, max(CASE WHEN p_size > 40 THEN CAST('inf' AS DOUBLE) ELSE 1.0 END) AS diameter FROM part")
def metrics_mean(spark, sf):
    """Means of measures over graphs, a row each; an infinite one makes its mean infinite."""
    p = table(spark, sf, "part").select(F.col("p_size").alias("num_nodes"), F.when(F.col("p_size") > 40, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("diameter"))
    return graph.mean_metrics(p, ["num_nodes", "diameter"])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events""")
def iso_times(spark, sf):
    """Times as ISO-8601 with their zone."""
    return table(spark, sf, "events").select("event_id", tables.iso_time(F.col("ts")).alias("iso"))
