"""Queries of lookups, names, loads and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import names, prompts
from docweave.functions.fixed_values import REFERENCE_MARKER
from docweave.operators import answering, graph, models, tables
from docweave.operators.scratch import written
from docweave.sources import files, knowledge

from .base import registry, table
from .graphs import _DEGREES, _EDGES, _edges, _nodes

QUERIES, SQL, query = registry()


@query("SELECT doc_id, substring(text, 1, 256) AS identifier, length(text) > 256 AS cut FROM documents")
def identifiers_cut(spark, sf):
    """Texts as identifiers, which have 256 characters at most."""
    return table(spark, sf, "documents").select("doc_id", names.short_identifier(F.col("text")).alias("identifier"), (F.length("text") > 256).alias("cut"))


@query("SELECT 'status' AS by, count(*) AS n, min(doc_id) AS least FROM documents WHERE lang = 'de' UNION ALL SELECT 'track', count(*), min(doc_id) FROM documents WHERE lang = 'fr' AND source = 'src3' UNION ALL SELECT 'file', count(*), min(doc_id) FROM documents WHERE source = 'src5'")
def documents_selected(spark, sf):
    """Documents of a status, of a status and a track, and of a file."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("status"), F.col("source").alias("track_id"), F.col("source").alias("file_path"))
    of = {"status": tables.selected(d, "de"), "track": tables.selected(d, "fr", "src3"), "file": tables.selected(d, file_path="src5")}
    out = None
    for k, df in of.items():
        one = df.agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).select(F.lit(k).alias("by"), "n", "least")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_EDGES}, i AS (SELECT DISTINCT 'P' || l_suppkey AS entity_id FROM lineitem UNION SELECT 'X' || s_suppkey FROM supplier) SELECT entity_id, entity_id IN (SELECT 'P' || p_partkey FROM part) AS found FROM i")
def kg_has_nodes(spark, sf):
    """Which of many names are nodes."""
    ids = table(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_suppkey").alias("entity_id")).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("X"), "s_suppkey").alias("entity_id"))).distinct()
    return graph.has_nodes(_nodes(spark, sf), ids)


@query(f"WITH {_EDGES} SELECT src, tgt, weight FROM e JOIN (SELECT DISTINCT 'P' || c_custkey AS src, 'S' || (c_nationkey + 1) AS tgt FROM customer) USING (src, tgt)")
def kg_get_edges(spark, sf):
    """The edges of many pairs, given from their second end to their first."""
    pairs = table(spark, sf, "customer").select(F.concat(F.lit("S"), F.col("c_nationkey") + 1).alias("src"), F.concat(F.lit("P"), "c_custkey").alias("tgt"))
    return graph.get_edges(_edges(spark, sf), pairs).select("src", "tgt", "weight")


@query(f"WITH {_EDGES}, b AS (SELECT src AS entity_id, tgt AS other, weight FROM e UNION ALL SELECT tgt, src, weight FROM e) SELECT entity_id, other, weight FROM b WHERE entity_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 8000)")
def kg_node_edges(spark, sf):
    """The edges of many nodes."""
    rich = table(spark, sf, "supplier").where("s_acctbal > 8000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    return graph.node_edges(_edges(spark, sf), rich).select("entity_id", "other", "weight")


@query(f"WITH {_EDGES}, v AS (SELECT 'P' || p_partkey AS a, 'S' || (p_size + 1) AS b, p_retailprice AS x FROM part) SELECT src, tgt, weight, x IS NOT NULL AS has_vector FROM e LEFT JOIN v ON src = a AND tgt = b")
def kg_relation_info(spark, sf):
    """Edges, and whether they have a vector; vectors name their ends in the other order."""
    v = table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_size") + 1).alias("src"), F.concat(F.lit("P"), "p_partkey").alias("tgt"), F.array("p_retailprice").alias("embedding"))
    return graph.relation_info(_edges(spark, sf), v).select("src", "tgt", "weight", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"""
WITH {_EDGES}, {_DEGREES}, n AS (SELECT 'P' || p_partkey AS entity_id FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier),
t AS (SELECT n.entity_id FROM n LEFT JOIN d USING (entity_id) ORDER BY coalesce(degree, 0) DESC, entity_id LIMIT 150)
SELECT src, tgt, weight FROM e WHERE src IN (SELECT entity_id FROM t) AND tgt IN (SELECT entity_id FROM t)""")
def kg_overview(spark, sf):
    """What an overview of the graph shows: edges between its 150 nodes of highest degree."""
    return graph.label_subgraph(_nodes(spark, sf), written(_edges(spark, sf)), "*", most=150)[1].select("src", "tgt", "weight")


@query(r"""
WITH n AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^\p{L}\p{M}\p{N}\p{Pc}.\-]+', '_', 'g'), '^\.+', '') AS n FROM pages)
SELECT page_id, CASE WHEN replace(n, '_', '') = '' THEN 'unnamed' ELSE substring(n, 1, 200) END AS name FROM n""")
def safe_file_names(spark, sf):
    """File names of addresses."""
    return table(spark, sf, "pages").select("page_id", prompts.safe_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, CASE WHEN floor(p_size * p_partkey * 3 / 4) > 0 THEN CAST(floor(p_size * p_partkey * 3 / 4) AS BIGINT) + 2 END AS tokens FROM part")
def image_token_counts(spark, sf):
    """Tokens of images by their grids of patches."""
    return table(spark, sf, "part").select("p_partkey", prompts.image_tokens(F.col("p_size"), F.col("p_partkey"), F.lit(3)).cast("long").alias("tokens"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END AS n, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '[1] ' || o_orderkey || '|[2] ' || o_orderpriority END AS lines FROM orders")
def reference_lines_of_answers(spark, sf):
    """The lines of the fenced list behind the mark of references; answers of finished orders have no mark."""
    block = F.concat(F.lit("```text\n[1] "), "o_orderkey", F.lit("\n\n  [2] "), "o_orderpriority", F.lit("\n```\nbye"))
    text = F.when(F.col("o_orderstatus") == "F", block).otherwise(F.concat(F.lit("An answer.\n" + REFERENCE_MARKER + "\n"), block))
    lines = prompts.reference_lines(text)
    return table(spark, sf, "orders").select("o_orderkey", F.size(lines).alias("n"), F.array_join(lines, "|").alias("lines"))


@query("SELECT source AS document, arg_max(lang || doc_id, row(n_chars, lang || doc_id)) AS path FROM documents GROUP BY 1")
def latest_outputs(spark, sf):
    """Of each source's files the newest."""
    d = table(spark, sf, "documents").select(F.col("source").alias("document"), F.concat("lang", "doc_id").alias("path"), F.col("n_chars").alias("modificationTime"))
    return files.latest_output(d)


@query("SELECT text AS context, min(conv_id * 1000 + turn) AS position FROM conversations GROUP BY 1")
def contexts_unique(spark, sf):
    """Distinct turns, and where they are first."""
    return knowledge.unique_contexts(table(spark, sf, "conversations").select(F.col("text").alias("context"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position")))


@query("""
WITH p AS (SELECT doc_id, string_split(text, '. ') AS a FROM documents WHERE text <> ''), c AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS c FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_order_index, 'chunk-' || md5(trim(c, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS chunk_id FROM c WHERE trim(c, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) <> ''""")
def chunks_loaded(spark, sf):
    """Chunks that come ready, with ids and their order."""
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", F.split("text", r"\. ").alias("text_chunks"))
    return knowledge.load_chunks(d).select("doc_id", "chunk_order_index", "chunk_id")


@query("""
WITH a AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 0 AS k FROM orders WHERE o_orderstatus = 'O'),
b AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, 1 AS k FROM orders WHERE o_orderpriority < '3'),
d AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank, 2 AS k FROM orders),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY c, o ORDER BY rank, k) AS n FROM u)
SELECT c AS query_id, CAST(o AS VARCHAR) AS chunk_id, CAST(row_number() OVER (PARTITION BY c ORDER BY rank, k, CAST(o AS VARCHAR)) AS INTEGER) AS position, ['C', 'E', 'R'][k + 1] AS source FROM f WHERE n = 1""")
def chunks_of_three_searches(spark, sf):
    """Chunks of three searches taken in turn, and which search each came from."""
    o = table(spark, sf, "orders").withColumns({"query_id": F.col("o_custkey"), "chunk_id": F.col("o_orderkey").cast("string")})
    rank = lambda df, *by: df.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).alias("rank"))
    lists = rank(o.where("o_orderstatus = 'O'"), F.desc("o_totalprice"), "o_orderkey"), rank(o.where("o_orderpriority < '3'"), "o_orderdate", "o_orderkey"), rank(o, F.desc("o_orderkey"))
    return answering.merged_chunks(*lists)


_CACHE = """
c AS (SELECT CASE WHEN turn < 4 THEN 'default' ELSE 'mix' END || ':' || CASE WHEN role = 'user' THEN 'extract' WHEN length(text) > 200 THEN 'summary' ELSE 'query' END || ':' || md5(text) AS cache_key, text AS answer, conv_id AS create_time FROM conversations)"""


@query(f"WITH {_CACHE}, t AS (SELECT DISTINCT cache_key FROM c WHERE create_time < 10) SELECT cache_key, max(create_time) AS create_time FROM c WHERE (cache_key LIKE 'default:extract:%' OR cache_key LIKE 'default:summary:%') AND cache_key NOT IN (SELECT cache_key FROM t) GROUP BY 1")
def cache_migrated(spark, sf):
    """Answers that another cache lacks and may take."""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "extract").when(F.length("text") > 200, "summary").otherwise("query")
    cache = c.select(F.concat(F.when(F.col("turn") < 4, "default").otherwise("mix"), F.lit(":"), kind, F.lit(":"), F.md5("text")).alias("cache_key"), F.col("text").alias("answer"), F.col("conv_id").alias("create_time"))
    return models.migrated(cache, cache.where("create_time < 10")).select("cache_key", "create_time")


@query("""
WITH a AS (SELECT l_orderkey AS k, list(DISTINCT 'o' || l_suppkey ORDER BY 'o' || l_suppkey) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT 'o' || l_suppkey ORDER BY 'o' || l_suppkey) AS b FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
j AS (SELECT o_orderkey AS k, coalesce(a, []) AS a, coalesce(b, []) AS b FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey)
SELECT CAST(k AS VARCHAR) AS chunk_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS keys FROM j""")
def cache_lists_extended(spark, sf):
    """Lists of cache keys of chunks, with those that later calls add."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("chunk_id"), F.concat(F.lit("o"), "l_suppkey").alias("cache_key"), "l_returnflag")
    old = li.where("l_returnflag = 'A'").groupBy("chunk_id").agg(F.array_sort(F.collect_set("cache_key")).alias("llm_cache_list"))
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("chunk_id")).join(old, "chunk_id", "left")
    return tables.extend_cache_lists(chunks, li.where("l_returnflag <> 'A'")).select("chunk_id", F.array_join("llm_cache_list", ",").alias("keys"))
