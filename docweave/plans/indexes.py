"""Queries over stored indexes, and over graphs by search."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import ann, graph, labels
from docweave.operators.scratch import shared_dir

from .base import registry, table

QUERIES, SQL, query = registry()


def _searched(spark, sf):
    """Of every hundredth row, the ten most similar rows by an index of 32 lists, of which 24 are probed; half of the rows are appended to it."""
    e = table(spark, sf, "embeddings")
    later = F.col("label") % 2 == 1
    index = ann.Index(spark, shared_dir(spark)).build(e.where(~later), 32).append(e.where(later))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(q, 10, 24).select(F.col("query_id").cast("long"), F.col("vec_id").cast("long").alias("vec_id"), "score", "rank")


@query()
def vector_ann_search(spark, sf):
    """About the ten rows most similar to every hundredth row."""
    return _searched(spark, sf).withColumn("score", F.round("score", 5))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_ann_recall(spark, sf):
    """Whether the index finds nine tenths of what the exact search does."""
    from docweave.operators import vector

    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    best = vector.search_many(e, q, 10).select("query_id", "vec_id")
    hit = best.join(_searched(spark, sf).select("query_id", "vec_id").withColumn("found", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.coalesce(F.sum("found"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


_BM25 = r"""
l AS (SELECT DISTINCT p_name || ' ' || p_type AS label FROM part), w AS (SELECT label, unnest(regexp_extract_all(lower(label), '[\p{L}\p{N}]+')) AS token FROM l),
n AS (SELECT label, count(*) AS len FROM w GROUP BY 1), a AS (SELECT count(*) AS n, avg(len) AS mean FROM n), t AS (SELECT label, token, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
s AS (SELECT label, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS weight FROM t JOIN d USING (token) JOIN n USING (label), a)"""


def _labels(spark, sf):
    named = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("entity_id"))
    return labels.LabelIndex(spark, shared_dir(spark), 8).build(named)


@query(f"""
WITH {_BM25}, r AS (SELECT label, round(sum(weight), 9) AS s FROM s WHERE token IN ('polished', 'steel', 'small') GROUP BY 1)
SELECT label, round(s, 6) AS score FROM r ORDER BY s DESC, label LIMIT 30""")
def kg_fulltext_labels(spark, sf):
    """The labels that answer three words best."""
    return _labels(spark, sf).search("Small POLISHED steel, small!", 30).select("label", F.round("score", 6).alias("score"))


@query(f"""
WITH {_BM25}, q AS (SELECT p_partkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[\\p{{L}}\\p{{N}}]+'))) AS token FROM part WHERE p_size = 7),
r AS (SELECT query_id, label, round(sum(weight), 6) AS score FROM q JOIN s USING (token) GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS place FROM r)
SELECT query_id, score, count(*) AS n FROM k WHERE place <= 3 GROUP BY 1, 2""")
def kg_fulltext_many(spark, sf):
    """The three greatest scores of many queries, and how many labels have each."""
    p = table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand").alias("query"))
    found = labels.search_many(_labels(spark, sf), p, 2_000_000_000).groupBy("query_id", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where("r <= 3").drop("r")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier UNION SELECT 'M' || c_mktsegment, 'N' || c_nationkey FROM customer),
b AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT DISTINCT x AS id FROM b),
w(x, y, d) AS (SELECT id, id, 0 FROM n UNION SELECT w.x, b.y, w.d + 1 FROM w JOIN b ON b.x = w.y WHERE w.d < 8), m AS (SELECT x, y, min(d) AS d FROM w GROUP BY ALL)
SELECT (SELECT count(*) FROM n) AS num_nodes, (SELECT count(*) FROM e) AS num_edges, CASE WHEN count(*) < (SELECT count(*) * count(*) FROM n) THEN CAST('inf' AS DOUBLE) ELSE CAST(max(d) AS DOUBLE) END AS diameter FROM m""")
def graph_diameter(spark, sf):
    """The diameter of a connected graph of suppliers, nations and segments."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    name = lambda p, c: F.concat(F.lit(p), c)
    e = s.select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("tgt")).unionByName(c.select(name("M", "c_mktsegment").alias("src"), name("N", "c_nationkey").alias("tgt")))
    nodes = e.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    return graph.metrics(nodes, e).select("num_nodes", "num_edges", "diameter")


_GRAPHS = """
WITH RECURSIVE c AS (SELECT c_nationkey AS g, 'C' || c_custkey AS c, 'M' || c_mktsegment AS m, c_acctbal > 5000 AS rich FROM customer),
every AS (SELECT DISTINCT g, least(a, b) AS src, greatest(a, b) AS tgt FROM (SELECT g, c AS a, m AS b FROM c UNION ALL SELECT g, c, 'A' FROM c WHERE rich UNION ALL SELECT g, m, 'A' FROM c WHERE rich)),
bad AS (SELECT DISTINCT g FROM every WHERE src = 'A' AND g IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)), e AS (SELECT * FROM every ANTI JOIN bad USING (g)),
b AS (SELECT g, src AS x, tgt AS y FROM e UNION ALL SELECT g, tgt, src FROM e), n AS (SELECT DISTINCT g, x AS id FROM b),
w(g, x, y, d) AS (SELECT g, id, id, 0 FROM n UNION SELECT w.g, w.x, b.y, w.d + 1 FROM w JOIN b ON b.g = w.g AND b.x = w.y WHERE w.d < 8), m AS (SELECT g, x, y, min(d) AS d FROM w GROUP BY ALL),
s AS (SELECT g, x, min(y) AS root FROM m GROUP BY ALL), z AS (SELECT g, root, count(*) AS size FROM s GROUP BY ALL), zz AS (SELECT g, count(*) AS num_components, max(size) AS giant_size FROM z GROUP BY 1),
k AS (SELECT g, x AS id, count(*) AS k FROM b GROUP BY ALL), t AS (SELECT p.g, p.x AS id, count(*) / 2 AS t FROM b p JOIN b q ON p.g = q.g AND p.x = q.x AND p.y <> q.y JOIN b r ON r.g = p.g AND r.x = p.y AND r.y = q.y GROUP BY ALL),
l AS (SELECT k.g, count(*) AS num_nodes, avg(k) AS average_degree, avg(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) END) AS average_clustering FROM k LEFT JOIN t USING (g, id) GROUP BY 1),
f AS (SELECT g, max(d) AS far FROM m GROUP BY 1), h AS (SELECT g, count(*) AS num_edges FROM e GROUP BY 1),
r AS (SELECT g AS graph, num_nodes, num_edges, round(average_degree, 6) AS average_degree, round(average_clustering, 6) AS average_clustering, num_components, giant_size,
    CASE WHEN num_components > 1 THEN CAST('inf' AS DOUBLE) ELSE CAST(far AS DOUBLE) END AS diameter FROM l JOIN zz USING (g) JOIN f USING (g) JOIN h USING (g))"""


def _many(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("graph"), F.concat(F.lit("C"), "c_custkey").alias("c"), F.concat(F.lit("M"), "c_mktsegment").alias("m"), (F.col("c_acctbal") > 5000).alias("rich"))
    pair = lambda df, a, b: df.select("graph", a.alias("src"), b.alias("tgt"))
    rich = c.where("rich")
    e = pair(c, F.col("c"), F.col("m")).unionByName(pair(rich, F.col("c"), F.lit("A"))).unionByName(pair(rich, F.col("m"), F.lit("A")))
    nodes = e.select("graph", F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    lame = table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("graph")).withColumn("lame", F.lit(True))
    nodes = nodes.join(lame, "graph", "left").where("lame is null or entity_id <> 'A'").drop("lame")  # graphs of region 0 lack a node
    return graph.many_metrics(nodes, e)


@query(f"""
{_GRAPHS} SELECT graph, num_nodes, num_edges, average_degree, average_clustering, num_components, giant_size, diameter, NULL AS error FROM r
UNION ALL SELECT g, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'an edge ends in no node: A' FROM bad""")
def graph_metrics_many(spark, sf):
    """Measures of a graph of each nation's customers, in one job; graphs that lack a node have an error."""
    m = _many(spark, sf).withColumns({c: F.round(c, 6) for c in ("average_degree", "average_clustering")})
    return m.select("graph", "num_nodes", "num_edges", "average_degree", "average_clustering", "num_components", "giant_size", "diameter", "error")


@query(f"{_GRAPHS} SELECT count(*) AS graphs, round(avg(num_nodes), 6) AS num_nodes, round(avg(average_clustering), 5) AS average_clustering, avg(diameter) AS diameter FROM r")
def graph_metrics_many_mean(spark, sf):
    """The means of the measures over the graphs that have any."""
    return graph.mean_metrics(_many(spark, sf).where("error is null"), ["num_nodes", "average_clustering", "diameter"]).withColumns({"num_nodes": F.round("num_nodes", 6), "average_clustering": F.round("average_clustering", 5)})
