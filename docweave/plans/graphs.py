"""Queries over the property graph of the supply tables: parts and suppliers, joined by the lines between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import graph, provenance, retrieval
from docweave.operators.scratch import written

from .base import registry, table

QUERIES, SQL, query = registry()

# Extracted records: a line is a chunk that names a part, a supplier and the relation between them.
_RECORDS = """
li AS (SELECT 'P' || l_partkey AS part, 'S' || l_suppkey AS supp, l_quantity AS weight, l_shipmode_ AS kw, 'c' || l_orderkey AS source_id, l_orderkey * 10 + l_linenumber AS seq,
       'f' || (l_orderkey % 50) AS file_path, l_returnflag || l_linestatus AS description, CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_linestatus
       FROM (SELECT *, l_returnflag || ',' || l_linestatus AS l_shipmode_ FROM lineitem))"""
_EDGES = f"{_RECORDS},\ne AS (SELECT part AS src, supp AS tgt, sum(weight) AS weight, count(*) AS n FROM li GROUP BY 1, 2)"
_NODES = "n AS (SELECT 'P' || p_partkey AS entity_id FROM part UNION ALL SELECT 'S' || s_suppkey FROM supplier)"
_DEGREES = "d AS (SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM e UNION ALL SELECT tgt FROM e) GROUP BY 1)"


def _records(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("P"), "l_partkey").alias("part"), F.concat(F.lit("S"), "l_suppkey").alias("supp"), F.col("l_quantity").alias("weight"), F.concat("l_returnflag", F.lit(","), "l_linestatus").alias("keywords"),
        F.concat(F.lit("c"), "l_orderkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("f"), F.col("l_orderkey") % 50).alias("file_path"),
        F.concat("l_returnflag", "l_linestatus").alias("description"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), "l_linestatus",
    )


def _edges(spark, sf):
    r = graph.canonical(_records(spark, sf).withColumnsRenamed({"part": "src", "supp": "tgt"}))
    return r.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def _nodes(spark, sf):
    parts = table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("entity_id"))
    return parts.unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id")))


@query(f"""
WITH {_RECORDS},
t AS (SELECT part, l_linestatus AS entity_type, count(*) AS n, min(seq) AS f FROM li GROUP BY 1, 2),
ty AS (SELECT part, arg_min(entity_type, row(-n, f)) AS entity_type FROM t GROUP BY 1),
s AS (SELECT part, source_id, min(seq) AS f FROM li GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY f DESC) AS k FROM s),
so AS (SELECT part, string_agg(source_id, ',' ORDER BY f) AS source_ids FROM sr WHERE k <= 10 GROUP BY 1),
fp AS (SELECT part, file_path, min(seq) AS f FROM li GROUP BY 1, 2),
fo AS (SELECT part, string_agg(file_path, ',' ORDER BY f) AS file_paths FROM fp GROUP BY 1),
de AS (SELECT part, description, arg_min(ts, seq) AS ts, min(seq) AS f FROM li GROUP BY 1, 2),
do_ AS (SELECT part, string_agg(description, ',' ORDER BY ts, -length(description), f) AS descriptions FROM de GROUP BY 1)
SELECT part AS entity_id, entity_type, source_ids, file_paths, descriptions FROM ty JOIN so USING (part) JOIN fo USING (part) JOIN do_ USING (part)""")
def kg_nodes_merge(spark, sf):
    """Records of parts merged: sources to the ten newest, mode of types, descriptions by time."""
    r = _records(spark, sf).withColumnsRenamed({"part": "entity_id", "l_linestatus": "entity_type"})
    m = graph.merge_nodes(r, limit=10)
    return m.select("entity_id", "entity_type", *(F.array_join(c, ",").alias(c) for c in ("source_ids", "file_paths", "descriptions")))


@query(f"""
WITH {_RECORDS},
k AS (SELECT part, supp, unnest(string_split(kw, ',')) AS w FROM li),
ko AS (SELECT part, supp, string_agg(DISTINCT w, ',' ORDER BY w) AS keywords FROM k GROUP BY 1, 2),
s AS (SELECT part, supp, source_id, min(seq) AS f FROM li GROUP BY 1, 2, 3),
so AS (SELECT part, supp, string_agg(source_id, ',' ORDER BY f) AS source_ids FROM s GROUP BY 1, 2),
w AS (SELECT part, supp, sum(weight) AS weight FROM li GROUP BY 1, 2)
SELECT part AS src, supp AS tgt, weight, keywords, source_ids FROM w JOIN ko USING (part, supp) JOIN so USING (part, supp)""")
def kg_edges_merge(spark, sf):
    """Records of relations merged: weights added, keywords sorted, sources in order."""
    m = graph.merge_edges(_records(spark, sf).withColumnsRenamed({"part": "src", "supp": "tgt"}), texts=False, paths=False)
    return m.select("src", "tgt", "weight", "keywords", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"""
WITH {_EDGES}, x AS (SELECT tgt AS entity_id, arg_min(src, src) AS first FROM e WHERE tgt IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY 1)
SELECT entity_id, 'UNKNOWN' AS entity_type, first AS description FROM x""")
def kg_missing_endpoints(spark, sf):
    """Ends of edges that are no nodes, made as unknown ones."""
    e = _edges(spark, sf).withColumn("description", F.col("src"))
    poor = table(spark, sf, "supplier").where("s_acctbal < 2000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    known = _nodes(spark, sf).join(poor, "entity_id", "left_anti")
    return graph.missing_endpoints(known, e)


@query(f"WITH {_EDGES}, {_NODES}, {_DEGREES} SELECT n.entity_id, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (entity_id)")
def kg_degrees(spark, sf):
    """Degrees of all nodes, zero for those without an edge."""
    return graph.with_degree(_nodes(spark, sf), _edges(spark, sf))


@query(f"WITH {_EDGES}, {_DEGREES} SELECT src, tgt, a.degree + b.degree AS degree FROM e JOIN d a ON src = a.entity_id JOIN d b ON tgt = b.entity_id")
def kg_edge_degrees(spark, sf):
    return graph.edge_degrees(_edges(spark, sf)).select("src", "tgt", "degree")


@query(f"""
WITH {_EDGES}, {_DEGREES}, s AS (SELECT 'S' || s_suppkey AS entity_id, round(s_acctbal, 1) AS score FROM supplier WHERE s_acctbal > 5000),
r AS (SELECT src, tgt, weight, a.degree + b.degree AS degree, score FROM e JOIN d a ON src = a.entity_id JOIN d b ON tgt = b.entity_id JOIN s ON s.entity_id = tgt)
SELECT src, tgt, CAST(row_number() OVER (ORDER BY score DESC, weight DESC, degree DESC, src, tgt) AS INTEGER) AS rank FROM r""")
def kg_edge_rank(spark, sf):
    """Edges of scored nodes by score, weight and degree."""
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.round("s_acctbal", 1).alias("score"))
    e = written(_edges(spark, sf))
    near = e.join(s.select(F.col("entity_id").alias("tgt")), "tgt", "left_semi")
    return graph.rank_edges(graph.edge_degrees_of(near, e), s).select("src", "tgt", "rank")


@query(f"WITH {_EDGES}, {_DEGREES} SELECT entity_id, degree FROM d ORDER BY degree DESC, entity_id LIMIT 300")
def kg_popular_labels(spark, sf):
    """The 300 labels of highest degree."""
    return graph.popular_labels(_edges(spark, sf))


@query("""
WITH l AS (SELECT p_name AS entity_id FROM part UNION SELECT s_name FROM supplier), s AS (SELECT entity_id, lower(entity_id) AS low FROM l WHERE contains(lower(entity_id), 'er'))
SELECT entity_id, CASE WHEN low = 'er' THEN 1000 WHEN starts_with(low, 'er') THEN 500
  ELSE 100 - length(entity_id) + CASE WHEN contains(low, ' er') OR contains(low, '_er') THEN 50 ELSE 0 END END AS score
FROM s ORDER BY score DESC, entity_id LIMIT 50""")
def kg_search_labels(spark, sf):
    """Labels of parts and suppliers that hold a string, best first."""
    return graph.search_labels(_labels(spark, sf), "er").withColumn("score", F.col("score").cast("long"))


def _labels(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("entity_id")).unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("entity_id"))).distinct()


@query("SELECT p_name AS entity_id FROM part UNION SELECT s_name FROM supplier ORDER BY 1")
def kg_all_labels(spark, sf):
    return _labels(spark, sf).orderBy("entity_id")


@query(f"""
WITH {_EDGES}, {_NODES}, {_DEGREES},
t AS (SELECT n.entity_id FROM n LEFT JOIN d USING (entity_id) ORDER BY coalesce(degree, 0) DESC, entity_id LIMIT (SELECT count(*) + 50 FROM supplier))
SELECT src, tgt, weight FROM e WHERE src IN (SELECT entity_id FROM t) AND tgt IN (SELECT entity_id FROM t)""")
def kg_star_subgraph(spark, sf):
    """Edges between the nodes of highest degree, fifty more than there are suppliers, so that parts are among them."""
    most = table(spark, sf, "supplier").count() + 50
    return graph.top_subgraph(_nodes(spark, sf), written(_edges(spark, sf)), most)[1].select("src", "tgt", "weight")


@query(f"""
WITH {_EDGES}, {_DEGREES},
b AS (SELECT src AS x, tgt AS y FROM e UNION ALL SELECT tgt, src FROM e),
l1 AS (SELECT y AS entity_id FROM b WHERE x = 'S1'),
l2 AS (SELECT DISTINCT y AS entity_id FROM b WHERE x IN (SELECT entity_id FROM l1) AND y <> 'S1' AND y NOT IN (SELECT entity_id FROM l1))
SELECT 'S1' AS entity_id, 0 AS level UNION ALL SELECT entity_id, 1 FROM l1 UNION ALL SELECT entity_id, 2 FROM l2""")
def kg_bfs_2hop(spark, sf):
    """Nodes within two steps of a supplier, by level."""
    return graph.neighbourhood(_nodes(spark, sf), written(_edges(spark, sf)), "S1", 2, None)[0]


@query(f"""
WITH {_EDGES}, m AS (SELECT src, CASE WHEN tgt IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 6000) THEN 'S0' ELSE tgt END AS tgt, weight FROM e)
SELECT src, tgt, max(weight) AS weight FROM m GROUP BY 1, 2""")
def kg_merge_entities(spark, sf):
    """The richest suppliers made one: pairs that meet keep the greatest weight."""
    e = _edges(spark, sf).withColumns({"keywords": F.lit(""), "description": F.lit("")})
    names = table(spark, sf, "supplier").where("s_acctbal > 6000").select(F.concat(F.lit("S"), "s_suppkey").alias("source"), F.lit("S0").alias("target"))
    return graph.merge_entities(e, names).select("src", "tgt", "weight")


@query(f"""
WITH {_EDGES}, {_NODES}, g AS (SELECT 'S' || s_suppkey AS entity_id FROM supplier WHERE s_acctbal < 3000)
SELECT (SELECT count(*) FROM n ANTI JOIN g USING (entity_id)) AS n_nodes, count(*) AS n_edges, sum(weight) AS weight FROM e WHERE tgt NOT IN (SELECT entity_id FROM g)""")
def kg_delete_cascade(spark, sf):
    """Suppliers of a low balance deleted, with their edges."""
    gone = table(spark, sf, "supplier").where("s_acctbal < 3000").select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"))
    n, e = graph.delete_nodes(_nodes(spark, sf), _edges(spark, sf), gone)
    return n.agg(F.count("*").alias("n_nodes")).join(e.agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight")))


@query(f"WITH {_EDGES} SELECT src, tgt, weight FROM e WHERE weight >= 20")
def kg_delete_edges(spark, sf):
    """Edges deleted by pairs given in reverse."""
    e = _edges(spark, sf)
    gone = e.where("weight < 20").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return graph.delete_edges(e, gone).select("src", "tgt", "weight")


@query(f"""
WITH {_RECORDS}, c AS (SELECT part, count(DISTINCT source_id) AS n_before, count(DISTINCT CASE WHEN o_orderstatus <> 'F' THEN source_id END) AS n_after FROM li JOIN orders ON source_id = 'c' || o_orderkey GROUP BY 1)
SELECT part, n_before, n_after, CASE WHEN n_after = 0 THEN 'delete' WHEN n_after < n_before THEN 'rebuild' ELSE 'keep' END AS action FROM c""")
def kg_delete_doc_classify(spark, sf):
    """What deleting the chunks of finished orders does to each part."""
    owned = _records(spark, sf).select("part", F.col("source_id").alias("chunk_id")).distinct()
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"))
    return graph.classify_deletion(owned, gone, ["part"])


@query(f"WITH {_EDGES} SELECT CASE WHEN tgt = 'S1' THEN least(src, 'A supplier') ELSE src END AS src, CASE WHEN tgt = 'S1' THEN greatest(src, 'A supplier') ELSE tgt END AS tgt, weight FROM e")
def kg_rename(spark, sf):
    """A supplier under another name; its edges are put in order again."""
    return graph.rename(_nodes(spark, sf), _edges(spark, sf), "S1", "A supplier")[1].select("src", "tgt", "weight")


@query(f"""
WITH {_RECORDS}, m AS (SELECT source_id, arg_min(part, row(seq, part)) AS main FROM li GROUP BY 1)
SELECT DISTINCT part AS src, main AS tgt, CAST(10.0 AS DOUBLE) AS weight, source_id AS chunk_id FROM li JOIN m USING (source_id) WHERE part <> main""")
def kg_belongs_to(spark, sf):
    """Edges from a chunk's entities to its main one."""
    r = _records(spark, sf)
    main = r.groupBy(F.col("source_id").alias("chunk_id")).agg(F.min_by("part", F.struct("seq", "part")).alias("main"))
    return graph.belongs_to(r.select(F.col("source_id").alias("chunk_id"), F.col("part").alias("entity_name")), main).select("src", "tgt", "weight", "chunk_id")


@query(f"WITH {_EDGES} SELECT src, tgt, weight FROM e UNION ALL SELECT tgt, src, weight FROM e")
def kg_export_pairs(spark, sf):
    """Edges in both directions."""
    return graph.export_pairs(_edges(spark, sf).select("src", "tgt", "weight"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'C' || c_custkey AS a, 'N' || c_nationkey || '-' || c_mktsegment AS b FROM customer WHERE c_acctbal > 0),
n AS (SELECT 'C' || c_custkey AS id FROM customer UNION SELECT b FROM e),
d AS (SELECT id, count(*) FILTER (a IS NOT NULL) AS g FROM n LEFT JOIN (SELECT a, a AS k FROM e UNION ALL SELECT b, b FROM e) x ON id = x.k GROUP BY id)
SELECT count(*) AS num_nodes, CAST(sum(g) // 2 AS BIGINT) AS num_edges, round(avg(g), 6) AS average_degree, count(*) FILTER (g = 0) AS isolated, count(*) FILTER (g > 1) AS degree_over_1,
       (SELECT count(DISTINCT b) FROM e) + count(*) FILTER (g = 0) AS num_components, (SELECT max(c) + 1 FROM (SELECT count(*) AS c FROM e GROUP BY b)) AS giant_size, CAST(0.0 AS DOUBLE) AS average_clustering
FROM d""")
def graph_metrics_basic(spark, sf):
    """Sizes, degrees, components and clustering of a graph of customers and their segments."""
    c = table(spark, sf, "customer")
    n = F.concat(F.lit("N"), "c_nationkey", F.lit("-"), "c_mktsegment")
    e = graph.canonical(c.where("c_acctbal > 0").select(F.concat(F.lit("C"), "c_custkey").alias("src"), n.alias("tgt")))
    nodes = c.select(F.concat(F.lit("C"), "c_custkey").alias("entity_id")).unionByName(e.select(F.col("tgt").alias("entity_id"))).distinct()
    m = graph.metrics(nodes, e).withColumn("average_degree", F.round("average_degree", 6))
    return m.select("num_nodes", "num_edges", "average_degree", "isolated", "degree_over_1", "num_components", "giant_size", "average_clustering")


# Retrieval. Hits are suppliers, ranked by balance.
_HITS = "h AS (SELECT 'S' || s_suppkey AS entity_id, s_acctbal AS score, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10)"


def _hits(spark, sf):
    from pyspark.sql import Window

    top = table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10)
    over = Window.orderBy(F.desc("s_acctbal"), "s_suppkey")
    return top.select(F.concat(F.lit("S"), "s_suppkey").alias("entity_id"), F.col("s_acctbal").alias("score"), F.row_number().over(over).alias("rank"))


@query(f"""
WITH {_EDGES}, {_DEGREES}, {_HITS}
SELECT src, tgt, weight, a.degree + b.degree AS degree, CAST(row_number() OVER (ORDER BY score DESC, weight DESC, a.degree + b.degree DESC, src, tgt) AS INTEGER) AS rank
FROM e JOIN h ON tgt = h.entity_id JOIN d a ON src = a.entity_id JOIN d b ON tgt = b.entity_id""")
def local_retrieval(spark, sf):
    """Edges of entity hits, ranked."""
    return retrieval.local(_hits(spark, sf), _nodes(spark, sf), written(_edges(spark, sf)))[1].select("src", "tgt", "weight", "degree", "rank")


@query(f"""
WITH {_EDGES}, t AS (SELECT src, tgt, row_number() OVER (ORDER BY weight DESC, src, tgt) AS rank FROM e ORDER BY weight DESC, src, tgt LIMIT 40),
x AS (SELECT src AS entity_id, rank, 0 AS pos FROM t UNION ALL SELECT tgt, rank, 1 FROM t),
f AS (SELECT entity_id, min(rank * 2 + pos) AS f FROM x GROUP BY 1)
SELECT entity_id, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS position FROM f""")
def global_retrieval(spark, sf):
    """Ends of relation hits in the order they are first seen."""
    from pyspark.sql import Window

    e = _edges(spark, sf)
    top = e.orderBy(F.desc("weight"), "src", "tgt").limit(40).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "src", "tgt"))).select("src", "tgt", "rank")
    return retrieval.global_(top, _nodes(spark, sf), e)[1].select("entity_id", "position")


@query(f"""
WITH {_RECORDS}, {_HITS},
c AS (SELECT h.rank - 1 AS item, li.source_id AS chunk_id, min(seq) AS pos FROM li JOIN h ON supp = h.entity_id GROUP BY 1, 2),
o AS (SELECT chunk_id, count(*) AS occurrences, arg_min(row(item, pos), row(item, pos)) AS f FROM c GROUP BY 1),
p AS (SELECT chunk_id, f[1] AS item, row_number() OVER (PARTITION BY f[1] ORDER BY occurrences DESC, f[2], chunk_id) AS place FROM o),
n AS (SELECT count(DISTINCT item) AS n FROM p),
q AS (SELECT p.*, CASE WHEN n = 1 THEN 5 ELSE CAST(round_even(5 - item / (n - 1)::DOUBLE * 4, 0) AS INTEGER) END AS quota FROM p, n),
k AS (SELECT *, CASE WHEN place > quota THEN 1 ELSE 0 END AS late, sum(CASE WHEN place = 1 THEN quota ELSE 0 END) OVER () - sum(CASE WHEN place <= quota THEN 1 ELSE 0 END) OVER () AS spare FROM q),
m AS (SELECT *, row_number() OVER (PARTITION BY late ORDER BY item, place) AS j FROM k),
r AS (SELECT *, row_number() OVER (ORDER BY late, item, place) AS pick FROM m WHERE late = 0 OR j <= spare),
t AS (SELECT chunk_id, 'f' || (CAST(substring(chunk_id, 2) AS BIGINT) % 50) AS file_path, pick, sum(length(chunk_id) * 20) OVER (ORDER BY pick) AS used FROM r),
w AS (SELECT * FROM t WHERE used <= 2000),
g AS (SELECT file_path, row_number() OVER (ORDER BY count(*) DESC, min(pick)) AS reference_id FROM w GROUP BY 1)
SELECT 'DC' || pick AS id, chunk_id, file_path, CAST(reference_id AS VARCHAR) AS reference_id FROM w JOIN g USING (file_path)""")
def mix_context(spark, sf):
    """Chunks of entity hits picked by weight, packed in a token budget, with reference ids."""
    r, hits = _records(spark, sf), _hits(spark, sf)
    items = hits.select("entity_id", (F.col("rank") - 1).alias("item_rank"))
    owned = r.groupBy(F.col("supp").alias("entity_id"), F.col("source_id").alias("chunk_id")).agg(F.min("seq").alias("position"))
    picked = retrieval.related_chunks(items, owned, "entity_id", 5)
    chunks = picked.select("chunk_id", F.repeat("chunk_id", F.lit(20)).alias("content"), F.concat(F.lit("f"), F.substring("chunk_id", 2, 20).cast("long") % 50).alias("file_path"), F.col("pick").alias("position"))
    return retrieval.context(chunks, 2000).select("id", "chunk_id", "file_path", "reference_id")


@query(f"""
WITH {_RECORDS}, o AS (SELECT DISTINCT supp, source_id FROM li), g AS (SELECT DISTINCT source_id FROM li WHERE part IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 10))
SELECT supp, count(*) AS n FROM o ANTI JOIN g USING (source_id) GROUP BY 1""")
def chunks_excluded(spark, sf):
    """Chunks of relations without those that entities gave already."""
    r = _records(spark, sf)
    small = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("P"), "p_partkey").alias("part"))
    gone = r.join(small, "part", "left_semi").select("source_id").distinct()
    return r.select("supp", "source_id").distinct().join(gone, "source_id", "left_anti").groupBy("supp").agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "SQL", "provenance"]
