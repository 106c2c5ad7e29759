"""Queries over keyed tables and ordered lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.operators import graph, provenance, tables

from .base import registry, table

QUERIES, SQL, query = registry()

# Of each part the orders of its lines: `old` of line numbers up to 2, `new` of 2 and more, in the order of order keys.
_LISTS = """
l AS (SELECT l_partkey AS p, 'c' || l_orderkey AS id, l_orderkey AS o, l_linenumber AS n FROM lineitem),
old AS (SELECT p, id, min(o) AS pos FROM l WHERE n <= 2 GROUP BY p, id),
new AS (SELECT p, id, min(o) AS pos FROM l WHERE n >= 2 GROUP BY p, id)"""


def _lists(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_set(F.when(keep, F.col("o")))), lambda o: F.concat(F.lit("c"), o))
    return li.groupBy("p").agg(ordered(F.col("n") <= 2).alias("old"), ordered(F.col("n") >= 2).alias("new"))


_MERGED = "m AS (SELECT p, id, CASE WHEN o.pos IS NULL THEN 1 ELSE 0 END AS late, coalesce(o.pos, n.pos) AS pos FROM old o FULL JOIN new n USING (p, id))"


@query(f"WITH {_LISTS}, {_MERGED} SELECT p, string_agg(id, ',' ORDER BY late, pos) AS ids FROM m GROUP BY p")
def source_ids_merge(spark, sf):
    """Old ids, then those that are new."""
    return _lists(spark, sf).select("p", F.array_join(provenance.merge_ids(F.col("old"), F.col("new")), ",").alias("ids"))


def _limited(order: str) -> str:
    return f"""WITH {_LISTS}, {_MERGED}, r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY late {order}, pos {order}) AS k FROM m)
SELECT p, string_agg(id, ',' ORDER BY late, pos) AS ids FROM r WHERE k <= 5 GROUP BY p"""


@query(_limited("DESC"))
def source_ids_fifo(spark, sf):
    """The five newest ids."""
    return _lists(spark, sf).select("p", F.array_join(provenance.limit_ids(provenance.merge_ids(F.col("old"), F.col("new")), 5), ",").alias("ids"))


@query(_limited("ASC"))
def source_ids_keep(spark, sf):
    """The five oldest ids."""
    return _lists(spark, sf).select("p", F.array_join(provenance.limit_ids(provenance.merge_ids(F.col("old"), F.col("new")), 5, "KEEP"), ",").alias("ids"))


@query(f"""WITH {_LISTS}, s AS (SELECT o.* FROM old o ANTI JOIN new n USING (p, id)), k AS (SELECT DISTINCT p FROM l)
SELECT k.p, coalesce(string_agg(id, ',' ORDER BY pos), '') AS ids FROM k LEFT JOIN s USING (p) GROUP BY k.p""")
def source_ids_subtract(spark, sf):
    """Old ids that are not new."""
    return _lists(spark, sf).select("p", F.array_join(provenance.subtract_ids(F.col("old"), F.col("new")), ",").alias("ids"))


@query(f"""WITH {_LISTS}, k AS (SELECT DISTINCT p FROM l),
i AS (SELECT p, id, pos, 0 AS late FROM old o SEMI JOIN new n USING (p, id) UNION ALL SELECT p, id, pos, 1 FROM new n ANTI JOIN old o USING (p, id))
SELECT k.p, coalesce(string_agg(id, ',' ORDER BY late, pos), '') AS ids FROM k LEFT JOIN i USING (p) GROUP BY k.p""")
def source_ids_incremental(spark, sf):
    """A full list (here the old one) brought from old to new."""
    return _lists(spark, sf).select("p", F.array_join(provenance.incremental_ids(F.col("old"), F.col("old"), F.col("new")), ",").alias("ids"))


@query(f"WITH {_LISTS}, {_MERGED} SELECT p, count(*) AS n, CASE WHEN count(*) > 3 THEN '...truncated...(FIFO)' END AS mark FROM m GROUP BY p")
def file_path_limit(spark, sf):
    """Paths up to a limit, with a mark if there are more."""
    ids = provenance.merge_ids(F.col("old"), F.col("new"))
    paths = provenance.merge_paths(ids, 3)
    return _lists(spark, sf).select("p", F.size(ids).cast("long").alias("n"), F.when(F.element_at(paths, -1).startswith("..."), F.element_at(paths, -1)).alias("mark"))


@query("""
WITH s AS (SELECT c_custkey, c_acctbal AS v, 0 AS version, c_nationkey AS created FROM customer WHERE c_acctbal > 1000),
n AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS v, CAST(max(o_orderkey) AS BIGINT) AS version FROM orders GROUP BY 1)
SELECT coalesce(n.c_custkey, s.c_custkey) AS id, coalesce(n.v, s.v) AS v, coalesce(s.created, -1) AS create_time FROM s FULL JOIN n ON s.c_custkey = n.c_custkey""")
def upsert_latest(spark, sf):
    """Rows replaced by the last of their key, times of creation kept."""
    c = table(spark, sf, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("version"), F.col("c_nationkey").alias("create_time"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("version"), F.lit(-1).alias("create_time"))
    return tables.upsert(c, o, ["id"], "version").select("id", "v", "create_time")


@query("""
SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(c_name, s_name) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, s_acctbal) AS balance
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def node_attr_merge(spark, sf):
    """Attributes that a new row leaves out keep their value."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance"))
    return tables.merge_columns(s, c, ["id"])


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) + CAST(o_totalprice AS BIGINT) % 100 AS cost FROM orders),
s AS (SELECT *, sum(cost) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM r)
SELECT o_custkey, o_orderkey FROM s WHERE used <= 300""".replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)"))
def token_budget_prefix(spark, sf):
    """The rows of a list that a budget holds, up to the first that it doesn't."""
    o = table(spark, sf, "orders").withColumn("cost", F.length("o_orderpriority") + F.floor("o_totalprice") % 100)
    return provenance.within_budget(o, F.col("cost"), [F.col("o_orderkey")], 300, ["o_custkey"]).select("o_custkey", "o_orderkey")


# Three ranked lists a customer: orders by price, by date and by key.
_RANKED = """
a AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, 0 AS list_no FROM orders),
b AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank, 1 AS list_no FROM orders WHERE o_orderstatus = 'O'),
d AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank, 2 AS list_no FROM orders WHERE o_orderpriority < '3')"""


@query(f"""
WITH {_RANKED}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY c, o ORDER BY rank, list_no) AS k FROM u)
SELECT c, o, CAST(row_number() OVER (PARTITION BY c ORDER BY rank, list_no, o) AS INTEGER) AS position FROM f WHERE k = 1""")
def round_robin_merge(spark, sf):
    """Three ranked lists merged in turn, each key once."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    rank = lambda df, *by: df.select("c", "o", F.row_number().over(Window.partitionBy("c").orderBy(*by)).alias("rank"))
    lists = [rank(o, F.desc("o_totalprice"), "o"), rank(o.where("o_orderstatus = 'O'"), "o_orderdate", "o"), rank(o.where("o_orderpriority < '3'"), F.desc("o"))]
    return provenance.round_robin(lists, "o", by=["c"]).select("c", "o", "position")


# Items are a customer's orders by key, chunks the parts of their lines.
_ITEMS = """
i AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS item FROM orders),
x AS (SELECT i.c, i.item, l_linenumber AS pos, l_partkey AS chunk FROM i JOIN lineitem ON l_orderkey = o)"""


def _items(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    o = o.withColumn("item", F.row_number().over(Window.partitionBy("c").orderBy("o")) - 1)
    return o.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("chunk")), "o").drop("o")


@query(f"""
WITH {_ITEMS}
SELECT c, chunk, count(*) AS occurrences, CAST(min(item) AS INTEGER) AS item FROM x GROUP BY c, chunk""")
def chunk_occurrence(spark, sf):
    """How many of a list's items a chunk occurs in, and the first."""
    return provenance.occurrences(_items(spark, sf), "item", "pos", "chunk", ["c"]).select("c", "chunk", "occurrences", "item")


@query(f"""
WITH {_ITEMS},
w AS (SELECT *, row_number() OVER (PARTITION BY c, item ORDER BY pos, chunk) AS k, max(item) OVER (PARTITION BY c) AS top, (SELECT count(DISTINCT y.item) FROM x y WHERE y.c = x.c) AS n FROM x),
t AS (SELECT *, CASE WHEN n = 1 THEN 4 ELSE CAST(round_even(4 - item / (n - 1)::DOUBLE * 3, 0) AS INTEGER) END AS quota FROM w),
q AS (SELECT *, CASE WHEN k > quota THEN 1 ELSE 0 END AS late, sum(CASE WHEN k = 1 THEN quota ELSE 0 END) OVER (PARTITION BY c) - sum(CASE WHEN k <= quota THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS spare FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY c, late ORDER BY item, pos, chunk) AS m FROM q)
SELECT c, item, chunk, CAST(pos AS INTEGER) AS pos FROM r WHERE late = 0 OR m <= spare""")
def weighted_polling(spark, sf):
    """Chunks picked by quotas from four down to one, what is unused handed to chunks left over."""
    return provenance.weighted_polling(_items(spark, sf), "item", "pos", "chunk", 4, 1, ["c"]).select("c", "item", "chunk", "pos")


@query("""
WITH s AS (SELECT user_id, event_type AS path, event_id AS pos FROM events),
g AS (SELECT user_id, path, count(*) AS n, min(pos) AS f FROM s WHERE path <> 'signup' GROUP BY 1, 2)
SELECT user_id, path, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, path) AS VARCHAR) AS reference_id FROM g""")
def reference_list(spark, sf):
    """File paths numbered by how often they are cited; unknown sources have no number."""
    e = table(spark, sf, "events")
    path = F.when(F.col("event_type") == "signup", "unknown_source").otherwise(F.col("event_type"))
    return provenance.reference_list(e.select("user_id", path.alias("path"), "event_id"), "path", "event_id", ["user_id"])


def _rerank(how: str, sql: str):
    def run(spark, sf):
        r = provenance.rerank_scores(table(spark, sf, "events"), "user_id", "event_id", "value", how)
        return r.withColumn("relevance_score", F.round("relevance_score", 6))

    run.__name__ = f"rerank_agg_{how}"
    query(f"SELECT user_id, round({sql}, 6) AS relevance_score FROM events GROUP BY user_id")(run)


for _how, _sql in (("max", "max(value)"), ("mean", "avg(value)"), ("first", "arg_min(value, event_id)")):
    _rerank(_how, _sql)


@query("""
WITH m AS (SELECT p_brand AS k, p_partkey AS o, p_name, p_type, p_size FROM part)
SELECT k, string_agg(p_name, chr(10) ORDER BY o) AS names, arg_min(p_type, o) AS first_type, arg_max(p_type, o) AS last_type, max(p_size) AS size FROM m GROUP BY k""")
def attributes_merge(spark, sf):
    """Columns of merged rows, each by its rule."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_name").alias("names"), F.col("p_type").alias("first_type"), F.col("p_type").alias("last_type"), F.col("p_size").alias("size"))
    out = graph.merge_attributes(p, "p_brand", "p_partkey", {"names": "concatenate", "first_type": "keep_first", "last_type": "keep_last", "size": "max"})
    return out.withColumnRenamed("p_brand", "k")


@query("""
WITH c AS (SELECT l_orderkey AS id, min(l_suppkey) AS least FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey, coalesce(CAST(least AS VARCHAR), 'UNKNOWN') AS source FROM orders LEFT JOIN c ON o_orderkey = id""")
def source_map_join(spark, sf):
    """Sources looked up; unknown ones are UNKNOWN."""
    c = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").cast("string").alias("s"))
    return table(spark, sf, "orders").select("o_orderkey").join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("s", F.lit("UNKNOWN")).alias("source"))


@query("""
WITH c AS (SELECT split_part(k, ':', 1) AS mode, split_part(k, ':', 2) AS cache_type FROM (SELECT event_type || ':' || CASE WHEN user_id % 2 = 0 THEN 'query' ELSE 'extract' END || ':x' AS k FROM events))
SELECT mode, cache_type, count(*) AS n FROM c GROUP BY 1, 2""")
def cache_statistics(spark, sf):
    from docweave.functions.text import parse_cache_key

    k = F.concat("event_type", F.lit(":"), F.when(F.col("user_id") % 2 == 0, "query").otherwise("extract"), F.lit(":x"))
    return table(spark, sf, "events").select(parse_cache_key(k).alias("k")).groupBy("k.mode", "k.cache_type").agg(F.count("*").alias("n"))
