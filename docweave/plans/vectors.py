"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import vector

from .base import registry, table

QUERIES, SQL, query = registry()
_D = "list_transform(embedding, lambda x: x::DOUBLE)"
_SIM = f"""
v AS (SELECT vec_id, label, {_D} AS e FROM embeddings),
q AS (SELECT e AS qe FROM v WHERE vec_id = 7),
s AS (SELECT vec_id, label, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, q)"""


def _query_vector(spark, sf):
    row = table(spark, sf, "embeddings").where("vec_id = 7").first()
    return list(row.embedding) if row else []


@query(f"WITH {_SIM} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    """The twenty rows most similar to one."""
    return vector.search(table(spark, sf, "embeddings"), _query_vector(spark, sf), 20).select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SIM} SELECT label, count(*) AS n FROM s WHERE score >= 0.2 GROUP BY label")
def vector_threshold(spark, sf):
    """How many rows are at least so similar, by label."""
    e = table(spark, sf, "embeddings")
    return vector.search(e, _query_vector(spark, sf), threshold=0.2).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""
WITH {_SIM}, c AS (SELECT DISTINCT event_id % (SELECT max(vec_id) + 1 FROM embeddings) AS chunk_id FROM events)
SELECT chunk_id, round(score, 6) AS score FROM c JOIN s ON vec_id = chunk_id WHERE NOT EXISTS (SELECT 1 FROM c LEFT JOIN v ON vec_id = chunk_id WHERE e IS NULL)
ORDER BY s.score DESC, chunk_id LIMIT 10""")
def vector_pick_chunks(spark, sf):
    """Of the distinct chunks that events name, the most similar to a query; none if one has no vector. Events go round all vectors."""
    e = table(spark, sf, "embeddings")
    ids = F.broadcast(e.agg((F.max("vec_id") + 1).alias("ids")))
    chunks = table(spark, sf, "events").crossJoin(ids).select((F.col("event_id") % F.col("ids")).alias("chunk_id"))
    return vector.pick_chunks(chunks, e, _query_vector(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH {_SIM}, c AS (SELECT label % 3 AS part, vec_id - CASE WHEN label % 3 = 0 THEN 1 ELSE 0 END AS chunk_id FROM embeddings),
k AS (SELECT c.part, s.vec_id, s.score, row_number() OVER (PARTITION BY c.part ORDER BY s.score DESC, s.vec_id) AS n FROM c JOIN s ON s.vec_id = c.chunk_id)
SELECT part, vec_id AS chunk_id, round(score, 6) AS score FROM k WHERE n <= 10 AND part NOT IN (SELECT c.part FROM c ANTI JOIN s ON s.vec_id = c.chunk_id)""")
def vector_pick_missing(spark, sf):
    """The ten best chunks of each part of the table; none of a part that has a chunk without a vector."""
    e, q = table(spark, sf, "embeddings"), _query_vector(spark, sf)
    chunks = e.select((F.col("label") % 3).alias("part"), (F.col("vec_id") - (F.col("label") % 3 == 0).cast("int")).alias("chunk_id"))
    picked = None
    for part in range(3):
        one = vector.pick_chunks(chunks.where(F.col("part") == part), e, q, 10).select(F.lit(part).alias("part"), "chunk_id", F.round("score", 6).alias("score"))
        picked = one if picked is None else picked.unionByName(one)
    return picked


@query("WITH i AS (SELECT DISTINCT user_id AS vec_id FROM events) SELECT vec_id, len(embedding) AS dims FROM embeddings JOIN i USING (vec_id)")
def vectors_by_ids(spark, sf):
    """Vectors of the ids that have one."""
    ids = table(spark, sf, "events").select(F.col("user_id").alias("vec_id"))
    return vector.by_ids(table(spark, sf, "embeddings"), ids).select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query(f"""
WITH v AS (SELECT vec_id, {_D} AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def vector_search_many(spark, sf):
    """The twenty rows most similar to each of many queries, at least by 0.2."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.search_many(e, q, 20, 0.2).select("query_id", "vec_id", "rank")


@query(f"""
WITH v AS (SELECT vec_id, {_D} AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def vector_search_hundredths(spark, sf):
    """The five rows most similar to every row whose vec_id is divisible by 100, of all rows."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.search_many(e, q, 5).select("query_id", "vec_id", "rank")


@query(f"SELECT len(embedding) AS dims, label, round(avg(sqrt(list_dot_product({_D}, {_D}))), 6) AS norm, count(*) AS n FROM embeddings GROUP BY 1, 2")
def vector_norms(spark, sf):
    """Dimensions and mean length of vectors by label."""
    e = table(spark, sf, "embeddings")
    return e.groupBy(F.size("embedding").cast("long").alias("dims"), "label").agg(F.round(F.avg(vector.norm(F.col("embedding"))), 6).alias("norm"), F.count("*").alias("n"))
