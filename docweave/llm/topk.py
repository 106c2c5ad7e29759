"""Operator 7, exact top-k by vector-approximation files.

The file has a row for each block of vectors: ids, the grid of the block, the cells as one byte a component, and, in a
column of their own, the exact vectors. A grid is uniform between the least and the largest component of its block, so
both bounds of a score come from one product of the query with the cells: q . low corners, plus or minus what the cells'
widths can add.

1. Queries meet all blocks, but read ids, grids and cells only. Of each block a query keeps the candidates whose upper
   bound reaches the k-th lower bound of the block, and over all blocks those that reach the k-th lower bound of all.
2. In the order of bounds exact vectors are read: the first k of each query, which gives a score that the k-th result
   has at least; then those whose upper bound reaches that score. No other can be a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy, tidy2, written

K, EVERY = 20, 20
#: Queries and vectors of a block, and queries scanned at once.
QUERY_BLOCK, CANDIDATE_BLOCK, SCAN = 8192, 16384, 128
CELLS = 256
FILE = "dims int, block int, ids binary, grid binary, cells binary, exact binary"
BOUNDS = "query long, query_id long, dims int, block int, place int, low double, high double"


def whole_vectors(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as floor(64 x), x as double; those null or holding null or non-finite components are left out."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * 64))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).where(fine).select(F.col(row_id).cast("long").alias("vec_id"), x.alias("v"))


def matrix(table: pa.Table) -> np.ndarray:
    dims = table.column("dims")[0].as_py()
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dims)


def approximated(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grid, cells): the least component and the cell width, whole numbers, of each dimension; the cell of each component."""
    low = exact.min(0)
    width = (exact.max(0) - low) // CELLS + 1
    return np.stack([low, width]), ((exact - low) // width).astype(np.uint8)


def vector_file(vectors: DataFrame) -> DataFrame:
    """The vector-approximation file of (vec_id, v), written once; blocks hold vectors of one length."""
    blocks = max(1, -(-vectors.count() // CANDIDATE_BLOCK))
    rows = vectors.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"))

    def build(table: pa.Table) -> pa.Table:
        ids, exact = table.column("vec_id").to_numpy(), matrix(table)
        grid, cells = approximated(exact)
        blobs = [[x.tobytes()] for x in (ids.astype("<i8"), grid.astype("<i8"), cells, exact.astype("<i8"))]
        return pa.table([table.column("dims").slice(0, 1), table.column("block").slice(0, 1), *(pa.array(b, pa.binary()) for b in blobs)], names=[c.split()[0] for c in FILE.split(", ")])

    return written(rows.groupBy("dims", "block").applyInArrow(tidy(build), FILE))


def bounds(queries: np.ndarray, grid: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, vectors): lower bounds of the scores, and (queries,): what to add for upper bounds. Exact below 2^52."""
    low, width = grid
    q = queries.astype(np.float64)
    more = np.maximum(q, 0) @ (width - 1).astype(np.float64)
    less = np.minimum(q, 0) @ (width - 1).astype(np.float64)
    largest = float((np.abs(q) @ (np.abs(low) + width * CELLS).astype(np.float64)).max(initial=0))
    kind = np.float32 if largest < 2**24 else np.float64
    least = (q * width).astype(kind) @ cells.T.astype(kind) + ((q @ low.astype(np.float64)) + less).astype(kind)[:, None]
    slack = 0.0 if largest < 2**52 else largest * 1e-12
    return least - kind(slack), more - less + 2 * slack


def scan(queries: pa.Table, file: pa.Table, k: int) -> pa.Table:
    """Candidates of a block for each query (row id `query`, its vec_id `query_id`): place in the block and bounds."""
    out: dict[str, list] = {c.split()[0]: [] for c in BOUNDS.split(", ")}
    if queries.num_rows and file.num_rows:
        own, name, q = queries.column("query").to_numpy(), queries.column("vec_id").to_numpy(), matrix(queries)
        dims, block = queries.column("dims")[0].as_py(), file.column("block")[0].as_py()
        ids = np.frombuffer(file.column("ids")[0].as_py(), "<i8")
        grid = np.frombuffer(file.column("grid")[0].as_py(), "<i8").reshape(2, dims)
        cells = np.frombuffer(file.column("cells")[0].as_py(), np.uint8).reshape(len(ids), dims)
        for first in range(0, len(q), SCAN):
            least, more = bounds(q[first : first + SCAN], grid, cells)
            for i in range(len(least)):
                row, n = least[i].astype(np.float64), first + i
                row[ids == name[n]] = -np.inf
                kth = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero((row + more[i] >= kth) & (row > -np.inf))
                for c, x in (("query", own[n]), ("query_id", name[n]), ("dims", dims), ("block", block)):
                    out[c].append(np.full(len(at), x))
                out["place"].append(at)
                out["low"].append(row[at])
                out["high"].append(row[at] + more[i])
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [(c.split()[0], kinds[c.split()[1]]) for c in BOUNDS.split(", ")]
    return pa.table([pa.array(np.concatenate([*out[c], np.zeros(0)]).astype(t.to_pandas_dtype()), t) for c, t in fields], names=[c for c, _ in fields])


def exact_scores(asked: DataFrame, queries: DataFrame, file: DataFrame) -> DataFrame:
    """(query, query_id, vec_id, score) of the places asked for; a block reads its exact vectors once."""

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["query", "query_id", "query_id", "query_id"]).rename_columns(["query", "query_id", "vec_id", "score"]).slice(0, 0)
        ids = np.frombuffer(right.column("ids")[0].as_py(), "<i8")
        exact = np.frombuffer(right.column("exact")[0].as_py(), "<i8").reshape(len(ids), left.column("dims")[0].as_py())
        place = left.column("place").to_numpy()
        score = np.einsum("ij,ij->i", exact[place], matrix(left))
        return pa.table({"query": left.column("query"), "query_id": left.column("query_id"), "vec_id": ids[place], "score": score})

    rows = asked.join(queries.select("query", "v"), "query").select("query", "query_id", "dims", "block", "place", "v")
    need = file.select("dims", "block", "ids", "exact")
    return rows.groupBy("dims", "block").cogroup(need.groupBy("dims", "block")).applyInArrow(tidy2(read), "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query over all rows of another id.

    vectors and queries: (vec_id, v array<long>). Ties go to the smaller vec_id; fewer candidates give fewer rows.
    A query is compared with vectors of its own length only. As in the SQL every row counts: an id that repeats takes as
    many places as it has rows, and the rows of a repeated query_id share k places. Empty tables give no rows.
    """
    return search(vectors, queries, k)[0]


def search(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The result of top_k, and which exact vectors were read for it (query, block, place), in two rounds."""
    file = vector_file(vectors)
    queries = written(queries.select(F.monotonically_increasing_id().alias("query"), "vec_id", "v", F.size("v").alias("dims")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    q = queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    places = file.select(F.col("dims").alias("dims"), F.col("block").alias("block")).distinct()
    q = q.join(places, "dims").select("part", "block", "dims", "query", "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part")
    light = file.select(every, "block", "dims", "ids", "grid", "cells")
    keys = ["part", "dims", "block"]
    found = q.groupBy(*keys).cogroup(light.groupBy(*keys)).applyInArrow(tidy2(lambda a, b: scan(a, b, k)), BOUNDS)
    over = Window.partitionBy("query")
    # Of a query's candidates, those that reach the k-th lower bound of all its blocks.
    lower = found.withColumn("__n", F.row_number().over(over.orderBy(F.desc("low")))).withColumn("kth", F.max(F.when(F.col("__n") == k, F.col("low"))).over(over))
    near = lower.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("__n", "kth")
    near = written(near.withColumn("turn", F.row_number().over(over.orderBy(F.desc("high"), "block", "place"))))
    one = near.where(F.col("turn") <= k)
    first = written(exact_scores(one, queries, file))
    # A query with fewer than k candidates has no others.
    sure = first.groupBy("query").agg(F.min("score").alias("sure"))
    two = near.where(F.col("turn") > k).join(sure, "query").where(F.col("high") >= F.col("sure")).drop("sure")
    scores = first.unionByName(exact_scores(two, queries, file))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return best, one.select("query", "block", "place"), two.select("query", "block", "place")


def op7_va_file_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose vec_id is divisible by 20, against all other rows.

    Null ids and vectors that are null or hold null or non-finite components take no part. Rows of one id are no
    candidates of each other; an id that repeats takes a place a row, as a query 20 places in all. An empty table gives no rows.
    """
    v = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
