"""Similarity search over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block in a search of many, and numbers in it, at most; rows below which none is split. Rows of a tile; pairs that are scored at a time.
QUERY_BLOCK, ROW_BLOCK, BLOCK_SIZE, LEAST_BLOCK, TILE, CHUNK = 4096, 1 << 16, 1 << 22, 4096, 1024, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null or zero, or lengths differ."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.try_divide(dot(a, b), norm(a) * norm(b)))


def search(vectors: DataFrame, query: list[float], k: int | None = None, threshold: float | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows to one query vector, with `score`; at least the threshold. Only k rows a task are kept; without k all."""
    q = F.array(*(F.lit(float(x)) for x in query)).cast("array<double>")
    df = vectors.withColumn("score", cosine(F.col(vector), q)).where(F.col("score").isNotNull())
    df = df if threshold is None else df.where(F.col("score") >= threshold)
    return df if k is None else df.orderBy(F.desc("score"), row_id).limit(k)


def by_ids(vectors: DataFrame, ids: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """The vectors of the ids (a column of the same name) that have one."""
    return vectors.join(ids.select(row_id).distinct(), row_id, "left_semi")


def search_many(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k most similar rows to each of any number of queries (query_id, query).

    Queries and rows are dealt into blocks, and each pair of blocks is searched on its own, by products of matrices; of a
    query's rows, it passes on the ids of k at most. The rows that have these come back for their scores and ranks.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism

    def sized(df: DataFrame, c: str, most: int) -> tuple[int, int]:
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias("size")).first()
        return r.n, max(1, -(-r.n // most), -(-r["size"] // BLOCK_SIZE))

    (_, nq), (n, nv) = sized(queries, "query", QUERY_BLOCK), sized(vectors, vector, ROW_BLOCK)
    nv = max(nv, min(-(-cores // nq), n // LEAST_BLOCK))  # no core idle where rows are many
    block = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    components = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    q = queries.select(F.col("query_id").alias("__query"), F.col("query").cast("array<double>").alias("__u"), block(["query_id"], nq).alias("__q"), span(nv).alias("__v"))
    v = vectors.select(F.col(row_id).alias("__row"), components.alias("__u"), F.xxhash64(vector).alias("__hash"), block([row_id, vector], nv).alias("__v"), span(nq).alias("__q"))
    types = {"__query": queries.schema["query_id"].dataType, "__row": vectors.schema[row_id].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", __hash long"
    pairs = q.groupBy("__q", "__v").cogroup(v.groupBy("__q", "__v"))
    found = pairs.applyInArrow(lambda a, b: _best(a, b, k, threshold), schema).distinct()
    same = F.col(row_id).eqNullSafe(F.col("__row")) & (F.xxhash64(vector) == F.col("__hash"))
    asked = queries.select("query_id", "query")
    each = vectors.join(found, same).join(asked, F.col("__query").eqNullSafe(F.col("query_id"))).drop("__row", "__hash", "__query")
    each = each.withColumn("score", cosine(F.col(vector), F.col("query"))).where(F.col("score").isNotNull())
    each = each if threshold is None else each.where(F.col("score") >= threshold)
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return each.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).drop("query")


def matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors without nulls: their places, and a column of a matrix each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).copy()
    values = column.flatten()
    if values.null_count:
        size[pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[values.is_null().to_numpy(zero_copy_only=False)]] = 0
    at = {int(n): np.flatnonzero(size == n) for n in np.unique(size) if n > 0}
    return {n: (i, column.take(pa.array(i)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n).T.copy()) for n, i in at.items()}


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The rank of each id; structs go by their fields."""
    parts = pa.table([ids], names=["id"])
    while any(pa.types.is_struct(t) for t in parts.schema.types):
        parts = parts.flatten()
    parts = parts.rename_columns([str(i) for i in range(parts.num_columns)])
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(parts, sort_keys=[(c, "ascending") for c in parts.column_names], null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return out


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of columns i of a and j of b, added up as dot() adds."""
    out = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        out += x[i] * y[j]
    return out


def _best(queries: pa.Table, rows: pa.Table, k: int, threshold: float | None) -> pa.Table:
    """(__query, __row, __hash) of the k best rows of each query, of those that tie the first by id.

    Products of matrices, whose sums have any order, only rule rows out, by a margin over their error; what is left is
    scored to the last bit as cosine() scores.
    """
    asked, there, out = matrices(queries.column("__u")), matrices(rows.column("__u")), []
    if k > 0 and asked and there:
        place = _places(rows.column("__row"))
        with np.errstate(all="ignore"):
            for n in asked.keys() & there.keys():
                (qi, q), (vi, v) = asked[n], there[n]
                out.append([a[b] for a, b in zip((qi, vi), _nearest(q, v, place[vi], k, threshold), strict=True)])
    qi, vi = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in (0, 1))
    return pa.table([queries.column("__query").take(pa.array(qi)), rows.column("__row").take(pa.array(vi)), rows.column("__hash").take(pa.array(vi))], names=["__query", "__row", "__hash"])


def _nearest(q: np.ndarray, v: np.ndarray, place: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns of q and of v that belong together: of each query the k best, ties in the order of `place`."""
    every = lambda m: np.arange(m.shape[1])
    nq, nv = (np.sqrt(dots(m, m, every(m), every(m))) for m in (q, v))
    plain = lambda x: (x > 1e-100) & (x < 1e100)  # noqa: E731  # others may go over or under: never ruled out
    margin, uq, uv = 1e-15 * (len(q) + 16), (q / nq).T.copy(), v / nv
    floor = np.full(len(nq), -2.0 if threshold is None else max(-2.0, threshold))
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for start in range(0, len(nv), TILE):
        tile = slice(start, start + TILE)
        about = uq @ uv[:, tile]
        about[~plain(nq)] = np.inf
        about[:, ~plain(nv[tile])] = np.inf
        about[np.ix_(nq == 0, np.isfinite(nv[tile]))] = -np.inf
        about[np.ix_(np.isfinite(nq), nv[tile] == 0)] = -np.inf
        near = about >= (floor - margin)[:, None]
        if near.sum() > 4 * k * len(nq) and about.shape[1] > k:  # the k-th of these is a bound too
            near &= about >= np.partition(np.where(np.isinf(about), -np.inf, about), -k, axis=1)[:, -k, None] - 2 * margin
        i, j = np.nonzero(near)
        j += start
        score = np.concatenate([dots(q, v, i[c : c + CHUNK], j[c : c + CHUNK]) for c in range(0, len(i), CHUNK)] or [np.zeros(0)])
        length = nq[i] * nv[j]
        score /= length
        kept = (length != 0) & (np.isnan(score) | (score >= (-np.inf if threshold is None else threshold)))
        i, j, score = (np.concatenate([a, b[kept]]) for a, b in zip(best, (i, j, score), strict=True))
        order = np.lexsort((place[j], -score, ~np.isnan(score), i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(nq)))
        rank = np.arange(len(i)) - first[i]
        full = i[rank == k - 1]
        last = score[rank == k - 1]
        floor[full] = np.where(np.isnan(last), np.inf, last)
        best = [x[rank < k] for x in (i, j, score)]
    return best[0], best[1]


def inverted_lists(vectors: DataFrame, lists: int, sample: int = 10_000, seed: int = 7, row_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[float]]]:
    """Vectors with `list_no`, that of the nearest of `lists` centres, and the centres.

    Centres are those of a k-means over a bounded sample of unit vectors (the first `sample` by a hash of their id); every
    row is in a list. Null and zero vectors are left out, as nothing is similar to them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("__n", norm(F.col(vector))).where("__n > 0").withColumn("__u", F.transform(vector, lambda x: x.cast("double") / F.col("__n")))
    some = unit.orderBy(F.xxhash64(row_id), row_id).limit(sample).select(array_to_vector("__u").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(some)
    listed = model.setPredictionCol("list_no").transform(unit.withColumn("features", array_to_vector("__u")))
    return listed.drop("__n", "__u", "features"), [c.tolist() for c in model.clusterCenters()]


def search_lists(listed: DataFrame, centres: list[list[float]], queries: DataFrame, k: int, probes: int, threshold: float | None = None, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As search_many, in the `probes` lists whose centres are nearest to each query (query_id, query): approximate."""
    near = F.array(*(F.struct(-dot(F.col("query"), F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("list_no")) for i, c in enumerate(centres)))
    asked = queries.select("query_id", "query", F.explode(F.slice(F.array_sort(near), 1, probes)).alias("x")).select("query_id", "query", "x.list_no")
    each = listed.join(asked, "list_no").withColumn("score", cosine(F.col(vector), F.col("query"))).where(F.col("score").isNotNull())
    each = each if threshold is None else each.where(F.col("score") >= threshold)
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), row_id)
    return each.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).drop("query", "list_no")


def pick_chunks(chunks: DataFrame, vectors: DataFrame, query: list[float], k: int, chunk: str = "chunk_id", row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k distinct chunks most similar to the query; none at all if a chunk has no vector, so that the caller falls back."""
    ids = chunks.select(F.col(chunk).alias("__id")).distinct()
    known = ids.join(vectors.select(F.col(row_id).alias("__id"), vector), "__id", "left")
    q = F.array(*(F.lit(float(x)) for x in query))
    known = known.withColumn("score", cosine(F.col(vector), q))
    lacking = known.agg(F.coalesce(F.max(F.col(vector).isNull()), F.lit(False)).alias("lacking"))
    return known.join(F.broadcast(lacking)).where(~F.col("lacking")).orderBy(F.desc("score"), "__id").limit(k).select(F.col("__id").alias(chunk), "score")
