"""A stored index for approximate nearest neighbours: inverted lists with residual codes.

The index is two tables. `centres` has a row a list. `lists` is partitioned by list and has a row a block of vectors: ids,
norms, residuals from the centre in one byte a component, and the exact unit vectors in a column of their own. A search
reads the lists that its queries probe only, scores by codes, and reads exact vectors for the best candidates. Vectors
that come later go into the lists of the centres that are there; nothing is clustered again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written
from .vector import dots, matrices

#: Vectors of a block, queries of a part; candidates that are scored exactly for each result asked for; parts of queries whose best a task holds.
BLOCK, QUERIES, REFINE, HELD = 4096, 1024, 4, 16
LISTS = "ids array<string>, scale float, codes binary, exact binary, list_no int"


def _unit(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(id, u): ids as strings and unit vectors; null and zero vectors, to which nothing is similar, and null ids are left out."""

    def units(batches):
        for b in batches:
            for at, m in matrices(b.column("u")).values():
                every = np.arange(len(at))
                n = np.sqrt(dots(m, m, every, every))
                kept = ~(n <= 0)
                u = (m / np.where(kept, n, 1)).T[kept].astype(np.float32)
                offsets = pa.array(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1])
                yield pa.record_batch([b.column("id").take(pa.array(at[kept])), pa.ListArray.from_arrays(offsets, pa.array(u.ravel()))], names=["id", "u"])

    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("string").alias("id"), F.col(vector).alias("u"))
    return rows.mapInArrow(units, "id string, u array<float>")


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)


def _listed(column: pa.ListArray, row: int, dims: int, *more: str) -> tuple:
    """Of a row's list of structs: query_id, the vectors u as a matrix, and other numbers."""
    v = column[row].values
    fields = {v.type.field(i).name: f for i, f in enumerate(v.flatten())}
    return fields["query_id"], _matrix(fields["u"], dims), *(fields[c].to_numpy(zero_copy_only=False) for c in more)


class Index:
    """An index below a path, whose vectors have `dims` components."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, lists: int, sample: int = 20_000, seed: int = 7, row_id: str = "vec_id", vector: str = "embedding") -> Index:
        """Centres by k-means over at most `sample` unit vectors, the first by a hash of their ids; every vector goes into a list."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        unit = _unit(vectors, row_id, vector)
        some = written(unit.orderBy(F.xxhash64("id"), "id").limit(sample)).select(array_to_vector("u").alias("features"))
        centres = KMeans(k=lists, seed=seed, maxIter=10).fit(some).clusterCenters()
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]  # `lists` rows
        self.spark.createDataFrame(rows, "list_no int, centre array<float>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self.append(vectors, row_id, vector)

    def centres(self) -> np.ndarray:
        """A row a list: as many as build() was given."""
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("list_no").collect()], np.float32)

    def append(self, vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> Index:
        """Adds vectors to the lists of their nearest centres. A list that is hot goes to as many tasks as it has blocks."""
        centres = self.centres()
        dims = centres.shape[1]

        def nearest(batches):
            for b in batches:
                u = _matrix(b.column("u"), dims)
                own = (2 * u @ centres.T - (centres**2).sum(1)).argmax(1) if len(u) else np.zeros(0)
                yield pa.record_batch([b.column("id"), b.column("u"), pa.array(own.astype(np.int32))], names=["id", "u", "list_no"])

        listed = written(_unit(vectors, row_id, vector).mapInArrow(nearest, "id string, u array<float>, list_no int"))
        sizes = listed.groupBy("list_no").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        dealt = listed.join(F.broadcast(sizes), "list_no").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))  # a row a list

        def pack(t: pa.Table) -> pa.Table:
            no = t.column("list_no")[0].as_py()
            u = _matrix(t.column("u"), dims)
            rest = u - centres[no]
            scale = max(float(np.abs(rest).max()), 1e-12) / 127
            codes = np.rint(rest / scale).astype(np.int8)
            return pa.table([pa.array([t.column("id").to_pylist()]), pa.array([scale], pa.float32()), pa.array([codes.tobytes()]), pa.array([u.astype("<f4").tobytes()]), pa.array([no], pa.int32())], names=[c.split()[0] for c in LISTS.split(", ")])

        dealt.select("list_no", "block", "id", "u").groupBy("list_no", "block").applyInArrow(pack, LISTS).write.partitionBy("list_no").mode("append").parquet(f"{self.path}/lists")
        return self

    def lists(self, probed: list[int]) -> DataFrame:
        """The rows of some lists; other partitions are not read."""
        read = self.spark.read.schema(LISTS).parquet(f"{self.path}/lists")
        return read.where(F.col("list_no").isin(probed or [-1]))

    def search(self, queries: DataFrame, k: int, probes: int, threshold: float | None = None, refine: int = REFINE) -> DataFrame:
        """(query_id, vec_id, score, rank): about the k most similar of the `probes` lists nearest to each query (query_id, query).

        vec_id is a string. Of each query k * refine candidates are chosen by codes, over all its lists, and scored
        exactly. Queries that are null, zero or of another length find nothing. k, probes and the number of lists bound
        what is held.
        """
        centres = self.centres()
        dims, wide = centres.shape[1], k * refine
        asked = _unit(queries.where(F.size("query") == dims), "query_id", "query").select(F.col("id").alias("query_id"), "u")

        def probe(batches):
            for b in batches:
                u = _matrix(b.column("u"), dims)
                near = np.argsort((centres**2).sum(1) - 2 * u @ centres.T, axis=1, kind="stable")[:, :probes] if len(u) else np.zeros((0, 1), int)
                at = np.repeat(np.arange(len(u)), near.shape[1])
                yield pa.record_batch([b.column("query_id").take(pa.array(at)), b.column("u").take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], names=["query_id", "u", "list_no"])

        wanted = written(asked.mapInArrow(probe, "query_id string, u array<float>, list_no int"))
        probed = [r.list_no for r in wanted.select("list_no").distinct().collect()]  # as many as there are lists at most
        parts = written(wanted.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("list_no").orderBy("query_id")) / QUERIES)).groupBy("list_no", "part").agg(F.collect_list(F.struct("query_id", "u")).alias("asked")))
        blocks = self.lists(probed)

        def coarse(batches):
            # Of a part of the queries of a list the best so far, over the blocks of the list that the task has seen.
            held: dict[tuple[int, int], list] = {}

            def told():
                for ids, top, blocks, places in held.values():
                    n, many = top.shape
                    yield pa.record_batch([ids.take(pa.array(np.repeat(np.arange(n), many))), pa.array(blocks.ravel(), pa.string()), pa.array(places.ravel(), pa.int32()), pa.array(top.ravel(), pa.float32())], names=["query_id", "block", "place", "about"])
                held.clear()

            for b in batches:
                for r in range(b.num_rows):
                    no, part, scale, place = (b.column(c)[r].as_py() for c in ("list_no", "part", "scale", "block"))
                    ids, q = _listed(b.column("asked"), r, dims)
                    c = np.frombuffer(b.column("codes")[r].as_buffer(), np.int8).reshape(-1, dims).astype(np.float32)
                    top = (q @ centres[no])[:, None] + scale * (q @ c.T)
                    at = np.broadcast_to(np.arange(len(c)), top.shape)
                    if len(c) > wide:
                        at = np.argpartition(-top, wide - 1, axis=1)[:, :wide]
                        top = np.take_along_axis(top, at, 1)
                    named = np.full(top.shape, place, object)
                    if (no, part) in held:
                        _, *before = held[no, part]
                        top, named, at = (np.concatenate(x, axis=1) for x in zip(before, (top, named, at), strict=True))
                        if top.shape[1] > wide:
                            first = np.argpartition(-top, wide - 1, axis=1)[:, :wide]
                            top, named, at = (np.take_along_axis(x, first, 1) for x in (top, named, at))
                    held[no, part] = [ids, top, named, at]
                    if len(held) >= HELD:
                        yield from told()
            yield from told()

        # A block is known by its file and its first id.
        block = F.concat_ws("/", "list_no", F.md5(F.concat_ws(",", "ids")))
        light = blocks.select("list_no", "scale", "codes", block.alias("block"))
        found = light.join(parts, "list_no").select("list_no", "part", "scale", "codes", "block", "asked").mapInArrow(coarse, "query_id string, block string, place int, about float")
        over = Window.partitionBy("query_id")
        some = written(found.withColumn("__n", F.row_number().over(over.orderBy(F.desc("about"), "block", "place"))).where(F.col("__n") <= wide).drop("__n"))
        listed = some.join(asked, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "u", "place")).alias("asked"))

        def exact(batches):
            for b in batches:
                for r in range(b.num_rows):
                    asked_ids, u, place = _listed(b.column("asked"), r, dims, "place")
                    m = np.frombuffer(b.column("exact")[r].as_buffer(), "<f4").reshape(-1, dims)[place]
                    score = (m.astype(np.float64) * u).sum(1)
                    yield pa.record_batch([asked_ids, b.column("ids")[r].values.take(pa.array(place)), pa.array(score)], names=["query_id", "vec_id", "score"])

        scored = blocks.select("ids", "exact", block.alias("block")).join(listed, "block").select("ids", "exact", "asked").mapInArrow(exact, "query_id string, vec_id string, score double")
        scored = scored if threshold is None else scored.where(F.col("score") >= threshold)
        rank = F.row_number().over(over.orderBy(F.desc("score"), F.col("vec_id").try_cast("long"), "vec_id"))  # ids that are numbers tie as numbers
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)
