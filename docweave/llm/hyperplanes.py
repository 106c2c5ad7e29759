"""Operator 11, near copies among embeddings by random-hyperplane sign hashing.

Equal vectors of a label are one node. Each of several tables keys a node by the signs of its products with the table's
hyperplanes; nodes that share a key are compared, by exact cosine in double precision, in the first table where they
meet. A bucket too large for one task is dealt into blocks, and pairs of blocks are compared; what a task hands on is a
number of links a node and a forest that connects what is linked, never pairs. Components are taken of the forests.

How many tables and signs there are follows from the number of nodes by two rules that hold at every size: signs, so
that four times as many keys as nodes exist, and tables, so that a pair at the threshold is missed by all of them with a
chance of at most MISS. Pairs above the threshold are missed still less often.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.components import components

from .common import tidy, written

COSINE, MISS, SEED = 0.98, 1e-5, 11
#: Nodes of a block of a bucket; rows that are compared by one call, on average.
TILE, GROUP = 512, 2048
SIGNED = "node long, label string, dims int, n long, least long, vec binary, keys array<long>"
FOUND = "node long, links long, root long"


def shape(nodes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(tables, signs of a table) for a number of nodes."""
    signs = min(62, max(8, math.ceil(math.log2(max(nodes, 1))) + 2))
    same = (1 - math.acos(cosine) / math.pi) ** signs
    return math.ceil(math.log(miss) / math.log1p(-same)), signs


def signatures(vectors: np.ndarray, tables: int, signs: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables): the keys of vectors of one length."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * signs))
    places = np.int64(1) << np.arange(signs, dtype=np.int64)
    out = [((x @ planes > 0).reshape(len(x), tables, signs) * places).sum(2) for x in np.array_split(vectors, -(-len(vectors) // 512))]
    return np.concatenate(out)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine: squares then neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def linked(x: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs between left and right, each once, that are similar and share no key of a table before."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    hit = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= cosine
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    if len(left) and left is right:
        i, j = i[i < j], j[i < j]
    fine = keys[i, table] == keys[j, table]
    for t in range(table):
        fine &= keys[i, t] != keys[j, t]
    return i[fine], j[fine]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compared(table: pa.Table, cosine: float) -> pa.Table:
    """FOUND of the tiles of a group: rows (node, n, label, vec, keys, table, cell, a, b, own)."""
    node, weight, number, cell, a, b, own, dims = (table.column(c).to_numpy() for c in ("node", "n", "table", "cell", "a", "b", "own", "dims"))
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    vec, keys = table.column("vec").to_pylist(), table.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    parts = (cell, a, b, number, label, dims)  # not the cell alone: it is a hash
    order = np.lexsort((node, *parts))
    cut = np.zeros(len(order), bool)
    for p in parts:
        cut[1:] |= p[order][1:] != p[order][:-1]
    out: list[list[np.ndarray]] = [[], [], []]
    for rows in np.split(order, np.flatnonzero(cut)):
        if len(rows) < 2:
            continue
        x = scaled(np.frombuffer(b"".join(vec[r] for r in rows), "<f8").reshape(len(rows), -1))
        first = rows[0]
        every = np.arange(len(rows))
        left, right = (every, every) if a[first] == b[first] else (np.flatnonzero(own[rows] == a[first]), np.flatnonzero(own[rows] == b[first]))
        if a[first] == b[first]:
            right = left
        i, j = linked(x, keys[rows], int(number[first]), left, right, cosine)
        if len(i):
            w = weight[rows]
            links = np.bincount(i, w[j], len(rows)).astype(np.int64) + np.bincount(j, w[i], len(rows)).astype(np.int64)
            some = np.flatnonzero(links)
            for o, v in zip(out, (node[rows][some], links[some], node[rows][roots(len(rows), i, j)[some]]), strict=True):
                o.append(v)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], names=["node", "links", "root"])


def near_copies(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """df's row_id, n_links, component_id, kept: a row for each row.

    Rows link when their labels are equal and not null, and the cosine of their vectors is `cosine` or more. Null ids
    and labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing: n_links
    0, and a component of their own (null for a null id, and kept is null then). Vectors of different lengths do not
    link. Rows of one id are rows like others: equal ones are linked. Other columns are ignored. An empty table gives none.

    Copies share one node, so a vector that a third of all rows have is compared once. Nodes without a bucket in common
    with another leave before any vector is shuffled. A bucket of m nodes takes about m * m / 2 comparisons, as the
    number of its links may need, in tiles of TILE * TILE.
    """
    double = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(row_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), double.alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole, F.lit(False))
    equal = written(rows.where(fine).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    tables, signs = shape(equal.count(), cosine)

    def sign(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, vecs, keys = lists.flatten().to_numpy(), [None] * batch.num_rows, np.zeros((batch.num_rows, tables), np.int64)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                keys[at] = signatures(scaled(x), tables, signs)
                for r, v in zip(at, x, strict=True):
                    vecs[r] = v.astype("<f8").tobytes()
            listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column("node"), batch.column("label"), pa.array(sizes, pa.int32()), batch.column("n"), batch.column("least"), pa.array(vecs, pa.binary()), listed], names=[c.split()[0] for c in SIGNED.split(", ")])

    signed = written(equal.select("node", "label", "n", "least", "v").mapInArrow(sign, SIGNED))
    cells = signed.select("node", "label", "dims", F.posexplode("keys").alias("table", "key")).select("node", "table", F.xxhash64("label", "dims", "table", "key").alias("cell"))
    buckets = written(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell", F.ceil(F.col("size") / TILE).cast("int").alias("blocks"), "size"))
    dealt = buckets.agg(F.coalesce(F.sum(F.col("size") * F.col("blocks")), F.lit(0))).first()[0]
    groups = max(1, -(-dealt // GROUP))
    own, other = F.pmod(F.xxhash64("node", "table"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = cells.join(buckets, "cell").select("node", "table", "cell", own.alias("own"), other)
    tiles = tiles.select("node", "table", "cell", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    tiles = tiles.withColumn("group", F.pmod(F.xxhash64("cell", "a", "b"), F.lit(groups)))
    found = tiles.join(signed.drop("least"), "node").groupBy("group").applyInArrow(tidy(lambda t: compared(t, cosine)), FOUND)
    found = written(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.select("node", "root"), "node", "root")
    placed = equal.join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(least, "root").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    keys = [F.when(fine, F.col(c)).alias(c) for c in ("label", "v")]
    out = rows.select("vec_id", *keys).join(known, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op11_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings of a label at a cosine of 0.98 or more; near_copies() has the rules."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS MATERIALIZED (
  SELECT n, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM f a JOIN f b ON a.label = b.label AND a.n <> b.n WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT reach.a AS n, min(e.vec_id) AS least FROM reach JOIN e ON e.n = reach.b GROUP BY reach.a),
k AS (SELECT a AS n, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM e LEFT JOIN c USING (n) LEFT JOIN k USING (n)
"""
