"""Operator 13, hard negatives by a full sort of the scores of each anchor.

Rows lie in blocks: ids, labels and whole-number components as bytes. Each block of anchors meets each block of rows
twice. First an anchor takes its best rows of its own label; those of all blocks are its positives. Then the scores of
the rows of other labels are sorted by score and id, the place of each positive's upper limit is found by bisection, and
as many rows as are asked for are read from there down to the lower limit. Blocks hand on that many at most for each
positive, and the best of all blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import tidy, tidy2, written

EVERY, POSITIVES, NEGATIVES = 100, 5, 5
#: A negative's score is at least this many hundredths of the positive's, and at most the positive's.
LOWER = 80
#: Anchors and rows of a block, and anchors scored at once.
ANCHOR_BLOCK, ROW_BLOCK, SCAN = 1024, 8192, 64
BLOCK = "dims int, block int, ids binary, labels binary, kind string, cells binary"
ASKED = "dims int, part int, anchors binary, ids binary, labels binary, kind string, cells binary, held binary, limits binary"
POSITIVE = "anchor long, anchor_id long, vec_id long, score long"
NEGATIVE = "anchor long, anchor_id long, place int, vec_id long, score long"


def whole_rows(df: DataFrame, label: Column, scale: int = 256, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x), x as double; rows with a null id, label, vector or component, or one that is not finite, are left out."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    return df.where(F.col(row_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(row_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))


def packed(table: pa.Table, dims: int) -> list:
    """The components of rows in the narrowest type that holds them: its name, and the bytes."""
    m = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dims)
    low, high = m.min(initial=0), m.max(initial=0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return [kind, m.astype(kind).tobytes()]


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, components) of a block."""
    ids, labels = (np.frombuffer(table.column(c)[0].as_py(), "<i8") for c in ("ids", "labels"))
    cells = np.frombuffer(table.column("cells")[0].as_py(), table.column("kind")[0].as_py())
    return ids, labels, cells.reshape(len(ids), table.column("dims")[0].as_py())


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact: in floating point where no sum can reach what its digits hold."""
    most = a.shape[1] * max(int(np.abs(a.astype(np.float64)).max(initial=0)), 1) * max(int(np.abs(b.astype(np.float64)).max(initial=0)), 1)
    if most >= 2**63:
        raise ValueError("inner products may exceed a long")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def as_rows(found: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *found[c]]), pa.int64()).cast(kinds[t]) for c, t in (x.split() for x in schema.split(", "))], names=names(schema))


def row_file(rows: DataFrame) -> DataFrame:
    """The blocks of (vec_id, label, v), written once; a block holds vectors of one length."""
    blocks = max(1, -(-rows.count() // ROW_BLOCK))
    dealt = rows.select("*", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id", "v", "label"), F.lit(blocks)).cast("int").alias("block"))

    def build(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        kind, cells = packed(table, dims)
        return pa.table([[dims], [table.column("block")[0].as_py()], *([table.column(c).to_numpy().astype("<i8").tobytes()] for c in ("vec_id", "label")), [kind], [cells]], schema=pa.schema(list(zip(names(BLOCK), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()), strict=True))))

    return written(dealt.groupBy("dims", "block").applyInArrow(tidy(build), BLOCK))


def asked(anchors: DataFrame) -> DataFrame:
    """A row a block of anchors (anchor, vec_id, label, v, dims, part, limits array<long>)."""

    def build(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        kind, cells = packed(table, dims)
        lists = table.column("limits").to_pylist()
        held, limits = np.array([len(x) for x in lists], "<i8"), np.array([y for x in lists for y in x], "<i8")
        blobs = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("anchor", "vec_id", "label")]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([[dims], [table.column("part")[0].as_py()], *([x] for x in (*blobs, kind, cells, held.tobytes(), limits.tobytes()))], schema=pa.schema(list(zip(names(ASKED), types, strict=True))))

    return anchors.groupBy("dims", "part").applyInArrow(tidy(build), ASKED)


def own_label(left: pa.Table, right: pa.Table, k: int, scan: int) -> pa.Table:
    """The k best rows of a block of each anchor's own label."""
    out: dict[str, list] = {c: [] for c in names(POSITIVE)}
    if left.num_rows and right.num_rows:
        anchors = np.frombuffer(left.column("anchors")[0].as_py(), "<i8")
        (own, label, a), (ids, labels, b) = unpacked(left), unpacked(right)
        for first in range(0, len(a), scan):
            for n, row in enumerate(scores(a[first : first + scan], b), first):
                at = np.flatnonzero((labels == label[n]) & (ids != own[n]))
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
                for c, x in zip(out, (np.full(len(at), anchors[n]), np.full(len(at), own[n]), ids[at], row[at]), strict=True):
                    out[c].append(x)
    return as_rows(out, POSITIVE)


def other_labels(left: pa.Table, right: pa.Table, k: int, lower: int, scan: int) -> pa.Table:
    """The first k rows of a block of another label below each limit of each anchor, down to `lower` hundredths of it."""
    out: dict[str, list] = {c: [] for c in names(NEGATIVE)}
    if left.num_rows and right.num_rows:
        anchors, held, limits = (np.frombuffer(left.column(c)[0].as_py(), "<i8") for c in ("anchors", "held", "limits"))
        ends = np.cumsum(held)
        (own, label, a), (ids, labels, b) = unpacked(left), unpacked(right)
        for first in range(0, len(a), scan):
            for n, row in enumerate(scores(a[first : first + scan], b), first):
                at = np.flatnonzero((labels != label[n]) & (ids != own[n]))
                at = at[np.lexsort((ids[at], -row[at]))]
                down = -row[at]
                for place, limit in enumerate(limits[ends[n] - held[n] : ends[n]].tolist()):
                    low = -(-lower * limit // 100)  # the least whole score that is not below
                    begin, end = np.searchsorted(down, -limit, "left"), np.searchsorted(down, -low, "right")
                    some = at[begin : min(end, begin + k)]
                    for c, x in zip(out, (np.full(len(some), anchors[n]), np.full(len(some), own[n]), np.full(len(some), place), ids[some], row[some]), strict=True):
                        out[c].append(x)
    return as_rows(out, NEGATIVE)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and each of its positives.

    rows and anchors: (vec_id, label, v array<long>); anchors are rows too. Rows of an anchor's own id are neither its
    positives nor its negatives. Vectors of another length have no score with it. Repeated rows count each: an id that
    repeats is returned as often, and repeated anchors each have their own ranks. Ties go to the smaller vec_id. A
    positive with a score below zero has no negatives, as its lower limit lies over its upper one. Scores have to fit a
    long, or the query fails. Empty tables give no rows.

    Every anchor is scored against every row, twice: for its positives, then for what lies below them. Blocks are pairs
    of tasks' inputs as bytes; a block hands on `positives` rows an anchor, then `negatives` a positive.
    """
    file, scan = row_file(rows), SCAN
    total = anchors.count()
    parts = max(1, -(-total // ANCHOR_BLOCK))
    numbered = written(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v", F.size("v").alias("dims")).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")))
    every = file.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    places = file.select(F.col("dims").alias("dims"), F.col("block").alias("block")).distinct()  # columns of their own
    keys = ["dims", "part", "block"]
    met = lambda blocks: blocks.join(places, "dims").groupBy(*keys).cogroup(every.groupBy(*keys))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = met(asked(numbered.withColumn("limits", F.array().cast("array<long>")))).applyInArrow(tidy2(lambda a, b: own_label(a, b, positives, scan)), POSITIVE)
    near = written(near.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))
    # A list of `positives` at most.
    limits = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("limits"))
    found = met(asked(numbered.join(limits, "anchor"))).applyInArrow(tidy2(lambda a, b: other_labels(a, b, negatives, lower, scan)), NEGATIVE)
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    found = found.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["anchor", "place"]).select("anchor_id", F.col("vec_id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, against all rows; mined() has the rules.

    Rows whose vec_id is divisible by 7 first take the next label of ten. Null ids and labels, and vectors that are null
    or hold null or non-finite components, take no part.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label)
    return mined(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.n AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
