"""Operator 3, a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded as a vector: counts of hashed byte trigrams
under a square root, and shares of character classes. A learned layer maps it to h; gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) weighs the passages, z = sum a h is the document, and the score is
sigmoid(c . z + b). All weights are learned from document labels by Adam on a bounded, documented sample of labelled
rows (SAMPLE of each class, SAMPLE_BYTES of text). In learning as in scoring a document has all its passages, however many: attention sums
over PART passages at a time, so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, trim, written

PASSAGE, BUCKETS, HIDDEN, ATTENTION = 512, 512, 32, 16
SAMPLE, EPOCHS, BATCH, RATE, DECAY, SEED = 2000, 12, 64, 4e-3, 1e-4, 7
#: Bytes of texts that are learned from, of each class.
SAMPLE_BYTES = 64 << 20
THRESHOLD, HELD_OUT = 0.7, 2
#: Passages that are in memory at once, and bytes of encoded passages of the sample that learning keeps from epoch to epoch.
PART, KEPT_BYTES = 2048, 256 << 20
CLASSES = 12


def byte_classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, space, line end, and single marks that layout and junk are made of."""
    of = np.full(256, 11, np.uint8)
    of[128:] = 10
    for k, chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"|", b"<>{}[]()"]):
        of[list(chars)] = k
    return of


_CLASS = byte_classes()
FEATURES = BUCKETS + CLASSES


def passages(text: bytes) -> Iterator[np.ndarray]:
    """A row a passage, FEATURES wide, up to PART of them at a time; an empty text is one passage of zeros."""
    if not text:
        yield np.zeros((1, FEATURES), np.float32)
    for first in range(0, len(text), PART * PASSAGE):
        b = np.frombuffer(text[first : first + PART * PASSAGE], np.uint8)
        n = -(-len(b) // PASSAGE)
        at = np.arange(len(b)) // PASSAGE
        wide = np.frombuffer(text[first : first + PART * PASSAGE + 2], np.uint8).astype(np.uint32)
        tri = (wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(23) if len(wide) > 2 else np.zeros(0, np.uint32)
        size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
        grams = np.bincount(at[: len(tri)] * BUCKETS + tri, minlength=n * BUCKETS).reshape(n, BUCKETS) / size
        kinds = np.bincount(at * CLASSES + _CLASS[b], minlength=n * CLASSES).reshape(n, CLASSES) / size
        yield np.concatenate([np.sqrt(grams), np.sqrt(kinds) * 2], axis=1).astype(np.float32)


class Bags:
    """The passages of texts, encoded when they are asked for; the first KEPT_BYTES of them stay encoded."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.kept, self.room = texts, {}, KEPT_BYTES

    def _of(self, k: int) -> Iterable[np.ndarray]:
        if k in self.kept:
            return self.kept[k]
        size = max(1, -(-len(self.texts[k]) // PASSAGE)) * FEATURES * 4
        if size > self.room:
            return passages(self.texts[k])
        self.room -= size
        self.kept[k] = list(passages(self.texts[k]))
        return self.kept[k]

    def parts(self, some: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, the bag of each, as a place in `some`), about PART passages at a time."""
        held, of, size = [], [], 0
        for i, k in enumerate(some):
            for x in self._of(k):
                held.append(x)
                of.append(np.full(len(x), i))
                size += len(x)
                if size >= PART:
                    yield np.concatenate(held), np.concatenate(of)
                    held, of, size = [], [], 0
        if held:
            yield np.concatenate(held), np.concatenate(of)


class Model:
    """Gated-attention pooling over passages. A bag's passages lie together; `of` gives each passage's bag."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls) -> Model:
        rng = np.random.default_rng(SEED)
        shapes = {"W": (FEATURES, HIDDEN), "a": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "b": (1,)}
        scale = {"W": 0.5, "V": 0.3, "U": 0.3, "w": 0.3, "c": 0.3}
        return cls({k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})

    def attended(self, x: np.ndarray) -> tuple:
        w = self.w
        h = np.tanh(x @ w["W"] + w["a"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, s, np.exp((t * s) @ w["w"])  # bounded by the sum of |w|, so exp needs no shift

    def forward(self, parts: Iterable, bags: int) -> tuple:
        """The sum of each bag's attention, its representation and its score."""
        total, z = np.zeros(bags), np.zeros((bags, HIDDEN))
        for x, of in parts:
            h, _, _, e = self.attended(x)
            total += np.bincount(of, e, bags)
            np.add.at(z, of, e[:, None] * h)
        z /= total[:, None]
        return total, z, 1 / (1 + np.exp(-np.clip(z @ self.w["c"] + self.w["b"], -30, 30)))

    def gradients(self, parts: Callable[[], Iterable], target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss. parts() gives the passages, twice: for the bags' sums, then for each passage's share."""
        w = self.w
        total, z, y = self.forward(parts(), len(target))
        d = (y - target) * weight / weight.sum()
        dz = d[:, None] * w["c"]
        level = (dz * z).sum(1)
        g = {k: np.zeros(v.shape) for k, v in w.items()} | {"c": z.T @ d, "b": d.sum(keepdims=True)}
        for x, of in parts():
            h, t, s, e = self.attended(x)
            a = e / total[of]
            de = a * ((dz[of] * h).sum(1) - level[of])
            dt, ds = de[:, None] * w["w"] * s * (1 - t * t), de[:, None] * w["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
            for k, v in (("W", x.T @ dh), ("a", dh.sum(0)), ("V", h.T @ dt), ("U", h.T @ ds), ("w", (t * s).T @ de)):
                g[k] += v
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray) -> Model:
        bags = Bags(texts)
        rng = np.random.default_rng(SEED)
        first, second, step = {k: 0 * v for k, v in self.w.items()}, {k: 0 * v for k, v in self.w.items()}, 0
        share = np.array([max(1, (labels == k).sum()) for k in (0, 1)]) / max(1, len(labels))
        weights = 0.5 / share[labels.astype(int)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                g = self.gradients(lambda some=some: bags.parts(some), labels[some], weights[some])
                step += 1
                for k, v in g.items():
                    v = v + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.w[k] = (self.w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        bags = Bags(texts)
        bags.room = 0
        return self.forward(bags.parts(range(len(texts))), len(texts))[-1]


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from labelled rows that are not held out; None without any label.

    Of each class at most `sample` rows are taken, those first by md5 of doc_id, and of these those that `sample_bytes`
    of texts hold, in that order, so that the driver's memory is bounded too. A doc_id labelled more than once has
    the label that most of its rows give (1 at a tie); null labels and labels of no document don't count.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("__q")).where(~held_out())
    known = known.select(F.col("doc_id").cast("string").alias("__id"), (F.col("__q") >= 0.5).cast("int").alias("__label")).withColumn("__o", F.md5("__id"))
    known = known.join(docs.select(F.col("doc_id").cast("string").alias("__id")).distinct(), "__id", "left_semi")
    chosen = [r for k in (0, 1) for r in known.where(F.col("__label") == k).orderBy("__o").select("__id", "__label").limit(sample).collect()]
    if not chosen:
        return None
    few = docs.sparkSession.createDataFrame(chosen, "__id string, __label int")  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").cast("string").alias("__id"), text_bytes().alias("__text")).join(F.broadcast(few), "__id")
    bags = written(rows.groupBy("__id").agg(F.max("__label").alias("label"), F.min("__text").alias("text")).withColumn("__o", F.md5("__id")))  # repeated ids: one bag
    room, fit = dict.fromkeys((0, 1), sample_bytes), []
    for r in bags.select("__id", "label", "__o", F.length("text").alias("size")).orderBy("__o").collect():
        if r["size"] <= room[r.label]:
            room[r.label] -= r["size"]
            fit.append((r["__id"],))
    if not fit:
        return None
    found = bags.join(F.broadcast(docs.sparkSession.createDataFrame(fit, "__id string")), "__id").select("__id", "label", "text").collect()
    found.sort(key=lambda r: r["__id"])
    return Model.new().fit([bytes(r.text) for r in found], np.array([r.label for r in found], np.float64))


def scored(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (of docs.columns) and score as `__score`, from whole texts alone; 0.5 without a model.

    A column of docs named __score or __text is overwritten or left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = keep.index("text") if "text" in keep else None
    weights = spark.sparkContext.broadcast(model and model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = weights.value and Model(weights.value)
        for b in batches:
            # The text goes to Python once; as a column to keep it is a string, perhaps null.
            texts = b.column(b.num_columns - 1).to_pylist() if own is None else [(t or "").encode() for t in b.column(own).to_pylist()]
            score = m.score(texts) if m else np.full(len(texts), 0.5)
            kept = len(keep)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(score, pa.float64())], names=[*b.schema.names[:kept], "__score"])
            trim()

    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *([text_bytes().alias("__text")] if own is None else []))
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("__score", DoubleType())])
    return rows.mapInArrow(run, schema)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold, all columns kept."""
    return scored(docs, learn(docs, labels), docs.columns).where(F.col("__score") >= threshold).drop("__score")


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality.

    Empty and null texts get the score of an empty passage, rows with equal texts equal scores; null doc_ids are in the
    fold of the empty id. Without any label that may be learned from every score is 0.5. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return df.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
