"""Operator 6, best-fit packing by minimum bin slack.

What to put together depends on lengths only, and there are at most `capacity` lengths. The counts of the lengths are
taken by Spark; on these the minimum-bin-slack search runs on the driver, whatever the number of documents: a bitset
subset-sum program over the lengths left finds the fullest feasible combination that holds the longest of them, and the
combination is taken as often as the counts allow before the next search. The plan is a list of (combination, times).
Pieces then find their place by rank among those of their length, in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, prefix, small_batches, text_bytes, written
from .records import parts
from .tokens import TOKENIZER, encoder

CAPACITY, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket long"


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination of the lengths left that holds the longest: (length, times), longest first.

    Subset sums are bits of an integer; times up to what fits are split into powers of two, so each step is one shift.
    Longer lengths are tried first and the search ends as soon as a sum meets the capacity.
    """
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    top = lengths[0]
    room = capacity - top
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for x in lengths:
        if x > room:
            continue
        left, power = min(counts[x] - (x == top), room // x), 1
        while left > 0:
            some = min(power, left)
            after = reach | reach << some * x & full
            if after != reach:
                steps.append((reach, x, some))
                reach = after
            left, power = left - some, power * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {top: 1}
    for before, x, some in reversed(steps):
        if not before >> at & 1:
            at -= some * x
            chosen[x] = chosen.get(x, 0) + some
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations and how often each is taken, until no length is left."""
    counts, out = {x: n for x, n in counts.items() if n}, []
    while counts:
        chosen = fullest(counts, capacity)
        times = min(counts[x] // n for x, n in chosen)
        for x, n in chosen:
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((chosen, times))
    return out


def runs(made: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, rows of: first rank, first sequence, how many of the length a sequence takes, offset of the first."""
    rank: dict[int, int] = {}
    found: dict[int, list] = {}
    base = 0
    for chosen, times in made:
        offset = 0
        for x, n in chosen:
            found.setdefault(x, []).append((rank.get(x, 0), base, n, offset))
            rank[x] = rank.get(x, 0) + n * times
            offset += n * x
        base += times
    return {x: np.array(rows, np.int64) for x, rows in found.items()}


def cut(tokenizer: str, end: int, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = np.array([end], enc.dtype).tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in parts(texts):
                rows = []
                for doc, tokens in zip(docs[some], enc.encode(texts[some]), strict=True):
                    ids = np.frombuffer(tokens + tail, enc.dtype).astype("<u4")
                    for k, first in enumerate(range(0, len(ids), capacity)):
                        piece = ids[first : first + capacity].tobytes()
                        crc = zlib.crc32(piece)
                        rows.append((doc, k, first, len(piece) // 4, crc, zlib.crc32(b"%d:%d" % (k, -1 if doc is None else doc), crc)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return pieces


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole texts into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document longer than the capacity is cut into pieces of it; others stay whole. Null text: the end id alone.
    Each row of docs is packed, equal doc_ids and null doc_ids too. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    pieces = written(rows.mapInArrow(cut(tokenizer, end, capacity), PIECES))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = runs(plan(counts, capacity))
    buckets = bucket_count(sum(counts.values()))
    pieces = pieces.withColumn("bucket", F.col("bucket") % buckets)
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "start")]
    ranked = prefix(pieces, ["length"], "bucket", order, F.lit(1), "rank").drop("bucket")
    table = spark_broadcast(docs.sparkSession, table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = table.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            sizes, first = np.unique(length[order], return_index=True)
            for x, at in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
                run = by[x]
                k = np.searchsorted(run[:, 0], rank[at], "right") - 1
                inside = rank[at] - run[k, 0]
                sequence[at] = run[k, 1] + inside // run[k, 2]
                offset[at] = run[k, 3] + inside % run[k, 2] * x
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.select(*names, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def spark_broadcast(spark: SparkSession, value):
    """Broadcasts a plan: its size is bounded by the capacity, not by the data."""
    return spark.sparkContext.broadcast(value)


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
