from __future__ import annotations

import hashlib
import random

import pytest
import xxhash

from docweave.llm import syncmers
from docweave.llm.syncmers import SKETCH, K, S, W

from .conftest import SCHEMA, words


def plain_sketch(data: bytes) -> list[int]:
    h = [xxhash.xxh64_intdigest(data[i : i + S], 42) for i in range(len(data) - S + 1)]
    h = [x - 2**64 if x >= 2**63 else x for x in h]
    found = {}
    for i in range(len(data) - K + 1):
        inner = h[i : i + W]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(xxhash.xxh64_intdigest(data[i : i + K], 42) & 0xFFFFFFFF, i)
    if not found and data:
        found = {xxhash.xxh64_intdigest(data, 42) & 0xFFFFFFFF: 0}
    return sorted(sorted(found)[:SKETCH], key=found.get)


def longest(numbers):
    best = []
    for i, x in enumerate(numbers):
        best.append(1 + max((best[j] for j in range(i) if numbers[j] < x), default=0))
    return max(best, default=0)


def plain_likeness(a, b):
    union = sorted({*a, *b})[:SKETCH]
    return 1.0 if not union else longest([b.index(x) for x in a if x in b and x in union]) / len(union)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(order):
        t, n = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = (t[: len(t) - half] + n[:half]).encode()
        a, b, c = plain_sketch(t.encode()), plain_sketch(edited), plain_sketch(n.encode())
        hexed = ["".join(f"{x:08x}" for x in s) for s in (a, b)]
        out.append((doc, len(t), hashlib.sha256(edited).hexdigest(), *hexed, plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [32, 2048])
def test_odd_rows(spark, odd, odd_rows, as_table, monkeypatch, block):
    monkeypatch.setattr(syncmers, "BLOCK", block)
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 9)
    monkeypatch.setattr(syncmers, "FAN", 2)
    assert rows_of(syncmers.op4_syncmer_fingerprints(spark, as_table(documents=odd))) == brute([(r[0], r[1]) for r in odd_rows])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, as_table, n):
    rows = [(i, "some text that is long enough to have anchors in it, number " + str(i)) for i in range(n)]
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
    assert rows_of(syncmers.op4_syncmer_fingerprints(spark, as_table(documents=df))) == brute(rows)


def test_anchors_move_with_their_text(spark):
    rng = random.Random(2)
    a, b = words(rng, 80), words(rng, 3)
    df = spark.createDataFrame([(a.encode(),), ((b + a).encode(),)], "data binary")
    plain, moved = (r[0] for r in df.select(syncmers.anchors(syncmers.F.col("data"))).collect())
    shift = len(b.encode()) << 32
    assert {x + shift for x in plain} <= set(moved)


def test_moved_passages_count_for_less(spark):
    rng = random.Random(5)
    a, b = words(rng, 60), words(rng, 60)
    df = spark.createDataFrame([((a + " " + b).encode(), (b + " " + a).encode())], "x binary, y binary")
    of = lambda c: syncmers.sketch(syncmers.low(syncmers.anchors(syncmers.F.col(c))), syncmers.F.col(c))
    x, y, moved, same = df.select(of("x"), of("y"), syncmers.likeness(of("x"), of("y")), syncmers.likeness(of("x"), of("x"))).first()
    assert moved == plain_likeness(x, y) < 0.8 and same == 1.0 and len(set(x) & set(y)) > 0.9 * SKETCH


@pytest.mark.parametrize("bounds", [[], [3], [-5, 0, 7, 8, 20]])
def test_ranges(spark, monkeypatch, bounds):
    monkeypatch.setattr(syncmers, "FAN", 2)
    got = spark.range(-10, 25).select("id", syncmers.ranges(bounds, syncmers.F.col("id")).alias("n")).collect()
    assert all(r.n == sum(b <= r.id for b in bounds) for r in got)


def test_bounds_of_a_sample(spark):
    keys = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 77 ELSE id END AS key")
    bounds = syncmers.sampled_bounds(keys, 20_000, 20)
    assert bounds == syncmers.sampled_bounds(keys.repartition(7), 20_000, 20) and 10 < len(bounds) < 20
    assert all(200 < y - x < 4_000 for x, y in zip([0, *bounds], [*bounds, 20_000], strict=True))
