from __future__ import annotations

import math
import random

import pytest

from docweave.llm import topk


def brute(rows, k=20):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fine:
        if i % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, as_table, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, topk.op7_va_file_topk(spark, as_table(embeddings=df)).collect()))


@pytest.mark.parametrize(("query_block", "candidate_block", "scan"), [(2048, 16384, 256), (3, 40, 2)])
def test_equals_brute_force(spark, as_table, monkeypatch, query_block, candidate_block, scan):
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", candidate_block)
    monkeypatch.setattr(topk, "SCAN", scan)
    rng = random.Random(2)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(8)]) for i in range(240)]
    rows += [(240 + i, list(rows[i % 7][1])) for i in range(60)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, [0.0] * 8), (440, [0.5, 0.5]), (441, [1.0, -1.0]), (None, [0.1] * 8), (460, [])]
    assert run(spark, as_table, rows) == brute(rows)


def test_few_and_none(spark, as_table):
    assert run(spark, as_table, []) == []
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    assert run(spark, as_table, rows) == brute(rows)


def test_large_numbers(spark, as_table):
    rows = [(i, [float(2**k), float(-(2**k))]) for i, k in enumerate(range(20))]
    assert run(spark, as_table, rows) == brute(rows)


@pytest.mark.parametrize("candidate_block", [16384, 40])
def test_repeated_ids_count_by_rows(spark, as_table, monkeypatch, candidate_block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", candidate_block)
    rng = random.Random(6)
    vector = lambda: [rng.randrange(-64, 64) / 64 for _ in range(4)]
    rows = [(i, vector()) for i in range(1, 130)]
    rows += [(7, [1.0 * x for x in (1, 1, 1, 1)])] * 8 + [(9, [1.0, 1.0, 1.0, (40 - i) / 64]) for i in range(30)]  # over 20 of an id
    rows += [(20, [1.0, 1.0, 1.0, 1.0]), (40, vector()), (40, vector())]  # repeated queries
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q in {i for i, _ in whole if i % 20 == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), j) for i, x in whole if i == q for j, v in whole if j != q)[:20]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert run(spark, as_table, rows) == sorted(want)


def test_few_exact_vectors_are_read(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-2000, 2000) for _ in range(16)]) for i in range(3000)]  # cells of 16 numbers
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    q = v.where("vec_id % 100 = 0")
    best, one, two = topk.search(v, q, 10)
    want = sorted((i, r + 1, j, -s) for i, x in rows[::100] for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in rows if j != i)[:10]))
    assert sorted(map(tuple, best.collect())) == want
    assert one.count() == 300 and one.count() + two.count() < 30 * 3000 / 10


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (50, 5000, 10**7):
        exact, q = rng.integers(-size, size, (200, 12)), rng.integers(-size, size, (9, 12))
        grid, cells = topk.approximated(exact)
        least, more = topk.bounds(q, grid, cells)
        score = q @ exact.T
        assert (least <= score).all() and (least + more[:, None] >= score).all()
        assert size > 100 or (least == score).all()
