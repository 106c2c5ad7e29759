from __future__ import annotations

import math
import random

import numpy as np
import pytest

from docweave.llm import negatives


def brute(rows):
    fine = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, q in fine:
        if i % 100:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, z, v in fine if j != i and len(v) == len(q))
        for p, j, z in [x for x in found if x[2] == y][:5]:
            below = [x for x in found if x[2] != y and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(i, j, k, n, -p, -s) for k, (s, n, _) in enumerate(below, 1)]
    return sorted(out)


def run(spark, as_table, rows):
    df = spark.createDataFrame([(i, v, y, 1, 2) for i, v, y in rows], "vec_id long, embedding array<float>, label int, anchor int, block int")
    out = negatives.op13_hard_negatives(spark, as_table(embeddings=df))
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    return sorted(map(tuple, out.collect()))


def vectors(dims=6, n=700):
    rng = random.Random(7)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(10)]
    rows = []
    for i in range(n):
        y = 1 if i % 3 == 0 else rng.randrange(10)  # a hot label
        rows.append((i, [float(np.float32(rng.gauss(c, 0.4))) for c in centre[y]], y))
    rows += [(n + i, list(rows[i % 5 * 100][1]), i % 10) for i in range(60)]  # ties across labels
    rows += [(800, [0.0] * dims, 3), (900, [-x for x in centre[2]], 2), (1000, None, 1), (1001, [None] * dims, 1), (1002, [math.nan] * dims, 1), (1003, [math.inf] * dims, 1), (1004, centre[1], None), (None, centre[1], 1)]
    rows += [(1100, [1.0, 2.0], 4), (1101, [1.0, 2.0], 4), (1102, [1.0, 1.9], 5), (1200, [], 4), (1201, [], 4), (1202, [], 5), (1300, [5.0], 8), (1400, centre[1], 77)]
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize(("anchor_block", "row_block", "scan"), [(1024, 8192, 64), (3, 40, 2)])
def test_equals_brute_force(spark, as_table, monkeypatch, anchor_block, row_block, scan):
    for name, value in (("ANCHOR_BLOCK", anchor_block), ("ROW_BLOCK", row_block), ("SCAN", scan)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors()
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, as_table, rows) == want


def test_repeated_rows_and_ids(spark, as_table):
    rows = [(1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 0.9], 1), (2, [1.0, 0.9], 1), (100, [1.0, 1.0], 0), (100, [1.0, 1.0], 0)]
    positive, negative = 2 * 256 * 256, 256 * 256 + 230 * 256
    assert run(spark, as_table, rows) == sorted([(100, 1, k, 2, positive, negative) for k in (1, 2)] * 4)


def test_none(spark, as_table):
    assert run(spark, as_table, []) == []
    assert run(spark, as_table, [(100, [1.0], 0)]) == []
    assert run(spark, as_table, [(100, [1.0], 0), (1, [1.0], 0)]) == []  # no row of another label


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for size in (100, 10**5, 2**26, 2**29):
        a, b = rng.integers(-size, size, (5, 7)), rng.integers(-size, size, (9, 7))
        assert (negatives.scores(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a])).all()
    with pytest.raises(ValueError, match="exceed a long"):
        negatives.scores(np.array([[2**40]]), np.array([[2**40]]))
