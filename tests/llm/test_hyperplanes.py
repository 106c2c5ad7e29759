from __future__ import annotations

import math
import random

import numpy as np
import pytest

from docweave.llm import hyperplanes

SCHEMA = "vec_id long, embedding array<float>, label int, node long, kept string, v int, n int"


def fine(i, v, y):
    return i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows):
    """(vec_id, n_links, component_id, kept) by comparing all with all."""
    at = [k for k, (i, v, y) in enumerate(rows) if fine(i, v, y)]
    links = {k: set() for k in range(len(rows))}
    unit = {k: np.array(rows[k][1], float) for k in at}
    for a in at:
        for b in at:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / math.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= 0.98:
                links[a].add(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[x][0] for x in seen), default=None) if i is not None else None
        out.append((i, len(links[k]), least, None if i is None else i == least))
    return sorted(out, key=repr)


def f32(x):
    return float(np.float32(x))


def vectors(seed=3, dims=24):
    """Scattered vectors, families about them, exact copies, chains, a hot group of near copies, and odd rows."""
    rng = random.Random(seed)
    vec = lambda: [f32(rng.gauss(0, 1)) for _ in range(dims)]
    near = lambda v, s: [f32(x + rng.gauss(0, s)) for x in v]
    rows, n = [], iter(range(10_000))
    for _ in range(60):
        rows.append((next(n), vec(), rng.randrange(3)))
    for i in range(12):
        base = rows[i]
        rows += [(next(n), near(base[1], 0.1 + 0.02 * k), base[2]) for k in range(6)]
        rows += [(next(n), list(base[1]), (base[2] + k) % 3) for k in range(3)]
        rows.append((next(n), [f32(3 * x) for x in base[1]], base[2]))
    hot = vec()
    rows += [(next(n), near(hot, 0.1), 1) for _ in range(90)]
    step = vec()
    for _ in range(10):
        step = near(step, 0.12)
        rows.append((next(n), step, 2))
    rng.shuffle(rows)
    copies = [(next(n), [1.0] + [0.0] * (dims - 1), 0) for _ in range(50)]
    odd = [(None, hot, 1), (5000, None, 1), (5001, [], 1), (5002, [0.0] * dims, 1), (5003, [0.0] * dims, 1), (5004, [None] * dims, 1), (5005, [math.nan] * dims, 1), (5006, [math.inf] * dims, 1), (5007, hot, None), (5008, hot, None)]
    odd += [(5010, [1.0, 2.0], 1), (5011, [1.0, 2.01], 1), (5012, [1.0], 1), (5013, [2.0], 1), (5014, [-2.0], 1), (7000, hot, 0), (7000, hot, 0), (7000, vec(), 0), (7001, [1e-30, 1e-38], 2), (7002, [2e-30, 2e-38], 2), (7003, [1e30, 3e38], 2), (7004, [1e29, 3e37], 2)]
    return rows + copies + odd


def run(spark, as_table, rows):
    df = spark.createDataFrame([(i, v, y, i, "x", 1, 2) for i, v, y in rows], SCHEMA)
    out = hyperplanes.op11_embedding_copies(spark, as_table(embeddings=df))
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize(("tile", "group"), [(512, 2048), (16, 8)])
def test_equals_brute_force(spark, as_table, monkeypatch, tile, group):
    monkeypatch.setattr(hyperplanes, "TILE", tile)  # a hot bucket in pairs of blocks
    monkeypatch.setattr(hyperplanes, "GROUP", group)
    rows = vectors()
    assert run(spark, as_table, rows) == brute(rows)


def test_none_and_alone(spark, as_table):
    assert run(spark, as_table, []) == []
    assert run(spark, as_table, [(4, [1.0, 0.0], 0)]) == [(4, 0, 4, True)]
    assert run(spark, as_table, [(4, None, None), (None, None, None)]) == [(4, 0, 4, True), (None, 0, None, None)]


def test_pairs_at_the_threshold_are_found():
    """Of pairs of a cosine of 0.98 the tables miss no more than the rule says, at several sizes."""
    rng = np.random.default_rng(8)
    for nodes in (1000, 10**6, 10**9):
        tables, signs = hyperplanes.shape(nodes)
        a = rng.standard_normal((1500, 48))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        x, y = hyperplanes.signatures(a, tables, signs), hyperplanes.signatures(0.98 * a + math.sqrt(1 - 0.98**2) * b, tables, signs)
        met = (x == y).any(1)
        assert met.sum() >= len(met) - 1
        assert (x == y).mean() == pytest.approx((1 - math.acos(0.98) / math.pi) ** signs, abs=0.05)


def test_each_pair_counts_in_one_table(spark):
    same = spark.createDataFrame([(i, [1.0, 0.01 * i], 0) for i in range(5)], "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in hyperplanes.near_copies(same).collect()} == {(i, 4, 0, i == 0) for i in range(5)}


def test_forest():
    assert hyperplanes.roots(6, np.array([4, 4, 2]), np.array([3, 0, 5])).tolist() == [0, 1, 2, 0, 0, 2]
