from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docweave.llm import ctw

from .conftest import SCHEMA, words

D = ctw.DEPTH


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


class Plain:
    """Context-tree weighting in dictionaries."""

    def __init__(self, texts):
        self.n: dict = {}
        for t in texts:
            t = b"\xff" * D + t + b"\xff"
            for i in range(D, len(t)):
                j = 1
                for b in range(8):
                    bit = t[i] >> 7 - b & 1
                    for d in range(D + 1):
                        self.n.setdefault((t[i - d : i], j), [0, 0])[bit] += 1
                    j = j * 2 + bit
        self.children: dict = {}
        for c, j in self.n:
            if c:
                self.children.setdefault((c[1:], j), []).append(c)
        self.w: dict = {}
        for c, j in sorted(self.n, key=lambda x: -len(x[0])):
            own = kt(*self.n[c, j])
            if len(c) == D:
                self.w[c, j] = own
            else:
                below = sum(self.w[k, j] for k in self.children[c, j])
                self.w[c, j] = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)

    def log10(self, t):
        t, total = b"\xff" * D + t + b"\xff", 0.0
        for i in range(D, len(t)):
            j = 1
            for b in range(8):
                bit, p = t[i] >> 7 - b & 1, None
                for d in range(D, -1, -1):
                    key = (t[i - d : i], j)
                    if key in self.n:
                        n = self.n[key]
                        own = (n[bit] + 0.5) / (sum(n) + 1)
                        stay = math.exp(math.log(0.5) + kt(*n) - self.w[key]) if d < D else 1.0
                        p = own if p is None else stay * own + (1 - stay) * p
                total += math.log10(0.5 if p is None else p)
                j = j * 2 + bit
        return total


def brute(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    train = [(t or "").encode() for d, t in rows if fold(d) != 1]
    count, model = Counter(w for t in train for w in t.lower().split()), Plain(train)
    n, v = sum(count.values()) + len(train), len(count) + bool(train)
    out = []
    for d, t in rows:
        t = (t or "").encode()
        c = [*(count[w] for w in t.lower().split()), len(train)]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        out.append((d, fold(d) == 1, len(c), sum(x > 0 for x in c), n, base, model.log10(t)))
    return sorted(out, key=str)


def check(df, rows):
    got = sorted(map(tuple, df.collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-4)


def test_odd_rows(spark, odd_rows, as_table):
    rows = [r for r in odd_rows if len(r[1] or "") < 5000]  # the dictionaries are slow; long texts: test_small_steps
    df = ctw.op10_context_tree_scores(spark, as_table(documents=spark.createDataFrame(rows, SCHEMA)))
    check(df, [(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("uneven", [4, 0.5, 0.001])
def test_small_steps(spark, monkeypatch, uneven):
    monkeypatch.setattr(ctw, "UNEVEN", uneven)  # few, some or all contexts are split
    monkeypatch.setattr(ctw, "SHARE", 0.0)
    monkeypatch.setattr(ctw, "COUNT_STEP", 700)
    monkeypatch.setattr(ctw, "SCORE_STEP", 300)
    monkeypatch.setattr(ctw, "GROUP_ROWS", 5)
    monkeypatch.setattr(ctw, "BUCKET_BYTES", 500)
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in range(40)] + [(50, words(rng, 900))]
    check(ctw.score(spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)), rows)


def test_no_training_rows_and_no_rows(spark, empty):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 5 == 1][:3]
    rows = [(d, "never seen") for d in held]
    check(ctw.score(spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)), rows)
    assert ctw.score(empty).count() == 0


@pytest.mark.parametrize("least", [2.0, 0.02, 0.0])
def test_probabilities_of_bytes_sum_to_one(least):
    rng = random.Random(6)
    text = words(rng, 300).encode()
    keys, _ = ctw.grams([text])
    k, n = np.unique(keys, return_counts=True)
    common = {}
    for d in (2, 3, 4):
        c, m = np.unique(ctw.context(keys, d), return_counts=True)
        common[d] = c[m > least * len(keys)]
    split = ctw.Split(common, 3)
    of = split.bucket(k)
    trees = {b: ctw.Tree(k[of == b], n[of == b], split) for b in np.unique(of)}
    sums = {d: np.zeros((3, len(split.above(d)) * 256)) for d in range(5)}
    for t in trees.values():
        for d, name, x in t.roots:
            sums[d][:, name] += x
    top = ctw.Top(split, {d: x.reshape(3, -1, 256) for d, x in sums.items()})
    for context in (keys[50], keys[7], np.uint64(0x123456789A00)):
        every = (context & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        b = int(split.bucket(every)[0])
        p = trees[b].probabilities(every) if b in trees else np.full((256, 8), np.nan)
        assert (10 ** top.log10(every, p)).sum() == pytest.approx(1)


def test_common_contexts_are_split():
    keys, _ = ctw.grams([b"aaaaaaaab" * 200])
    plain, split = ctw.Split({}, 4), ctw.Split({d: np.unique(ctw.context(keys, d)) for d in (2, 3)}, 4)
    assert set(split.depth(keys)) == {4} and set(plain.depth(keys)) == {2}
    assert len(np.unique(split.bucket(keys))) > len(np.unique(plain.bucket(keys)))


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e9])
    assert ctw.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)
