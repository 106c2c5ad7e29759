from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import suffix

from .conftest import SCHEMA, words


def brute(rows, length=50):
    """By doc_id (null: largest) the bytes covered by strings that start in a document with a smaller id."""
    top = 2**63
    texts = [(top if d is None else d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                cover[i : i + length] = b"\1" * length
        n_spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        rest = bytes(x for x, c in zip(t, cover, strict=True) if not c)
        out.append((None if d == top else d, len(t), sum(cover), n_spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lcps = [[0, *(common(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
    order, shares = suffix.merge(runs, lcps)
    at, got = [0] * len(runs), []
    for k in order:
        got.append(runs[k][at[k]])
        at[k] += 1
    assert got == sorted(x for r in runs for x in r)
    assert shares[1:] == [common(a, b) for a, b in zip(got, got[1:], strict=False)]


def test_odd_rows(spark, odd, odd_rows, as_table):
    assert rows_of(suffix.op8_repeated_bytes(spark, as_table(documents=odd))) == brute([(r[0], r[1]) for r in odd_rows])


@pytest.mark.parametrize("hot", [8192, 2, 20])
def test_planted_passages(spark, as_table, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)  # 2: all windows that recur are dealt by themselves
    monkeypatch.setattr(suffix, "GROUP_ROWS", 7)
    monkeypatch.setattr(suffix, "BUCKET_ANCHORS", 500)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(suffix, "STEP", 3000)
    rng = random.Random(11)
    passages = [words(rng, n) for n in (6, 9, 12, 60)] + ["a" * 60, "ab" * 70, "\x00" * 55 + "é" * 30]
    rows = []
    for i in range(90):
        t = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 45))
            t += p[a : a + rng.randint(40, 400)] + words(rng, rng.randint(0, 9))
        rows.append((rng.randint(0, 70), t))
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200 + i, rows[5][1][:-3] + f"{i:03d}") for i in range(30)]
    rows.append((300, " ".join(t for _, t in rows)))
    df = spark.createDataFrame([(d, t, None, None, None, None, None) for d, t in rows], SCHEMA)
    assert rows_of(suffix.op8_repeated_bytes(spark, as_table(documents=df))) == brute(rows)


def test_a_line_in_all_documents_is_split(spark, as_table, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 64)
    monkeypatch.setattr(suffix, "GROUP_BYTES", 5000)
    met = spark.sparkContext.accumulator(0)
    plain = suffix.covered

    def covered(table):
        if table.column("bucket")[0].as_py() >= 0:
            met.add(sum(len(x) for x in table.column("right").to_pylist()))
        return plain(table)

    monkeypatch.setattr(suffix, "covered", covered)
    rng = random.Random(3)
    line = words(rng, 14)
    rows = [(i, words(rng, 9) + line + words(rng, 9)) for i in range(400)]
    df = spark.createDataFrame([(d, t, None, None, None, None, None) for d, t in rows], SCHEMA)
    assert rows_of(suffix.op8_repeated_bytes(spark, as_table(documents=df))) == brute(rows)
    assert met.value < 400  # suffixes at the line's anchors did not meet in a bucket


def test_tallies():
    h = np.sort(np.repeat(np.arange(6, dtype=np.uint64), [1, 2, 3, 4, 5, 1000]))
    assert np.unique(suffix.tallied(h), return_counts=True)[1].tolist() == [1, 2, 3, 3, 4, 11]


def test_empty(spark, empty, as_table):
    assert suffix.op8_repeated_bytes(spark, as_table(documents=empty)).count() == 0
