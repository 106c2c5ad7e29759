from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import runs, simhash
from docweave.operators import components

from .conftest import SCHEMA, words


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(ids, near):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(ids)
    for g in groups.values():
        least = min((ids[i] for i in g if ids[i] is not None), default=None)
        for i in g:
            out[i] = least
    return out


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_runs_round_trip(values):
    for scale in (1, 2**20, 2**44):
        v = np.sort(np.array([x // scale for x in values], np.uint64))
        assert runs.unpack_sorted(runs.pack_sorted(v)).tolist() == v.tolist()
    wide = np.array([0, 5, 5 + 65535, 5 + 65535 + 3 * 65535, 2**40], np.uint64)
    assert runs.unpack_sorted(runs.pack_sorted(wide)).tolist() == wide.tolist()


def test_op9_equals_brute_force(spark, odd, odd_rows, as_table):
    got = simhash.op9_simhash_groups(spark, as_table(documents=odd)).collect()
    fps = [plain_fingerprint(r[1], 4) for r in odd_rows]
    comp = plain_components([r[0] for r in odd_rows], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(odd_rows, fps, comp, strict=True)), key=key)
    assert sorted(map(tuple, got), key=key) == want


def test_links_lose_no_component(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(rng.randint(1, 4)):
            g = f
            for i in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << i
            fps.add(g)
            f = g
    fps = sorted(fps)
    rows = [(i, i, f.to_bytes(8, "little")) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "node long, doc long, fp binary"), simhash.EXACT)
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = plain_components(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [found.get(i, i) for i in range(len(fps))] == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = plain_components(list(range(31)), lambda i, j: frozenset((i, j)) in pairs)
    assert [got.get(i, i) for i in range(31)] == want


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(64)], [(0, i) for i in range(1, 200)]])
def test_long_paths_and_hot_nodes(spark, edges):
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == len(edges)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(60):
        base = words(rng, 200).split(" ")
        rows.append((i, " ".join(base)))
        i += 1
        near = list(base)
        near[rng.randrange(200)] = "zebra"  # 5 of 196 shingles: a similarity of 0.95
        rows.append((i, " ".join(near)))
        i += 1
        far = base[:100] + words(rng, 100).split(" ")  # a similarity of about a third
        rows.append((i, " ".join(far)))
        i += 1
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", "y") for r in rows], SCHEMA)
    got = {r.doc_id for r in simhash.deduplicated(df).collect()}
    assert got == {k for k in range(len(rows)) if k % 3 != 1}


def test_stage_on_odd_rows(spark, odd, odd_rows, empty):
    got = simhash.deduplicated(odd)
    assert got.columns == odd.columns
    sets = [frozenset(simhash.shingle_set((r[1] or "").encode(), 5).tolist()) for r in odd_rows]
    near = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    comp = plain_components(list(range(len(odd_rows))), near)
    order = sorted(range(len(odd_rows)), key=lambda i: (odd_rows[i][0] is None, odd_rows[i][0] or 0))
    want, seen = [], set()
    for i in order:
        if comp[i] not in seen:
            seen.add(comp[i])
            want.append(odd_rows[i])
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)
    assert simhash.deduplicated(empty).count() == 0


def test_empty(spark, empty, as_table):
    assert simhash.op9_simhash_groups(spark, as_table(documents=empty)).count() == 0


def family(n, planted, seed=11):
    """Texts of one template, most pairs at 0.66 to 0.76, and copies of some with a word more: (rows, their sets)."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(4, 148, 6), 3):
            t[at] = f"x{i}y{at}"
        texts.append(" ".join(t))
    texts += [f"{t} more" for t in rng.sample(texts, planted)]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 1, "x", "y") for i, t in enumerate(texts)], [simhash.shingle_set(t.encode(), 5).tolist() for t in texts]


def kept_of(ids, sets, least=0.8):
    number = {h: k for k, h in enumerate({h for s in sets for h in s})}
    bits = [sum(1 << number[h] for h in s) for s in sets]

    def near(i, j):
        both = (bits[i] & bits[j]).bit_count()
        return both >= least * (len(sets[i]) + len(sets[j]) - both)

    return set(plain_components(ids, near))


def test_similar_pairs_in_a_family_below_the_threshold(spark):
    rows, sets = family(2000, 100)
    got = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == kept_of([r[0] for r in rows], sets)


@pytest.mark.parametrize(("n", "cut"), [(4, 1), (12, 3), (40, 10), (100, 25), (300, 75)])
def test_pairs_at_the_threshold_are_found(spark, n, cut):
    """Texts of n + 4 words, and the same with words more: n of n + cut shingles, a similarity of 0.8."""
    rng = random.Random(n)
    rows = []
    for i in range(250):
        w = [f"{rng.getrandbits(40):x}" for _ in range(n + cut + 4)]
        rows += [(2 * i, " ".join(w[: n + 4])), (2 * i + 1, " ".join(w))]
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", "y") for r in rows], SCHEMA)
    missed = sum(r.doc_id % 2 for r in simhash.deduplicated(df).collect())
    assert missed <= (0 if n <= simhash.SHORT else 1)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_shingle_sets(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)  # 40: texts in several pieces, words over a piece
    rng = random.Random(12)
    texts = ["", " \t\n", "One", "one", "one two three four", "one two three FOUR five", "a" * 300 + " b", *(words(rng, rng.randint(1, 90)).replace(" ", rng.choice([" ", "  ", "\n"])) for _ in range(60))]
    for size in (1, 5):
        names, plain = {}, []
        for t in texts:
            w = t.encode().lower().split()
            plain.append({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        for found, want in zip(simhash.shingle_sets([t.encode() for t in texts], size), plain, strict=True):
            assert len(found) == len(want) and found.tolist() == sorted(found.tolist())
            for x in want:
                names.setdefault(x, []).append(set(found.tolist()))
        seen = [set.intersection(*v) for v in names.values()]
        assert all(seen)  # equal shingles have equal hashes


def test_salts():
    x = np.sort(np.array([3, 2**60, 2**63, 2**63 + 5, 2**64 - 1], np.uint64))
    assert simhash.salts(x, 4).tolist() == [3, 0, 0, 2**32 - 1]
    assert simhash.salts(x[:0], 3).tolist() == [0, 0, 0]


def test_near_copies_under_null_and_repeated_ids(spark):
    rng = random.Random(4)
    texts = [words(rng, 150) for _ in range(4)]
    near = [t + " zebra" for t in texts]
    rows = [(None, texts[0]), (None, near[0]), (None, texts[1]), (None, near[1])]
    rows += [(5, texts[2]), (5, texts[3]), (6, near[2]), (7, near[3])]  # one id, two texts
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", "y") for r in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in simhash.deduplicated(df).collect()]
    assert sum(t in (texts[0], near[0]) for i, t in got if i is None) == sum(t in (texts[1], near[1]) for i, t in got if i is None) == 1
    assert sorted(x for x in got if x[0] is not None) == sorted(rows[4:6]) and len(got) == 4
