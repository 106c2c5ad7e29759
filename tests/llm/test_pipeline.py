from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from docweave.llm import catalog, mixing, quality, sharding, suffix

from .conftest import SCHEMA, words
from .test_simhash import plain_components
from .test_suffix import brute
from .test_tokens import TOKENIZER


def test_stages_are_named_and_keep_the_columns(spark, odd, empty, as_table):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    where = as_table(labels=labels)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, where)
            out.count()
            if name != "best-fit packing":
                assert out.dtypes == docs.dtypes, name


def test_repeats_are_cut_on_characters(spark, odd, odd_rows):
    got = suffix.without_repeats(odd).collect()
    assert len(got) == len(odd_rows)
    by = Counter((r.doc_id, len((r.text or "").encode())) for r in got)
    # As the byte operator, but for the one to three bytes that a cut character keeps.
    want = Counter((r[0], r[1] - r[2]) for r in brute([(r[0], r[1]) for r in odd_rows]))
    assert sum((by - want).values()) <= 3
    assert all(r.n_chars is None or len(r.text) == r.n_chars for r in got)
    assert suffix.on_characters("aéb".encode(), np.array([[0, 2], [2, 4]])).tolist() == [[0, 1], [3, 4]]


def plain_mix(rows, limit):
    tokens = {i: len([w for w in (r[1] or "").encode().split()]) + 1 for i, r in enumerate(rows)}
    total = Counter()
    for i, r in enumerate(rows):
        total[r[3]] += tokens[i]
    top = max(total.values())
    low = min(total.values())
    a, b = 0.0, 1.0
    if top / low <= limit:
        b = 0.0
    for _ in range(60):
        m = (a + b) / 2
        a, b = (a, m) if (top / low) ** (1 - m) <= limit else (m, b)
    return {s: max(t, int(round(t * (top / t) ** (1 - b), 3))) for s, t in total.items()}, total


def test_mixture_meets_its_budgets(spark, odd, odd_rows):
    small = odd.select("doc_id", "source", mixing.tokens_of().alias("tokens"))
    budget, total = plain_mix(odd_rows, 2.0)
    got = mixing.mixed(small, 2.0, block_tokens=500).collect()
    for s in total:
        drawn = [r for r in got if r.source == s]
        given = sum(r.tokens for r in drawn)
        longest = max(r.tokens for r in drawn)
        assert budget[s] <= given < budget[s] + longest
        assert sum(r.tokens for r in drawn if r.epoch == 0) == total[s]  # each row once at least
        assert given <= 2 * total[s] + longest
    blocks = Counter(r.block for r in got)
    assert all(sorted(r.slot for r in got if r.block == b) == list(range(n)) for b, n in blocks.items())
    stage = Counter(r.doc_id for r in mixing.mix_documents(odd).collect())
    assert stage == Counter(r.doc_id for r in got)


@pytest.mark.parametrize("entropy", [0.0, 0.9, 1.05, 9.0])
def test_target_entropy(spark, entropy, monkeypatch):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([700, 200, 100])], "__s string, total long")

    def spread(a):
        w = np.array([700, 200, 100.0]) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(df, entropy=entropy)
    assert 0 <= a <= 1
    if spread(1) <= entropy <= spread(0):
        assert spread(a) == pytest.approx(entropy)
    if 0.8 < entropy < 1.0:
        monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
        monkeypatch.setattr(mixing, "STEPS", 8)
        assert mixing.exponent(df, entropy=entropy) == pytest.approx(a, abs=1e-2)


def test_shards(spark, odd, odd_rows, empty, as_table):
    got = sharding.op2_interleaved_shards(spark, as_table(documents=odd)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows), key=str)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sharding.op2_interleaved_shards(spark, as_table(documents=empty)).count() == 0


def test_shards_match_the_mixture(spark):
    rng = random.Random(8)
    rows = [(i, "t", None, rng.choice(["a", "a", "a", "b", "c"]), 1, None, None) for i in range(1600)]
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA), "source", "doc_id", 16).collect()
    total = Counter(r.source for r in got)
    for shard in range(16):
        part = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(part[s] - total[s] / 16) <= 2 for s in total)


def test_classifier(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        t = words(rng, rng.randint(5, 300))
        if i % 4 == 0:
            t = " | ".join(t.split(" "))
        rows.append((i, t, None, None, None, None, None))
        labels.append((i, int(i % 4 != 0), 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = quality.scored(docs, quality.learn(docs, marks), ["doc_id"]).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all((r["__score"] >= 0.7) == (r.doc_id % 4 != 0) for r in held)
    few = quality.learn(docs, marks, sample_bytes=60)  # texts that fit are learned from, whole
    assert few is not None and quality.learn(docs, marks, sample_bytes=-1) is None
    assert quality.learn(empty, marks) is None and quality.learn(docs, marks.where("false")) is None
    assert {r["__score"] for r in quality.scored(docs, None, ["doc_id"]).collect()} == {0.5}


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model.new()
    x, of = rng.random((7, quality.FEATURES)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 2])
    parts = lambda: iter([(x[:2], of[:2]), (x[2:6], of[2:6]), (x[6:], of[6:])])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    model.w = {k: v.astype(np.float64) + (0.1 * rng.normal(size=v.shape) if k != "W" else 0) for k, v in model.w.items()}

    def loss():
        p = model.forward(parts(), 3)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = model.gradients(parts, y, weight)
    for k, v in model.w.items():
        at = tuple(int(i) for i in rng.integers(0, v.shape))
        before = v[at]
        v[at] = before + 1e-5
        up = loss()
        v[at] = before - 1e-5
        down = loss()
        v[at] = before
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), k


def plain_scores(w, texts):
    """Scores one passage at a time, by the formulas."""
    out = []
    for t in texts:
        data = (t or "").encode()
        e, h = [], []
        for k in range(max(1, -(-len(data) // quality.PASSAGE))):
            p = data[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            x = np.zeros(quality.FEATURES)
            for i in range(max(0, min(len(p), len(data) - k * quality.PASSAGE - 2))):
                a, b, c = data[k * quality.PASSAGE + i : k * quality.PASSAGE + i + 3]
                x[((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) % 2**32 * 0x27D4EB2F % 2**32) >> 23] += 1
            for c in p:
                x[quality.BUCKETS + int(quality._CLASS[c])] += 1
            x = np.sqrt(x / max(1, len(p)))
            x[quality.BUCKETS :] *= 2
            h.append(np.tanh(x @ w["W"] + w["a"]))
            e.append(np.exp((np.tanh(h[-1] @ w["V"]) / (1 + np.exp(-h[-1] @ w["U"]))) @ w["w"]))
        z = sum(a * b for a, b in zip(e, h, strict=True)) / sum(e)
        out.append(1 / (1 + np.exp(-(z @ w["c"] + w["b"][0]))))
    return out


@pytest.mark.parametrize("part", [2048, 3])
def test_classifier_query_against_plain_formulas(spark, odd, odd_rows, empty, as_table, monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)  # passages of a long text come in parts
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 99)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    where = as_table(documents=odd, labels=labels)
    got = quality.op3_quality_scores(spark, where).collect()
    assert sorted((str(r.doc_id), r.held_out, r.predicted == int(r.score >= 0.7)) for r in got) == sorted((str(r[0]), zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 4 == 2, True) for r in odd_rows)
    w = quality.learn(odd, labels).w
    want = Counter((r[0], round(float(p), 4)) for r, p in zip(odd_rows, plain_scores(w, [r[1] for r in odd_rows]), strict=True))
    near = Counter((r.doc_id, round(r.score, 4)) for r in got)
    assert sum((want - near).values()) <= 1  # rounding
    assert quality.op3_quality_scores(spark, as_table(documents=empty, labels=labels)).count() == 0
    assert {r.score for r in quality.op3_quality_scores(spark, as_table(documents=odd, labels=labels.where("false"))).collect()} == {0.5}


def test_classifier_takes_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "good text here" if i % 2 else "|| | ||") for i in range(200)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(200)], "doc_id string, quality int")
    got = quality.accept(docs, labels).collect()
    assert got and all(int(r.doc_id[1:]) % 2 for r in got)


def plain_shards(rows, shards=16):
    """(doc_id, size, crc, shard, slot) by the definition: ranks in the source, fractional ranks, cuts."""
    each = []
    for r in rows:
        t = (r[1] or "").encode()
        key = hashlib.md5(f"17:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        each.append(("" if r[3] is None else f"s{r[3]}", key, r[0], len(t) + 1, zlib.crc32(t)))
    low = lambda x: (x is not None, x or 0)
    order = []
    for s in {e[0] for e in each}:
        own = sorted((e for e in each if e[0] == s), key=lambda e: (e[1], low(e[2]), e[3], e[4]))
        order += [((2 * i + 1) / (2 * len(own)), s, e[1], low(e[2]), e[3], e[4], e) for i, e in enumerate(own)]
    out, n = [], len(each)
    for g, x in enumerate(sorted(order, key=lambda x: x[:6])):
        shard = g * shards // n
        out.append((x[6][2], x[6][3], x[6][4], shard, g - -(-shard * n // shards)))
    return sorted(out, key=str)


def test_shards_and_slots_are_those_of_the_definition(spark, odd, odd_rows, as_table):
    got = sharding.op2_interleaved_shards(spark, as_table(documents=odd)).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain_shards(odd_rows)


def test_the_whole_pipeline_against_plain_versions(spark, as_table):
    """Passages, near copies and junk are planted; each stage's plain version gives what should come out."""
    rng = random.Random(21)
    rows, labels = [], []
    passage = words(rng, 60)
    for i in range(260):
        t = words(rng, rng.randint(20, 200))
        if i % 9 == 4:
            t = " | ".join(t.split(" "))  # junk
        elif i % 7 == 3:
            t = t + " " + passage
        elif i % 11 == 5:
            t = rows[-1][1] + " zebra"  # a near copy
        rows.append((i, t, "en", f"src{i % 5 // 2}", len(t)))
        labels.append((i, int(i % 9 != 4), 0))
    rows += [(300, "", "en", "src0", 0), (301, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    where = as_table(documents=df, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = corpus_pipeline.run(spark, where).collect()

    w = quality.learn(df, spark.read.parquet(f"{where}/labels.parquet")).w
    left = [r for r, p in zip(rows, plain_scores(w, [r[1] for r in rows]), strict=True) if p >= 0.7]
    assert len(left) < len(rows) and all(r[0] % 9 != 4 for r in left if r[0] < 260)

    def shingles(t):
        x = (t or "").encode().lower().split()
        return {b" ".join(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set()

    sets = [shingles(r[1]) for r in left]
    near = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    comp = plain_components(list(range(len(left))), near)
    first = [r for i, r in enumerate(left) if comp[i] == i]
    assert len(first) < len(left)
    texts, seen = {}, set()
    for d, t, *_ in sorted(first):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                cover[i : i + 50] = b"\1" * 50
        seen |= {b[i : i + 50] for i in range(len(b) - 49)}
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and cover[j]:
                j += 1
            spans += [[i, j]] if j > i else []
            i = max(j, i + 1)
        texts[d] = suffix.kept(b, suffix.on_characters(b, np.array(spans, np.int64).reshape(-1, 2))).decode()
    assert sum(len(t or "") for _, t, *_ in first) > sum(map(len, texts.values()))
    pieces = {}
    for d, t in texts.items():
        ids = np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces[d] = [(d, k, k * 2048, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    times = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    assert set(times) == {p for x in pieces.values() for p in x}  # nothing is lost, nothing else is there
    assert set(times.values()) <= {1, 2} and 2 in times.values()  # the mixture repeats small sources up to twice
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048


@pytest.mark.parametrize("name", ["op1_temperature_mix", "op7_va_file_topk"])
def test_queries_against_their_sql(spark, name):
    where, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = catalog.queries()[name](spark, where).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_mixture_query_on_odd_rows_and_none(spark, odd, odd_rows, empty, as_table):
    got = mixing.op1_temperature_mix(spark, as_table(documents=odd)).collect()
    budget, total = plain_mix(odd_rows, 2.0)
    for s, n in total.items():
        own = [r for r in got if r.source == s]
        assert sum(r.tokens for r in own if r.epoch == 0) == n and budget[s] <= sum(r.tokens for r in own) < budget[s] + max(r.tokens for r in own)
    assert mixing.op1_temperature_mix(spark, as_table(documents=empty)).count() == 0
