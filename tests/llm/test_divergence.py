from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docweave.llm import divergence


def brute(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= 10}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s], "term": [(-f(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]}
            for part, found in parts.items():
                out += [(lang, s, part, x[2], -x[0], k) for k, x in enumerate(sorted(found), 1) if part == "pair" or k <= 10]
    return sorted(out)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉßz日") for _ in range(rng.randint(1, 3))) for _ in range(120)]
    out = []
    for i in range(n):
        lang, source = ["en", "de", None][min(i % 7, 2)], rng.choice(["a", "b", "B", None, "é", "a" if i % 2 else "hot", "hot"])
        text = rng.choice([" ", "-", "0", "[", "\n"]).join(rng.choice(words[: 40 + 80 * (source == "hot")]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 40)))
        out.append((text, lang, source))
    out += [(None, "en", "a"), ("", "xx", "no words"), (None, "xx", "nor here"), (None, None, None), ("few few", "yy", "once"), ("only " * 30, "zz", "one")] + [("word", "zz", "one"), ("word word", "zz", "two")] * 5
    return [*out, *out[:20], ("a b c dÉ " * 30_000, "en", "long")]


def run(spark, as_table, rows):
    df = spark.createDataFrame([(i, t, lang, s, 1, 2, "x") for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, rank int, term string")
    out = divergence.op12_source_divergence(spark, as_table(documents=df))
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize(("terms", "sources", "held", "step"), [(512, 64, 200_000, 1 << 20), (16, 2, 50, 64)])
def test_equals_brute_force(spark, as_table, monkeypatch, terms, sources, held, step):
    for name, value in (("TERMS", terms), ("SOURCES", sources), ("HELD", held), ("STEP", step)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    assert run(spark, as_table, rows) == brute(rows)


def test_odd_documents(spark, as_table, odd):
    got = sorted(map(tuple, divergence.op12_source_divergence(spark, as_table(documents=odd)).collect()))
    assert got == brute([(r.text, r.lang, r.source) for r in odd.collect()])


def test_none(spark, as_table):
    assert run(spark, as_table, []) == []
    assert run(spark, as_table, [("a", "en", "x")]) == []


def test_shares_are_exact():
    rng = random.Random(4)
    for top in (10, 10**6, 10**13, 4 * 10**15):
        for _ in range(200):
            total, kept = rng.randint(0, top), rng.randint(1, 1000)
            c = rng.randint(0, total)
            assert divergence.shares(np.array([c]), total, kept)[0] == 1 + 10**9 * (c + 2) // (total + 2 * kept)
