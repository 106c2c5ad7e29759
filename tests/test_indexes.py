"""Stored indexes, diameters and measures of many graphs against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import ann, graph, labels, vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ann_recall_pruning_and_appends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 60)  # several blocks a list
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((8, 12))
    x = (centre[np.arange(900) % 8] + 0.4 * rng.standard_normal((900, 12))).astype(np.float32)
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 12, 1), (None, rows[0][1], 1)]
    df = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>, query int")
    index = ann.Index(spark, f"file://{tmp_path}/i").build(df(rows[:600] + odd), 8)
    lists = sorted(p.name for p in (tmp_path / "i/lists").iterdir() if p.name.startswith("list_no"))
    index.append(df(rows[600:]))
    assert lists == sorted(p.name for p in (tmp_path / "i/lists").iterdir() if p.name.startswith("list_no")) and len(lists) == 8
    q = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 900, 45)] + [(-1, [0.0] * 12), (-2, None), (-3, [1.0])], "query_id long, query array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    best = {i: np.argsort(-(u @ u[i]), kind="stable")[:10] for i in range(0, 900, 45)}
    got = index.search(q, 10, 3).collect()
    found = {i: {int(r.vec_id) for r in got if int(r.query_id) == i} for i in best}
    assert {int(r.query_id) for r in got} == set(best) and all(len(f) == 10 for f in found.values())
    assert sum(len(found[i] & set(best[i].tolist())) for i in best) >= 0.9 * 10 * len(best)
    assert all(math.isclose(r.score, float(u[int(r.query_id)] @ u[int(r.vec_id)]), abs_tol=1e-5) for r in got)
    every = {(r.query_id, r.vec_id) for r in index.search(q, 900, 8).collect()}
    assert len(every) == 900 * len(best)  # nothing is lost when all lists are probed
    pruned = plan(index.lists([2]))
    assert "PartitionFilters: [isnotnull(list_no" in pruned and index.lists([2]).select("list_no").distinct().count() == 1
    assert index.search(q.where("query_id < 0"), 5, 2).count() == 0


TEXTS = ["Graph database", "graph theory", "Database of graphs", "知识图谱", "图谱", "知识", "知", "Kühe und GRAPH", "", "graph graph graph", "a-b_c", "データ 図書館"] + [f"word{i % 5} common thing{i}" for i in range(40)]


def words(text):
    cjk = "぀-ヿ㐀-䶿一-鿿가-힯"
    low = text.lower()
    out = re.findall(rf"(?:(?![{cjk}_])\w)+", low)
    for run in re.findall(f"[{cjk}]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def bm25(texts, query, limit):
    docs = {t: Counter(words(t)) for t in set(texts)}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    out = []
    for t, c in docs.items():
        hit = [w for w in set(words(query)) if c[w]]
        if hit:
            size = sum(c.values())
            out.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in hit), 9), t))
    return [(t, -s) for s, t in sorted(out)[:limit]]


def test_fulltext(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, TEXTS[0], None]], "entity_id string")
    index = labels.LabelIndex(spark, f"file://{tmp_path}/l", 4).build(rows)
    split, rests = labels.LabelIndex._split, []
    monkeypatch.setattr(labels.LabelIndex, "_split", lambda self, *a: rests.append((s := split(self, *a))[1]) or s)
    queries = ["graph", "GRAPH database, graphs", "知识图谱", "知", "common word3 thing7", "common word3", "图书", "nothing here", " ", "thing1 common"]
    for q, limit in itertools.product(queries, (2, 50)):
        assert [(r.label, pytest.approx(r.score, abs=1e-8)) for r in index.search(q, limit).collect()] == bm25(TEXTS, q, limit), (q, limit)
    assert any(rests)  # some lists were read for candidates only
    many = labels.search_many(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), 3).orderBy("query_id", "rank").collect()
    for i, q in enumerate(queries):
        assert [r.label for r in many if r.query_id == i] == [t for t, _ in bm25(TEXTS, q, 3)]
    assert "PartitionFilters: [" in plan(index._of("postings", ["graph"]))


def longest(nodes, edges):
    around = {n: set() for n in nodes}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    far = 0
    for n in nodes:
        seen, todo = {n: 0}, [n]
        for x in todo:
            for y in around[x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        if len(seen) < len(nodes):
            return math.inf
        far = max(far, *seen.values())
    return far


def connected(rng, n, more):
    edges = {(f"n{rng.randrange(i // 2, i)}", f"n{i}") for i in range(1, n)}
    edges |= {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(more)}
    return sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})


def test_diameter(spark):
    rng = random.Random(2)
    frame = lambda e: spark.createDataFrame(e, "src string, tgt string")
    e = connected(rng, 30, 10)
    assert graph.diameter(frame(e), 3) == longest({x for p in e for x in p}, e)
    assert graph.diameter(frame([])) == 0


def test_many_graphs(spark):
    rng = random.Random(5)
    graphs = {g: connected(rng, 5 + 30 * g, 6) for g in range(3)}
    graphs[4] = [("a", "b"), ("c", "d"), ("b", "e"), ("a", "e")]
    nodes = {g: sorted({x for p in e for x in p}) for g, e in graphs.items()}
    nodes[4].append("alone")
    nodes |= {5: ["x"], 6: ["x"], 7: ["x"]}
    graphs |= {6: [("x", "gone")], 7: [("x", None)]}
    n = spark.createDataFrame([(g, x) for g, xs in nodes.items() for x in xs], "graph int, entity_id string")
    e = spark.createDataFrame([(g, a, b) for g, ps in graphs.items() for a, b in ps], "graph int, src string, tgt string")
    got = {r.graph: r for r in graph.many_metrics(n, e).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5, 6, 7]
    assert got[6].error == "an edge ends in no node: gone" and got[7].error == "an edge has no end" and got[6].num_nodes is None and got[5].error is None
    for g in (0, 2, 4):
        assert got[g].diameter == longest(nodes[g], graphs[g])
        one = graph.metrics(n.where(F.col("graph") == g), e.where(F.col("graph") == g), with_diameter=False).first()
        assert all(got[g][c] == pytest.approx(one[c]) for c in graph.MEASURES if c != "diameter"), g
    assert (got[5].num_nodes, got[5].num_components, got[5].diameter, got[5].mean_size) == (1, 1, 0, 0)


@pytest.mark.parametrize("searches", [0, 10**6])
def test_diameters_by_joins_and_by_tasks(spark, monkeypatch, searches):
    """Both ways to search give the diameters of all graphs, side by side, however many nodes go at a time."""
    rng = random.Random(11)
    graphs = {g: connected(rng, 4 + 17 * g, g) for g in range(1, 4)} | {9: [(f"n{i:02d}", f"n{(i + 1) % 13:02d}") for i in range(13)]}
    link = spark.createDataFrame([(g, 1000 * g + int(a[1:]), 1000 * g + int(b[1:])) for g, ps in graphs.items() for p in ps for a, b in (p, p[::-1])], "g int, u long, v long")
    monkeypatch.setattr(graph, "SEARCHES", searches)
    want = {g: longest({x for p in ps for x in p}, ps) for g, ps in graphs.items()}
    assert {r.g: r.diameter for r in graph._diameters(link, "g", 5).collect()} == want
    monkeypatch.setattr(graph, "LINKS", 40)  # the smallest by tasks, all others by joins
    assert {r.g: r.diameter for r in graph._diameters(link, "g").collect()} == want


def test_measures_of_a_hub(spark, monkeypatch):
    """A diameter takes no rows by pairs of nodes."""
    rows, write = [], graph.written

    def counted(df, *by):
        out = write(df, *by)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    leaves = spark.range(2000).select(F.lit(1).alias("graph"), F.format_string("x%05d", "id").alias("entity_id"))
    e = leaves.select("graph", F.lit("hub").alias("src"), F.col("entity_id").alias("tgt"))
    got = graph.many_metrics(leaves.unionByName(spark.createDataFrame([(1, "hub")], "graph int, entity_id string")), e).first()
    assert (got.num_nodes, got.num_edges, got.diameter, got.average_clustering, got.num_components) == (2001, 2000, 2.0, 0.0, 1)
    assert sum(rows) < 12 * 2001


def test_a_lists_best_over_its_blocks(spark, tmp_path, monkeypatch):
    """Of a list's blocks a task hands on its best candidates together, not each block's; odd vectors have no unit."""
    rng = random.Random(4)
    rows = [(f"v{i:04d}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(600)] + [("zero", [0.0] * 6), ("none", None), ("hole", [1.0, None] * 3), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").coalesce(1)
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "HELD", 1 << 20)
    handed, in_arrow = {}, type(df).mapInArrow

    def counted(df, f, schema, *more):
        out = in_arrow(df, f, schema, *more)
        if "about" in schema:
            handed["about"] = out.count()
        return out

    monkeypatch.setattr(type(df), "mapInArrow", counted)
    index = ann.Index(spark, f"{tmp_path}/i").build(df, 2)
    assert {r.vec_id for r in spark.read.parquet(f"{tmp_path}/i/lists").select(F.explode("ids").alias("vec_id")).collect()} == {f"v{i:04d}" for i in range(600)}
    q = df.where("vec_id < 'v0040'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in index.search(q, 5, 2, refine=4).collect()}
    want = vector.search_many(df.where("vec_id like 'v%'"), q, 5).collect()
    assert len(want) == 200 and sum(got[r.query_id, r["rank"]] == r.vec_id for r in want) >= 190
    assert handed["about"] <= 40 * 2 * 20 * 4  # a list's best once a task, not once a block


@pytest.mark.parametrize("links", [0, 1 << 20])
def test_diameter_from_a_start_among_hubs(spark, monkeypatch, links):
    """The first search starts at a hub, all of whose farthest nodes are as near as hubs are; no leaf is searched from for that."""
    e = [(f"A{i}", f"B{j}") for i in range(3) for j in range(4)] + [(f"B{i % 4}", f"C{i:03d}") for i in range(200)]
    monkeypatch.setattr(graph, "LINKS", links)
    monkeypatch.setattr(graph, "SEARCHES", 0)
    monkeypatch.setattr(graph, "_eccentricities", None)
    assert graph.diameter(spark.createDataFrame(e, "src string, tgt string")) == 4


def test_edges_without_the_lists_nobody_asked_for(spark):
    rows = [("a", "b", 1.0, "y,x", "d1", "c1", "f1", 1, "01"), ("b", "a", 2.0, "z", "d2", "c2", "f2", 2, "02"), ("a", "c", 4.0, "x", "d1", "c1", "f1", 1, "03")]
    df = spark.createDataFrame(rows, "src string, tgt string, weight double, keywords string, description string, source_id string, file_path string, ts int, seq string")
    kept = ("src", "tgt", "weight", "keywords", "source_ids")
    whole, short = graph.merge_edges(df), graph.merge_edges(df, texts=False, paths=False)
    assert sorted(short.select(*kept).collect()) == sorted(whole.select(*kept).collect()) and len(whole.collect()) == 2
    assert all(r.file_paths == [] and r.descriptions == [] for r in short.collect())
