"""Sinks, names, orders by language, budgets by tokenizer, summaries, contents of requests."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from docweave.functions import prompts
from docweave.operators import answering, chunking, tables
from docweave.sources import files, knowledge
from docweave.streaming import state
from docweave.streaming.store import Store


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("A & <B>", "t\x00ext\u0007", 1.5, ["x", "y"]), ('qu"ote', None, None, None), ("tab\tline\n", "  kept  ", 2.0, []), (None, "x", 1.0, []), *((f"n{i:03d}", "z", float(i), None) for i in range(300))], "entity_id string, `a<b` string, score double, many array<string>")
    edges = spark.createDataFrame([("A & <B>", 'qu"ote', 3, "says & does"), ("n001", "n002", None, None), ("n003", None, 1, "")], "src string, tgt string, n long, words string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of little data
    try:
        knowledge.write_graphml(nodes, edges, f"{tmp_path}/g")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "g").iterdir() if p.name.startswith("part-"))
    root = ET.fromstring("".join(p.read_text() for p in parts))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(parts) > 1 and len(root.findall(f"{ns}graph/{ns}node")) == 303 and len(root.findall(f"{ns}graph/{ns}edge")) == 2
    n, e = knowledge.read_graphml(spark, f"{tmp_path}/g")
    got = {r.entity_id: r.attributes for r in n.collect()}
    assert got["A & <B>"] == {"a<b": "text", "score": "1.5", "many": "x<SEP>y"} and got['qu"ote'] == {} and got["tab\tline\n"]["a<b"] == "  kept  "
    assert {(r.src, r.tgt): r.attributes for r in e.collect()} == {("A & <B>", 'qu"ote'): {"n": "3", "words": "says & does"}, ("n001", "n002"): {}}


def test_unique_names(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["a.txt", "a.txt", "a.txt", "b", "b", "a_002.txt", "c.x.y", "c.x.y"])], "id int, name string")
    taken = spark.createDataFrame([("b",), ("b_001",), ("zz",)], "name string")
    got = {r.id: r.file_name for r in files.unique_names(rows, "name", ["id"], 99, taken).collect()}
    assert got == {0: "a.txt", 1: "a_001.txt", 2: "a_003.txt", 3: "b_002", 4: "b_003", 5: "a_002.txt", 6: "c.x.y", 7: "c.x_001.y"}
    many = spark.range(1005).select("id", F.lit("m.t").alias("name"))
    got = [r.file_name for r in files.unique_names(many, "name", ["id"], 99).orderBy("id").collect()]
    assert len(set(got)) == 1005 and got[999] == "m_999.t" and got[1000:1002] == ["m_99_1.t", "m_99_2.t"]


def test_order_by_language(spark):
    rows = spark.createDataFrame([(n, n, i) for i, n in enumerate(["重庆.pdf", "北京.pdf", "安徽.pdf", "Zebra", "Äpfel", "apfel", "上海.pdf"])], "id string, file_path string, updated_at int")
    zh = [r.id for r in tables.page(rows, sort="file_path", descending=False, locale="zh").collect()]
    assert [x for x in zh if x.endswith("pdf")] == ["安徽.pdf", "北京.pdf", "上海.pdf", "重庆.pdf"] or [x for x in zh if x.endswith("pdf")] == ["安徽.pdf", "北京.pdf", "重庆.pdf", "上海.pdf"]
    assert [r.id for r in tables.page(rows, sort="id", descending=False, locale="de").collect()][:3] == ["apfel", "Äpfel", "Zebra"]
    assert [r.id for r in tables.page(rows, sort="id", descending=False).collect()][:2] == ["Zebra", "apfel"]


class Words:
    def encode(self, text):
        return text.split()

    def decode(self, tokens):
        return " ".join(tokens)


def test_budgets_by_a_tokenizer(spark):
    rows = spark.createDataFrame([(1, f"e{i}", i, "person", "one two three") for i in range(1, 6)], "query_id int, entity_id string, position int, entity_type string, description string")
    links = spark.createDataFrame([], "query_id int, src string, tgt string, position int, description string")
    param = answering.QueryParam(tokens=chunking.token_counter(Words()), max_entity_tokens=20)
    cost = len(rows.select(answering.entity_line(rows).alias("l")).first().l.split())
    assert answering.truncated(rows, links, param)[0].count() == 20 // cost < 5
    assert answering.truncated(rows, links, answering.QueryParam(max_entity_tokens=20))[0].count() == 0
    assert [r[0] for r in spark.createDataFrame([("a b",), (None,)], "t string").select(chunking.token_counter(Words())(F.col("t"))).collect()] == [2, 0]


def test_keywords_of_broken_json(spark):
    q = spark.createDataFrame([(1, "x", "mix"), (2, "y", "mix")], "query_id int, query string, mode string")
    say = lambda p: '<think>{"no": 1}</think>Here: {"high_level_keywords": ["a {b}", "c"], "low_level_keywords": ["d"],}' if p.endswith("x") else "none"
    got = {r.query_id: (r.high, r.low) for r in answering.with_keywords(q, say)[0].collect()}
    assert got == {1: (["a {b}", "c"], ["d"]), 2: ([], [])}


def test_contents_of_requests(spark):
    q = spark.createDataFrame([(1, "What is it?", "mix"), (2, "plain", "mix")], "query_id int, query string, mode string")
    items = spark.createDataFrame([(1, 1, "equation", "E=mc^2"), (1, 0, "table", "a|b")], "query_id int, position int, type string, content string")
    say = lambda p: '{"detailed_description": "shows ' + ("rows" if "table" in p else "energy") + '", "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}'
    got, new = answering.with_contents(q, items, say)
    got = {r.query_id: r.query for r in got.collect()}
    assert got[2] == "plain" and got[1].index("rows") < got[1].index("energy") and got[1].startswith("User query: What is it?") and new.count() == 2


def test_document_text(spark):
    rows = spark.createDataFrame([("d", 0, "text", "abc"), ("d", 1, "image", "p.png"), ("d", 2, "text", "defg"), ("d", 3, "image", "q.png"), ("e", 0, "image", "r.png"), ("f", 0, "text", None)], "doc_id string, position int, type string, text string")
    got = {r.doc_id: (r.text, r.images) for r in prompts.document_text(rows, 14).collect()}
    assert got == {"d": ("abc\n[image1]\nd", ["p.png"]), "e": ("[image1]", ["r.png"]), "f": ("", [])}
    assert {r.doc_id: r.text for r in prompts.document_text(rows, 100).collect()}["d"] == "abc\n[image1]\ndefg\n[image2]"


def test_document_text_that_ends_at_the_limit(spark):
    """The line feed in front of a span counts, even where nothing of the span is left."""
    rows = spark.createDataFrame([("d", 0, "text", "abcd"), ("d", 1, "text", "ef"), ("e", 0, "text", "abcde"), ("e", 1, "image", "/a.png"), ("f", 0, "text", "abcd"), ("f", 1, "image", "/a.png")], "doc_id string, position int, type string, text string")
    got = {r.doc_id: (r.text, r.images) for r in prompts.document_text(rows, 5).collect()}
    assert got == {"d": ("abcd\n", []), "e": ("abcde", []), "f": ("abcd\n", [])}


def test_summaries_in_the_graph(spark, tmp_path):
    """A hub's descriptions are summarised in packs; what is stored is one text, the same after any order of batches."""
    rows = [("Hub", "t", f"fact {i:03d} " + "x" * 2000, f"c{i}", f"d{i:03d}", "f", 0, 0) for i in range(12)] + [("Lone", "t", "short", "c0", "d000", "f", 0, 1)]
    schema = "entity_id string, entity_type string, description string, chunk_id string, full_doc_id string, file_path string, chunk_order_index int, record_order int"
    say = lambda texts: " ".join(sorted({w for t in texts for w in t.split() if w.isdigit()}))
    store = Store(spark, f"file://{tmp_path}/s", parts=2, buckets=1)
    for some in (rows[6:], rows[:6]):
        state.put(store, spark.createDataFrame(some, schema), None, summarize=say)
    got = {r.entity_id: r.descriptions for r in store.table("nodes").collect()}
    assert [t.replace("<SEP>", " ") for t in got["Hub"]] == [" ".join(f"{i:03d}" for i in range(12))] and got["Lone"] == ["short"]
