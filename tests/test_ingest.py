"""The store and what goes through it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.operators import answering, models, multimodal
from docweave.streaming import ingest
from docweave.streaming import store as store_module
from docweave.streaming.ingest import Store

DIMS = 32
EMBED = answering.hashed_embedder(DIMS)


def answers(c):
    """A model that makes of each word an entity, null for texts with `bad`."""
    word = F.regexp_extract(c, r"(\w+)", 1)
    return F.when(~c.contains("bad"), F.concat(F.lit("entity<|#|>"), word, F.lit("<|#|>thing<|#|>A thing called "), word, F.lit("\nrelation<|#|>"), word, F.lit("<|#|>Root<|#|>of<|#|>part of\n<|COMPLETE|>")))


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, text string")


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "commit", "half", "tidy"])
def test_a_run_that_stops_loses_nothing(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/s"
    one, two = docs(spark, ("a", "One text")), docs(spark, ("b", "Two text"))
    assert ingest.enqueue(Store(spark, root, parts=2, buckets=1), one) == 1

    class Broken(Store):
        def _write(self, change, *rest):
            super()._write(change, *rest)
            if step == "write":
                raise Stop

        def _commit(self, number, heads):
            if step == "half":
                self._fs.create(self._path(f"{self.root}/versions/{number:012d}"), False).close()
            if step in ("commit", "half"):
                raise Stop
            super()._commit(number, heads)

        def _tidy(self, number):
            raise Stop

    with pytest.raises(Stop):
        ingest.enqueue(Broken(spark, root), two)
    store = Store(spark, root)
    assert (store.parts, store.buckets) == (2, 1)
    assert {r.content for r in store.table("contents").collect()} == ({"One text", "Two text"} if step == "tidy" else {"One text"})
    if step == "half":  # it may be a writer at work
        with pytest.raises(RuntimeError):
            ingest.enqueue(store, two)
        monkeypatch.setattr(store_module, "GRACE", 0)
    ingest.enqueue(store, two)
    assert {r.content for r in store.table("contents").collect()} == {"One text", "Two text"} and store.table("docs").count() == 2


def test_failed_documents_are_tried_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", "fine text", None), ("b", "bad text", None), ("c", None, "no such file")], "file_path string, text string, error string")
    assert ingest.enqueue(store, rows, "track") == 3 and ingest.enqueue(store, rows) == 0
    assert {r.status for r in store.table("docs").collect()} == {"pending", "failed"}
    assert ingest.process(store, answers) == 1
    assert {r.file_path: r.status for r in store.table("docs").collect()} == {"a": "processed", "b": "failed", "c": "failed"}
    assert ingest.process(store, lambda c: F.coalesce(answers(c), F.lit("entity<|#|>Saved<|#|>thing<|#|>found"))) == 1
    assert {r.entity_id for r in ingest.merged(store)[0].collect()} == {"fine", "Saved"} and store.table("chunks").count() == 2


def test_from_documents_to_answers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    ingest.ingest(store, docs(spark, ("a", "Graphs join nodes"), ("b", "Soup needs salt"), ("c", "Rivers run")), answers, embedder=EMBED, dims=DIMS)
    known = ingest.knowledge(store, EMBED, DIMS)
    q = spark.createDataFrame([(1, "Soup needs salt", "naive", [], []), (2, "Graphs", "local", [], ["A thing called Graphs Graphs"])], "query_id int, query string, mode string, high array<string>, low array<string>")
    a = answering.retrieve(q, known, EMBED, DIMS, answering.QueryParam(threshold=0.5))
    assert ("b" in {r.file_path for r in a.chunks.where("query_id = 1").collect()}) and {r.entity_id for r in a.entities.collect()} == {"Graphs"}
    gone = store.table("docs").where("file_path = 'b'").select("id")
    ingest.delete(store, gone)
    assert store.table("vectors").count() == 2 and "Soup" not in {r.entity_id for r in ingest.merged(store)[0].collect()}


def test_blocks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [("d", 0, "text", "Words here", "", None), ("d", 1, "image", "", "p.png", ["cap"]), ("d", 2, "table", "", "t.png", None)]
    blocks = spark.createDataFrame(rows, "doc_id string, position int, type string, text string, img_path string, image_caption array<string>")
    files = spark.createDataFrame([("d", "d.pdf")], "doc_id string, file_path string")
    say = F.struct(F.concat(F.lit("shows "), F.col("type")).alias("description"), F.concat(F.lit("Main "), F.col("type")).alias("entity_name"), F.col("type").alias("entity_type"), F.lit("what it shows").alias("summary"))
    for _ in range(2):  # a repeated run adds nothing
        ingest.ingest_blocks(store, blocks, files, answers, say)
        chunks = store.table("chunks").orderBy("chunk_order_index").collect()
        assert [r.chunk_order_index for r in chunks] == [0, 1, 2] and "Image Path: p.png" in chunks[1].content
    nodes, edges = ingest.merged(store)
    assert {"Main image", "Main table", "Words"} <= {r.entity_id for r in nodes.collect()}
    assert ("Image", "Main image") in {(r.src, r.tgt) for r in edges.collect()}


def test_rebuild_from_cached_answers(spark):
    one, two = "entity<|#|>Alpha<|#|>thing<|#|>short", "entity<|#|>Alpha<|#|>thing<|#|>another text\nentity<|#|>Beta<|#|>thing<|#|>later"
    cache = spark.createDataFrame([("k1", "extract", "c1", one, 1), ("k2", "extract", "c1", two, 2), ("k3", "summary", "c1", "x", 0), ("k4", "extract", "c9", two, 0)], "cache_key string, cache_type string, chunk_id string, answer string, create_time long")
    chunks = spark.createDataFrame([("c1", "d", "f", 0, ["k1", "k2", "k3", "k4"])], "chunk_id string, full_doc_id string, file_path string, chunk_order_index int, llm_cache_list array<string>")
    nodes, _ = ingest.rebuilt(cache, chunks)  # of an entity, what the answer with the longer description says
    assert {r.entity_id: set(r.descriptions) for r in nodes.collect()} == {"Alpha": {"another text"}, "Beta": {"later"}}
    assert models.cache_entries(chunks, cache).count() == 2


def test_content_lists_and_trees(spark):
    lists = [("out/a/d_content_list.json", 1, '[{"type": "text", "text": "old"}]'), ("out/b/d_content_list.json", 2, '[{"type": "text", "text": "new", "page_idx": 0}, {"type": "image", "img_path": "i/x.png", "image_caption": ["c"], "page_idx": 1}]'), ("out/b/d.md", 3, "x")]
    got = multimodal.content_list(spark.createDataFrame(lists, "path string, modificationTime int, json string")).orderBy("position").collect()
    assert [(r.type, r.text, r.img_path) for r in got] == [("text", "new", None), ("image", None, "out/b/i/x.png")]
    rows = [("d", "body", "0", None, None, None, None, None, 0), ("d", "groups", "0", None, None, None, "body", "0", 1), ("d", "texts", "0", "text", "first", None, "body", "0", 0), ("d", "texts", "1", "formula", "x=1", None, "groups", "0", 0), ("d", "pictures", "0", None, None, "cap", "groups", "0", 1), ("d", "texts", "2", "text", "under", None, "pictures", "0", 0), ("d", "tables", "0", None, None, "tab", "body", "0", 2)]
    tree = spark.createDataFrame(rows, "doc_id string, kind string, num string, label string, text string, caption string, parent_kind string, parent_num string, place int")
    got = multimodal.flattened_tree(tree).orderBy("position").collect()
    assert [(r.type, r.text, r.caption) for r in got] == [("text", "first", None), ("equation", "x=1", None), ("image", None, "cap"), ("text", "under", None), ("table", None, "tab")]


def test_index_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    files = spark.createDataFrame([("a", "Some text", None), ("b", None, "broken")], "path string, text string, error string")
    assert {(r.status, r.n) for r in ingest.index_files(store, files, answers, dry_run=True).collect()} == {("readable", 1), ("failed", 1)} and store.tables() is None
    assert {(r.status, r.n) for r in ingest.index_files(store, files, answers).collect()} == {("processed", 1), ("failed", 1)}


def test_cache_gleaning_and_rebuild(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", parts=2, buckets=1)
    again = F.lit("entity<|#|>Late<|#|>thing<|#|>found the second time\nentity<|#|>Good<|#|>thing<|#|>x")
    model = lambda fails: lambda c: F.when(c.contains(ingest.GLEAN), again).otherwise(F.when(~c.contains("bad") | ~F.lit(fails), answers(F.regexp_replace(c, "bad", "Mended"))))
    rows = docs(spark, ("a", "Good text"), ("b", "bad text"))
    assert ingest.ingest(store, rows, model(True), glean=ingest.GLEAN, now=5) == 1
    assert {r.entity_id for r in ingest.merged(store)[0].collect()} == {"Good", "Late"}
    assert [tuple(r)[1] for r in store.table("usage").collect()] == [3]  # two chunks, and the good one a second time
    assert {(r.cache_type, r.create_time) for r in store.table("cache").collect()} == {("extract", 5), ("extract", 6)}
    assert ingest.process(store, model(False), glean=ingest.GLEAN, now=9) == 1
    assert sorted(r.call_count for r in store.table("usage").collect()) == [2, 3]  # only what failed
    nodes, edges = (sorted(map(str, df.collect())) for df in ingest.merged(store))
    assert len(nodes) == 3 and "A thing called Good" in "".join(nodes) and all(len(r.llm_cache_list) == 2 for r in store.table("chunks").collect())
    ingest.rebuild(store)
    assert (nodes, edges) == tuple(sorted(map(str, df.collect())) for df in ingest.merged(store))
    got = ingest.rebuilt(store.table("cache"), store.table("chunks"))
    assert sorted(r.entity_id for r in got[0].collect()) == ["Good", "Late", "Mended"]
    ingest.delete(store, store.table("docs").where("file_path = 'b'").select("id"))
    assert ingest.ingest(store, rows, model(True), glean=ingest.GLEAN) == 1  # its answers are there
    assert nodes == sorted(map(str, ingest.merged(store)[0].collect())) and store.table("usage").agg(F.sum("call_count")).first()[0] == 5
