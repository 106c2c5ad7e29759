from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import extraction, names
from docweave.functions import text as T
from docweave.operators import chunking, evaluation, graph, multimodal, provenance, retrieval, tables, vector
from docweave.plans import catalog
from docweave.sources import files, knowledge
from docweave.streaming import ingest


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("broken", ["<|##|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<#>", "<|#>", "<X#|>", "<|#|", "<|#:", "<||#>", "|#|>", "||#||", "<|#|||#|>", "<|#||"])
def test_delimiters(spark, broken):
    assert one(spark, f"entity{broken}Alice", T.repair_delimiters) == "entity<|#|>Alice"


@pytest.mark.parametrize(
    ("text", "want"),
    [("  a&amp;b \x01\n", "a&b"), ("&lt;p&gt; \u009fx", "<p> x"), ("￾a", "a"), ("", ""), (None, None)],
)
def test_sanitize(spark, text, want):
    assert one(spark, text, T.sanitize) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [('"x"', "x"), ('"a"b"', '"a"b"'), ("《书》", "书"), ("ＡＢ１", "AB1"), ("中 文 a b", "中文a b"), ("12", ""), ("123", "123"), ("1.2.3", ""), ("12.34.56", "12.34.56"), ("a<br>b", "ab"), ("“中”", "中"), ("", "")],
)
def test_names(spark, name, want):
    assert one(spark, name, T.normalize_name) == want


def test_inner_quotes(spark):
    assert one(spark, "a“b” '中'", lambda c: T.normalize_name(c, True)) == "ab 中"


@pytest.mark.parametrize(
    ("name", "want"),
    [("kglm", "KGLM"), ("deep_learning", "Deep Learning"), ("Table 7: Results", "Table 7: Results (table)"), ("Fig. 2 - x", "Fig. 2-x (image)"), ("eq 3: y (equation)", "Eq 3: Y (equation)"), ("a  -  b", "A-b"), (None, "")],
)
def test_surface(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(names.surface_form(F.col("n"))).first()[0] == want


def test_path_keys(spark):
    text = "Image Path: out/figs_1/my-image.png\nsee /usr/share/some_dir and ~/x/12"
    assert spark.createDataFrame([(text,)], "t string").select(names.path_fragment_keys(F.col("t"))).first()[0] == ["figs 1", "my image", "out", "share", "some dir", "usr", "~"]


def test_records(spark):
    text = "entity<|#|>Alice<|#|>person<|#|>A researcher.\nentity<|#|>Lab<|#|>organization<|#|>Where Alice works.\nrelation<|#|>Alice<|#|>Lab<|#|>employment，work<|#|>2.5\nentity<|#|>Bob<|#|>person\n<|COMPLETE|>"
    df = extraction.records(spark.createDataFrame([("c1", text)], "chunk_id string, text string"))
    assert [(r.entity_name, r.entity_type) for r in extraction.entities(df, True).orderBy("record_order").collect()] == [("Alice", "person"), ("Lab", "organization")]
    r = extraction.relations(df).first()
    assert (r.src_id, r.tgt_id, r.keywords, r.weight) == ("Alice", "Lab", "employment,work", 2.5)


def test_gleaned(spark):
    schema = "chunk_id string, record_order int, entity_name string, description string"
    a = spark.createDataFrame([("c", 0, "A", "long one"), ("c", 1, "B", "x")], schema)
    b = spark.createDataFrame([("c", 0, "A", "short"), ("c", 1, "B", "longer"), ("c", 2, "C", "new")], schema)
    got = {(r.entity_name, r.description) for r in extraction.gleaned(a, b, ["chunk_id", "entity_name"]).collect()}
    assert got == {("A", "long one"), ("B", "longer"), ("C", "new")}


class Multi:
    """Upper case letters take two tokens, marks three."""

    def encode(self, text):
        return [(c, k) for c in text for k in range(2 if c.isupper() else 3 if c in "!?." else 1)]

    def decode(self, tokens):
        return "".join(c for c, k in tokens if k == 0)


CHAR = chunking.CharTokenizer()


def test_windows_overlap(spark):
    want = [(10, "0123456789"), (10, "789abcdefg"), (10, "efghijklmn"), (4, "lmno")]
    assert chunking.by_tokens(CHAR, "0123456789abcdefghijklmno", 10, 3) == want
    got = one(spark, "0123456789abcdefghijklmno", lambda c: chunking.windows(c, 10, 3))
    assert [(r.tokens, r.content) for r in got] == want
    assert one(spark, "", lambda c: chunking.windows(c, 10, 3)) == []
    with pytest.raises(ValueError):
        chunking.windows(F.col("x"), 10, 10)


def test_delimiter_only(spark):
    assert chunking.by_delimiter(CHAR, "alpha\n\nbeta", 10, 0, "\n\n", True) == [(5, "alpha"), (4, "beta")]
    with pytest.raises(chunking.ChunkTooLong) as e:
        chunking.by_delimiter(CHAR, "x" * 100, 10, 0, "\n\n", True)
    assert (e.value.tokens, e.value.limit, e.value.preview) == (100, 10, "x" * 80)
    assert [r.content for r in one(spark, "alpha\n\nbeta", lambda c: chunking.delimited_only(c, "\n\n", 10))] == ["alpha", "beta"]
    with pytest.raises(Exception, match="12 tokens are over the limit of 5"):
        one(spark, "a" * 12, lambda c: chunking.delimited_only(c, "\n", 5))


def test_tokens_are_not_characters():
    assert [n for n, _ in chunking.by_tokens(Multi(), "AB.c", 4, 1)] == [4, 4, 2]


@pytest.mark.parametrize("name", list(chunking.STRATEGIES))
def test_strategies_keep_the_budget(name):
    text = "# One\n\nFirst sentence here. Second one! " + "word " * 60 + "\n\n# Two\n\nshort\n\n" + "x" * 130
    chunks = chunking.strategy(name.upper())(CHAR, text, 50, 10)
    assert chunks and all(len(c) <= 50 for _, c in chunks)
    assert all(w in " ".join(c for _, c in chunks) for w in ("sentence", "short"))
    with pytest.raises(ValueError):
        chunking.strategy("none")


def test_sentences_overlap():
    assert chunking.sentences(CHAR, "aaaa. bbbb. cccc.", 11, 5) == [(11, "aaaa. bbbb."), (11, "bbbb. cccc.")]


def test_rerank_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    got = one(spark, text, lambda c: chunking.rerank_windows(c, 100, 10))
    assert len(got) == 6 and got[0] == text[:400] and got[1] == text[360:760] and got[-1].endswith(text[-1])
    assert one(spark, "abcdef", lambda c: chunking.rerank_windows(c, 1, 5)) == ["abcd", "ef"]


def test_edge_ranking(spark):
    nodes = spark.createDataFrame([("HUB_NODE", 0.3), ("RELEVANT_NODE", 0.95)], "entity_id string, score double")
    edges = spark.createDataFrame([("HUB_NODE", "OTHER_A", 120, 5.0), ("HUB_NODE", "OTHER_B", 110, 4.0), ("OTHER_C", "RELEVANT_NODE", 5, 1.0)], "src string, tgt string, degree int, weight double")
    assert [r.src if r.src.startswith("OTHER") else r.tgt for r in graph.rank_edges(edges, nodes).orderBy("rank").collect()] == ["OTHER_C", "OTHER_A", "OTHER_B"]


@pytest.fixture()
def small(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "entity_id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "d", 1.0), ("e", "f", 1.0)], "src string, tgt string, weight double")
    return nodes, edges


def test_neighbourhood(small):
    got, edges, cut = graph.neighbourhood(*small, "a", 1, 2)
    assert [r.entity_id for r in got.orderBy("level").collect()] == ["a", "c"] and cut and edges.count() == 1
    got, edges, cut = graph.neighbourhood(*small, "a", 3, 100)
    assert {(r.entity_id, r.level) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)} and not cut and edges.count() == 4


def test_metrics(small):
    m = graph.metrics(*small).first()
    assert (m.num_nodes, m.num_edges, m.num_components, m.giant_size, m.isolated) == (7, 5, 3, 4, 1)
    assert m.average_clustering == pytest.approx((1 + 1 + 1 / 3) / 3)  # over nodes of two edges or more
    assert (m.diameter, m.mean_size, m.trimmed_mean_size, m.num_components_above_mean, m.num_nodes_excluding_isolated) == (float("inf"), 3, 3, 1, 6)
    assert graph.metrics(small[0].where("entity_id < 'e'"), small[1].where("src < 'e'")).first().diameter == 2


def test_rename_and_delete(small):
    nodes, edges = graph.rename(*small, "c", "z")
    assert {(r.src, r.tgt) for r in edges.collect()} == {("a", "b"), ("b", "z"), ("a", "z"), ("d", "z"), ("e", "f")}
    with pytest.raises(ValueError):
        graph.rename(*small, "a", "b")
    gone = small[1].where("src = 'a' and tgt = 'b'").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    assert graph.delete_edges(small[1], gone).count() == 4


def test_merge_with_existing(spark):
    new = spark.createDataFrame([("A", "x", "new", "c2", "f", 1, 1), ("A", "y", "newer", "c3", "f", 0, 2)], "entity_id string, entity_type string, description string, source_id string, file_path string, ts long, seq long")
    old = spark.createDataFrame([("A", "y", ["old"], ["c1", "c2"], ["g"]), ("B", "z", ["b"], ["c9"], ["h"])], "entity_id string, entity_type string, descriptions array<string>, source_ids array<string>, file_paths array<string>")
    got = {r.entity_id: r for r in graph.merge_nodes(new, old).collect()}
    assert (got["A"].entity_type, got["A"].source_ids, got["A"].descriptions, got["A"].file_paths) == ("y", ["c1", "c2", "c3"], ["old", "newer", "new"], ["g", "f"])
    assert got["B"].entity_type == "z" and got["B"].source_ids == ["c9"]


def test_polling(spark):
    rows = [(0, k, f"a{k}") for k in range(1)] + [(1, k, f"b{k}") for k in range(5)]
    got = provenance.weighted_polling(spark.createDataFrame(rows, "item int, pos int, chunk string"), "item", "pos", "chunk", 3).orderBy("pick").collect()
    assert [r.chunk for r in got] == ["a0", "b0", "b1", "b2"]


def test_polling_beyond_the_last_item(spark):
    """An item behind a gap in the ranks has a quota below zero, which takes from what is left over."""
    rows = [(0, 0, "a0")] + [(2, k, f"b{k}") for k in range(3)]
    for by in ([], ["c"]):
        df = spark.createDataFrame(rows, "item int, pos int, chunk string").withColumn("c", F.lit(1))
        got = provenance.weighted_polling(df, "item", "pos", "chunk", 3, by=by).orderBy("pick").collect()
        assert [r.chunk for r in got] == ["a0", "b0"]


def test_limits(spark):
    df = spark.createDataFrame([(["a", "", "b"], ["b", "c"])], "o array<string>, n array<string>")
    pick = lambda c: df.select(c).first()[0]
    m = provenance.merge_ids(F.col("o"), F.col("n"))
    assert pick(m) == ["a", "b", "c"] and pick(provenance.limit_ids(m, 2)) == ["b", "c"] and pick(provenance.limit_ids(m, 2, "KEEP")) == ["a", "b"] and pick(provenance.limit_ids(m, 0)) == []
    assert pick(provenance.merge_paths(m, 2)) == ["b", "c", "...truncated...(FIFO)"]


def test_scores(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.8), (0, 2, 0.6), (1, 3, 0.7), (1, 4, 0.4)], "doc int, pos int, s double")
    for how, want in (("max", [0.8, 0.7]), ("first", [0.5, 0.7]), ("unknown", [0.8, 0.7])):
        assert [r.relevance_score for r in provenance.rerank_scores(df, "doc", "pos", "s", how).orderBy("doc").collect()] == want


def test_context(spark):
    rows = [(f"c{i}", "x" * 10, "f1" if i % 2 else "f2", i, 0.9 if i else 0.1) for i in range(6)]
    got = retrieval.context(spark.createDataFrame(rows, "chunk_id string, content string, file_path string, position int, rerank_score double"), 35, 5, 0.3).orderBy("position").collect()
    assert [(r.id, r.chunk_id, r.reference_id) for r in got] == [("DC1", "c1", "1"), ("DC2", "c2", "2"), ("DC3", "c3", "1")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector.search(df, [2.0, 0.0], 5).collect()] == [1, 3]


def test_pages_and_status(spark):
    df = spark.createDataFrame([(str(i), i, "failed" if i % 2 else "processed") for i in range(30)], "id string, updated_at int, status string")
    got = tables.page(df, 0, 3, "nonsense", status="failed").collect()
    assert [r.updated_at for r in got] == list(range(29, 9, -2)) and got[0].total == 15


def test_official_and_nan(spark):
    df = spark.createDataFrame([("1 yes", "text-only"), ("0", "text-only"), ("0", "una")], "eval string, type string")
    assert {r.kind: r.accuracy for r in evaluation.official(df).collect()} == {"micro": pytest.approx(1 / 3, abs=1e-6), "text": 0.5, "una": 0.0}


def test_cut_context(spark):
    assert one(spark, "aaaa bbbb. cc", lambda c: multimodal.cut_context(c, 11)) == "aaaa bbbb."
    assert one(spark, "a. bbbbbbbbbbbbb", lambda c: multimodal.cut_context(c, 10)) == "a. bbbbbbb..."


def office(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return b.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    doc = office({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a\\b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>"})
    assert files.docx_text(doc) == "one\n\na\\\\b\tc\n\ntwo"
    ppt = office({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody><a:p><a:r><a:t>hi</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'})
    assert files.pptx_text(ppt) == "hi\n"
    book = office({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>x\ty</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="B3"><v>7</v></c></row></sheetData></worksheet>'})
    assert files.xlsx_text(book).split("\n")[1:] == ["x\\ty\t", "", "\t7"]
    with pytest.raises(ValueError):
        files.docx_text(office({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"}))
    for name, data in (("a.docx", doc), ("b.txt", b"text"), ("c.txt", b"\xff"), ("d.pdf", b"%PDF"), ("e.bin", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.text, bool(r.error)) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == ("text", False) and got["c.txt"][1] and got["d.pdf"][1] and got["a.docx"][0].startswith("one")
    known = files.find_files(spark, str(tmp_path)).where("path like '%a.docx'")
    assert {r.path.rpartition("/")[2] for r in files.find_files(spark, str(tmp_path), known).collect()} == {"b.txt", "c.txt", "d.pdf"}


def test_graph_files(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "id string").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([("a", "c")], "source string, target string").write.parquet(f"{tmp_path}/e")
    n, e = knowledge.read_parquet_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert sorted(r.entity_id for r in n.collect()) == ["a", "b", "c"] and e.first().weight == 1.0
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="kind" attr.type="string"/><graph><node id="x"><data key="d0">t</data></node><node id="y"/><edge source="y" target="x"/></graph></graphml>')
    n, e = knowledge.read_graphml(spark, f"{tmp_path}/g.graphml")
    assert {r.entity_id: dict(r.attributes) for r in n.collect()} == {"x": {"kind": "t"}, "y": {}} and (e.first().src, e.first().tgt) == ("x", "y")
    (tmp_path / "kv.json").write_text('{"k1": {"a": 1}, "k2": {"a": 2}}')
    assert {(r.id, r.a) for r in knowledge.read_json_kv(spark, f"{tmp_path}/kv.json", "a: int").collect()} == {("k1", 1), ("k2", 2)}
    knowledge.export(n.select("entity_id"), e.select("src", "tgt"), f"{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out/relations", header=True).count() == 2


def test_custom_graph(spark):
    chunks = spark.createDataFrame([("one", "s", 0), ("two", "s", 1)], "content string, source_id string, position int")
    ents = spark.createDataFrame([("A", "t", "d", "s"), ("B", "t", "d", "nowhere")], "entity_name string, entity_type string, description string, source_id string")
    rels = spark.createDataFrame([("A", "Z", "rel", 0.9, "s")], "src_id string, tgt_id string, description string, weight double, source_id string")
    c, n, e = knowledge.load_custom(chunks, ents, rels)
    last = c.where("content = 'two'").first().chunk_id
    got = {r.entity_id: r for r in n.collect()}
    assert got["A"].source_id == last and got["B"].source_id == "UNKNOWN" and (got["Z"].entity_type, got["Z"].description) == ("UNKNOWN", "rel")
    assert e.first().weight == 0.9


def answers(content):
    name = F.regexp_extract(content, r"^(\w+)", 1)
    return F.concat(F.lit("entity<|#|>"), name, F.lit("<|#|>thing<|#|>about "), name, F.lit("\nentity<|#|>Hub<|#|>thing<|#|>hub\nrelation<|#|>"), name, F.lit("<|#|>Hub<|#|>k<|#|>joined\n<|COMPLETE|>"))


def graph_of(store):
    nodes, edges = ingest.merged(store)
    return sorted(map(str, nodes.collect())), sorted(map(str, edges.collect()))


def test_ingest(spark, tmp_path):
    rows = [("f1", "Alpha text"), ("f2", "Beta text"), ("f3", " Alpha text\n"), ("f4", "  ")]
    docs = spark.createDataFrame(rows, "file_path string, text string")
    store = ingest.Store(spark, f"file://{tmp_path}/a")
    assert ingest.ingest(store, docs.limit(1), answers) == 1 and ingest.ingest(store, docs, answers) == 1 and ingest.ingest(store, docs, answers) == 0
    whole = ingest.Store(spark, f"file://{tmp_path}/b")
    ingest.ingest(whole, docs, answers)
    assert graph_of(store) == graph_of(whole)
    ingest.ingest(store, spark.createDataFrame([("f5", "Gamma text")], docs.schema), answers)
    gone = store.tables()["docs"].where("file_path = 'f5'").select("id").collect()
    ingest.delete(store, spark.createDataFrame(gone, "id string"))
    assert graph_of(store) == graph_of(whole)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Alpha text")
    store = ingest.Store(spark, f"file://{tmp_path}/s")
    for name, text in (("b", "Beta text"), ("c", "Alpha text")):
        ingest.follow(store, f"{tmp_path}/in", answers, f"{tmp_path}/check").awaitTermination()
        (tmp_path / f"in/{name}.txt").write_text(text)
    ingest.follow(store, f"{tmp_path}/in", answers, f"{tmp_path}/check").awaitTermination()
    assert {r.content for r in store.tables()["contents"].collect()} == {"Alpha text", "Beta text"}


def test_search_to_the_last_bit(spark, monkeypatch):
    """Near and equal scores, odd rows, ids of any kind and repeated: what comparing all pairs by cosine() gives, over any blocks."""
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(12)]
    rows = [(i, [x * s for x in base[i % 12]]) for i in range(90) for s in [rng.choice([1.0, 1.0, 3.0, 1e-3, 0.1])]]
    rows += [(90, None), (91, [0.0] * 7), (92, [1.0]), (93, base[0][:6] + [None]), (94, [1e-30] * 7), (95, [1e30] * 7), (None, base[1]), (5, base[2]), (5, base[2]), (96, [float("nan")] * 7), (97, []), (98, [1e200] * 7), (99, [-1e-200] * 7)]
    for kind, cut in (("float", 95), ("double", 200)):
        some = [(i, v, "x") for i, v in rows if i is None or i < cut]
        df = spark.createDataFrame(some, f"vec_id long, embedding array<{kind}>, label string")
        df = df.withColumns({"pair": F.when(F.col("vec_id").isNotNull(), F.struct((F.col("vec_id") % 7).cast("string").alias("a"), "vec_id")), "name": F.col("vec_id").cast("string")})
        q = df.where("vec_id % 5 < 2 or vec_id > 89").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).distinct()
        for row_id, k, threshold in (("vec_id", 4, None), ("pair", 9, 0.3), ("name", 30, 0.999999), ("vec_id", 0, None)):
            each = df.crossJoin(q).withColumn("score", vector.cosine(F.col("embedding"), F.col("query"))).where("score is not null").where(F.lit(True) if threshold is None else F.col("score") >= threshold)
            want = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), row_id))).where(F.col("rank") <= k).drop("query")
            want = sorted(map(repr, (r.asDict() for r in want.select("vec_id", "query_id", "score", "rank", "label").collect())))
            for size in ((4096, 1 << 16, 1024), (7, 20, 8)):
                for name, n in zip(("QUERY_BLOCK", "ROW_BLOCK", "TILE"), size, strict=True):
                    monkeypatch.setattr(vector, name, n)
                got = vector.search_many(df, q, k, threshold, row_id).select("vec_id", "query_id", "score", "rank", "label")
                assert sorted(map(repr, (r.asDict() for r in got.collect()))) == want, (kind, row_id, size)


def test_search_of_any_number_of_queries(spark, monkeypatch):
    rows = [(i, [float(i * 37 % 101 - 50), float(i * 53 % 89 - 40), 1.0]) for i in range(1100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector, "QUERY_BLOCK", 500)
    monkeypatch.setattr(vector, "ROW_BLOCK", 400)
    q = df.selectExpr("vec_id AS query_id", "embedding AS query")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vector.search_many(df, q, 2).collect()}
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v in rows]
    assert len(got) == 2200
    for i in range(0, 1100, 50):
        score = [sum(a * b for a, b in zip(unit[i], u, strict=True)) for u in unit]
        best = sorted(score, reverse=True)[:2]
        assert [round(score[got[i, n]], 9) for n in (1, 2)] == [round(x, 9) for x in best]


def texts(n, seed):
    rng = random.Random(seed)
    bits = ["a", "bb ", "ccc. ", "\n", "\n\n", "d", "e ", ". ", "! ", "? ", "x" * 25]
    return [("".join(rng.choice(bits) for _ in range(rng.randint(0, 50))), size := rng.randint(2, 50), rng.randint(0, size - 1)) for _ in range(n)]


def test_paragraphs_against_a_plain_loop():
    for text, size, overlap in texts(300, 1):
        want, held = [], ""
        for p in filter(None, map(str.strip, text.split("\n\n"))):
            if held and len(held) + 2 + len(p) <= size:
                held += "\n\n" + p
                continue
            want += [held] if held else []
            held = p if len(p) <= size else ""
            want += [] if held else [p[i : i + size].strip() for i in range(0, len(p), size - overlap)]
        want += [held] if held else []
        assert [c for _, c in chunking.paragraphs(chunking.CharTokenizer(), text, size, overlap)] == want


def test_sentences_against_a_plain_loop():
    import re

    for text, size, overlap in texts(300, 2):
        want, held = [], []
        for s in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", text))):
            if len(s) > size:
                want += [" ".join(held)] if held else []
                held = []
                want += [c for _, c in chunking.recursive(chunking.CharTokenizer(), s, size, overlap)]
                continue
            if held and sum(map(len, held)) + len(s) > size:
                want.append(" ".join(held))
                while sum(map(len, held)) > overlap:
                    held.pop(0)
            held.append(s)
        want += [" ".join(held)] if held else []
        assert [c for _, c in chunking.sentences(chunking.CharTokenizer(), text, size, overlap)] == want


def test_recursive_chunks_are_longest_spans():
    for text, size, _ in texts(300, 3):
        got = [c for _, c in chunking.recursive(chunking.CharTokenizer(), text, size, 0)]
        assert all(len(c) <= size for c in got)
        letters = lambda t: [c for c in t if c.isalpha()]
        assert letters("".join(got)) == letters(text)  # nothing is lost but cuts


def test_chunk_queries_are_the_strategies(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    import hashlib

    for name in ("recursive", "sentence", "paragraph", "semantic"):
        got = sorted(map(tuple, catalog.queries()[f"chunk_{name}"](spark, "/root/testdata/sf0.001").collect()))
        want = sorted((d, i, n, hashlib.md5(c.encode()).hexdigest()) for d, t in docs.items() for i, (n, c) in enumerate(chunking.STRATEGIES[name](chunking.CharTokenizer(), t or "", 400, 60)))
        assert got == want, name


def test_words_as_tokens():
    """A tokenizer whose tokens are words: budgets count words."""

    class Words:
        def encode(self, text):
            return text.split()

        def decode(self, tokens):
            return " ".join(tokens)

    text = "one two three. four five. six\n\nseven eight nine ten eleven"
    for f in chunking.STRATEGIES.values():
        assert all(n <= 4 and n == len(c.split()) for n, c in f(Words(), text, 4, 1))


def test_running_sums_without_a_group(spark):
    from docweave.operators import ranking

    rows = [(i * 7 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(5)
    got = ranking.running(df, F.col("v"), [F.desc("k")], "s").orderBy(F.desc("k")).collect()
    total = 0
    for r in got:
        total += r.v
        assert r.s == total
    assert [r.n for r in ranking.numbered(df, [F.col("k")], "n").orderBy("k").collect()] == list(range(1, 1001))
    assert ranking.numbered(df.where("false"), [F.col("k")], "n").count() == 0


def test_edit_create_and_lookups(spark, small):
    nodes, edges = small
    nodes = nodes.withColumn("description", F.lit("d"))
    more = graph.create_entities(nodes, spark.createDataFrame([("new", "x")], "entity_id string, description string"))
    assert more.count() == 8
    with pytest.raises(ValueError):
        graph.create_entities(nodes, nodes.limit(1))
    new = spark.createDataFrame([("g", "a", 3.0)], "src string, tgt string, weight double")
    assert {(r.src, r.tgt) for r in graph.create_relations(nodes, edges, new).collect()} >= {("a", "g")}
    for bad in ([("b", "a", 1.0)], [("a", "nowhere", 1.0)]):
        with pytest.raises(ValueError):
            graph.create_relations(nodes, edges, spark.createDataFrame(bad, "src string, tgt string, weight double"))
    changed = graph.edit(nodes, spark.createDataFrame([("a", "other")], "entity_id string, description string"), ["entity_id"])
    assert {r.entity_id: r.description for r in changed.collect()}["a"] == "other" and changed.count() == 7
    with pytest.raises(ValueError):
        graph.edit(nodes, spark.createDataFrame([("zz", "other")], "entity_id string, description string"), ["entity_id"])
    ids = spark.createDataFrame([("a",), ("zz",)], "entity_id string")
    assert {(r.entity_id, r.found) for r in graph.has_nodes(nodes, ids).collect()} == {("a", True), ("zz", False)}
    assert graph.get_edges(edges, spark.createDataFrame([("b", "a")], "src string, tgt string")).count() == 1
    assert {r.other for r in graph.node_edges(edges, ids).collect()} == {"b", "c"}
    v = spark.createDataFrame([("b", "a", [1.0])], "src string, tgt string, embedding array<double>")
    assert graph.relation_info(edges, v).where("embedding is not null").count() == 1


def test_merges_cut_before_values_meet(spark):
    rows = [("hub", "t", f"d{i % 3}", f"c{i:03d}", f"f{i % 150}", i % 7, f"{i:05d}") for i in range(400)]  # seq is a text, as ingest makes it
    df = spark.createDataFrame(rows, "entity_id string, entity_type string, description string, source_id string, file_path string, ts long, seq string")
    r = graph.merge_nodes(df, limit=5).first()
    assert r.source_ids == [f"c{i:03d}" for i in range(395, 400)] and len(r.file_paths) == 101 and r.file_paths[-1] == "...truncated...(FIFO)" and r.file_paths[0] == "f50"
    assert graph.merge_nodes(df, limit=5, method="KEEP").first().source_ids == [f"c{i:03d}" for i in range(5)]
    old = graph.merge_nodes(df.where("seq < '00200'"), limit=300)
    both = graph.merge_nodes(df.where("seq >= '00200'"), old, limit=300).first()
    assert both.source_ids == graph.merge_nodes(df, limit=300).first().source_ids and both.entity_type == "t"
    e = spark.createDataFrame([("b", "a", 2.0, "x, y", "d", "c1", "f", 0, 1)], "src string, tgt string, weight double, keywords string, description string, source_id string, file_path string, ts long, seq long")
    again = graph.merge_edges(e.withColumn("keywords", F.lit("z")).withColumn("source_id", F.lit("c2")), graph.merge_edges(e)).first()
    assert (again.src, again.weight, again.keywords, again.source_ids) == ("a", 4.0, "x,y,z", ["c1", "c2"])


def test_ranks_in_large_groups(spark):
    from docweave.operators import ranking

    rows = [("a" if i % 3 else None if i % 2 else "b", i * 7 % 600) for i in range(600)]
    got = ranking.numbered_in(spark.createDataFrame(rows, "s string, k int"), ["s"], [F.col("k")], "n").collect()
    for s in ("a", "b", None):
        assert [r.n for r in sorted((r for r in got if r.s == s), key=lambda r: r.k)] == list(range(1, sum(x == s for x, _ in rows) + 1))
