"""Files, vectors and questions from folders; indexes; blocks by kind."""

from __future__ import annotations

import base64
import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import chunking, evaluation, graph, multimodal, vector
from docweave.sources import files, knowledge


def test_files_that_are_processed_are_left_out(spark, tmp_path):
    for n in ("a.txt", "b.md", "c.exe"):
        (tmp_path / n).write_text("x")
    found = files.find_files(spark, str(tmp_path))
    known = found.withColumn("status", F.when(F.col("path").endswith("a.txt"), "processed").otherwise("failed"))
    assert [r.path[-4:] for r in files.find_files(spark, str(tmp_path), known).collect()] == ["b.md"]


def test_sheets_by_their_relations(tmp_path):
    data = io.BytesIO()
    cell = lambda v: f'<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="First" r:id="r2"/><sheet name="Second" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", cell("one"))
        z.writestr("xl/worksheets/sheet2.xml", cell("two"))
    text = files.xlsx_text(data.getvalue())
    assert text.index("First") < text.index("two") < text.index("Second") < text.index("one")


def test_parsers_of_blocks(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"abc")
    (tmp_path / "e.bin").write_bytes(b"bad")

    def parser(path, data):
        if data == b"bad":
            raise ValueError("no")
        return [{"type": "text", "text": data.decode()}]

    parsed = files.parse_files(spark, str(tmp_path), parser)
    assert parsed.where("error is not null").count() == 1
    assert [(r.doc_id, r.text) for r in multimodal.content_list(parsed.where("error is null")).collect()] == [("d.bin", "abc")]


def test_vector_files(spark, tmp_path):
    m = np.array([[1, 2], [3, 4]], "<f4")
    (tmp_path / "v.json").write_text(json.dumps({"embedding_dim": 2, "data": [{"__id__": "a", "content": "x"}, {"__id__": "b"}], "matrix": base64.b64encode(m.tobytes()).decode()}))
    got = {r.vec_id: (r.embedding, r.row.get("content")) for r in knowledge.read_vector_json(spark, str(tmp_path / "v.json")).collect()}
    assert got == {"a": ([1.0, 2.0], "x"), "b": ([3.0, 4.0], None)}


def test_questions_and_scores(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a?", "answer": "b", "type": "text-only"}\n\n{"question": "c?", "answer": "d"}\n')
    q = evaluation.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert [(r.line, r.question, r.answer, r.type) for r in q.orderBy("line").collect()] == [(1, "a?", "b", "text-only"), (2, "c?", "d", None)]
    answers = q.select("path", (F.col("line") * 10).alias("line"), F.lit("said").alias("said"))
    assert [r.said for r in evaluation.by_line(q.withColumnRenamed("line", "at"), answers.withColumnRenamed("line", "at"), ["path"], "at").collect()] == ["said", "said"]
    df = spark.createDataFrame([("x", 0.5, ["u"]), ("y", float("nan"), [])], "id string, score double, contexts array<string>")
    for kind in ("csv", "json"):
        evaluation.export_scores(df, f"{tmp_path}/out-{kind}", kind)
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/out-csv", header=True, escape='"').collect()} == {("x", "0.5", '["u"]'), ("y", None, "[]")}


def test_inverted_lists_find_nine_of_ten(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centres[i % 30]]) for i in range(3000)] + [(9000, [0.0] * 12), (9001, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 100 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    listed, found = vector.inverted_lists(v, 24, sample=1000)
    assert listed.count() == 3000
    key = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact, near = key(vector.search_many(v, q, 10)), key(vector.search_lists(listed, found, q, 10, 4))
    assert len(exact & near) >= 0.9 * len(exact)


def test_blocks_by_kind(spark):
    df = spark.createDataFrame([("image", "a"), ("table", "b"), ("odd", "c"), ("image", None)], "type string, text string")
    models = {"image": lambda t: f"I{t}", "table": lambda t: f"T{t}", "generic": lambda t: f"G{t}"}
    assert [r[0] for r in df.select(multimodal.described_by(models, F.col("text"))).collect()] == ["Ia", "Tb", "Gc", None]


def test_label_subgraph(spark):
    nodes = spark.createDataFrame([("Alpha",), ("Alphabet",), ("Beta",)], "entity_id string")
    edges = spark.createDataFrame([("Alpha", "Beta", 1.0)], "src string, tgt string, weight double")
    names = lambda got: {r.entity_id for r in got[0].collect()}
    assert names(graph.label_subgraph(nodes, edges, "alpha")) == {"Alpha", "Beta"}
    assert names(graph.label_subgraph(nodes, edges, "*", most=2)) == {"Alpha", "Beta"} and names(graph.label_subgraph(nodes, edges, "zzz")) == {"Alpha", "Alphabet", "Beta"}


def test_a_public_tokenizer(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tok = chunking.FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "One sentence is here. Another one follows it!\n\nA new paragraph, with more words in it than before. " * 8
    df = spark.createDataFrame([(text,)], "text string")
    for name in chunking.STRATEGIES:
        got = df.select(F.explode(chunking.chunk_udf(name, 24, 4, tok)(F.col("text"))).alias("c")).select("c.*").collect()
        assert len(got) > 3 and all(r.tokens <= 26 and abs(len(tok.encode(r.content)) - r.tokens) <= 2 for r in got), name
