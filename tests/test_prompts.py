"""Messages, images and answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docweave.functions import prompts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_repacked(spark):
    system = "Role.\n---Context---\nexample\n1. Additional Instructions: none\nRules\nAdditional Instructions: be brief\n---Context---\nfacts\nUser Question: old\nPlease answer based on the provided context.\n---User Query---\nold query"
    got = one(spark, system, lambda c: prompts.repacked(c, F.lit(" why? "), F.lit("You are."), F.lit(True)))
    assert got.system == "You are.\n\nRole.\n---Context---\nexample\nRules\nAdditional Instructions: be brief"
    assert got.user == "---Context---\nfacts\n\nUser Question: why?\n\nPlease answer based on the context and images provided."
    assert one(spark, "no marks", lambda c: prompts.repacked(c, F.lit("q"))) is None
    assert one(spark, "---Context---\nfacts", lambda c: prompts.repacked(c, F.lit("q"))) is None
    assert one(spark, "Role\n---Context---\nfacts", lambda c: prompts.repacked(c, F.lit(""))).user == "---Context---\nfacts"


def test_images(spark):
    text = "a\nImage Path: x/1.png\nb Image Path: bad.png c\nImage Path: y 2.JPG\nImage Path: z.png end"
    got = one(spark, text, lambda c: prompts.marked_images(c, F.array(F.lit("x/1.png"), F.lit("z.png"), F.lit("y 2.jpg"))))
    assert got.text == "a\nImage Path: x/1.png\n[VLM_IMAGE_1]\nb Image Path: bad.png c\nImage Path: y 2.JPG\nImage Path: z.png\n[VLM_IMAGE_2] end" and got.images == ["x/1.png", "z.png"]
    assert one(spark, text, lambda c: prompts.marked_images(c, F.array(F.lit("x/1.png"), F.lit("z.png")), 1)).images == ["x/1.png"]
    parts = one(spark, "p [VLM_IMAGE_2][VLM_IMAGE_1] q [VLM_IMAGE_9]", lambda c: prompts.interleaved(c, F.array(F.lit("one"), F.lit("two"))))
    assert [(p.type, p.text, p.image) for p in parts] == [("text", "p ", None), ("image_url", None, "two"), ("image_url", None, "one"), ("text", " q ", None), ("text", "[VLM_IMAGE_9]", None)]
    df = spark.createDataFrame([(1, 10, 12), (1, 1, 1)], "t int, h int, w int").select(prompts.image_tokens(F.col("t"), F.col("h"), F.col("w")).alias("n"))
    assert [r.n for r in df.collect()] == [32, None]
    files = spark.createDataFrame([("a.PNG", 10), ("b.txt", 10), ("c.jpg", 60 << 20)], "path string, length long")
    assert [r.path for r in prompts.valid_images(files).collect()] == ["a.PNG"]


GOOD = {"detailed_description": "d", "entity_info": {"entity_name": "n", "entity_type": "t", "summary": "s"}}


@pytest.mark.parametrize(
    "text",
    [
        json.dumps(GOOD), f"<think>{{no}}</think> here: ```json\n{json.dumps(GOOD)}\n``` bye", "x " + json.dumps(GOOD) + " {", json.dumps(GOOD).replace('"t"', '"t",').replace('"}', '",}').replace(',",', '",'),
        json.dumps(GOOD).replace('"', "“", 1).replace('":', "”:", 1), '"detailed_description": "d", "entity_name": "n", "entity_type": "t", "summary": "s"',
    ],
)
def test_answers_in_bad_json(spark, text):
    assert prompts.modal_answer(text) == {"detailed_description": "d", "entity_name": "n", "entity_type": "t", "summary": "s"}


def test_answers_with_latex_and_without_anything(spark):
    got = prompts.modal_answer(r'{"detailed_description": "\alpha and \sum x", "entity_info": {"entity_name": "n"}}')
    assert got["detailed_description"] == r"\alpha and \sum x" and got["entity_name"] == "n"
    assert prompts.modal_answer("nothing")["entity_name"] == "unknown_entity"
    got = one(spark, '{"detailed_description": "\\beta &amp; \\frac", "entity_info": {"entity_name": "n"}}', prompts.described_block)
    assert got.description == r"\beta & \frac" and got.entity_name == "n"
    assert one(spark, 'so {"a": [1, 2,],} done', prompts.repaired_json) == '{"a": [1, 2]}' and one(spark, "none", prompts.repaired_json) is None


def test_objects_in_answers():
    found = lambda text: list(prompts.json_objects(text))
    assert found('{"a": "} {", "b": 1} and {"c": {"d": 2}}') == [{"a": "} {", "b": 1}, {"c": {"d": 2}}]
    assert found('see {this} first: {"a": {"b": 1,},} {"c": 2}') == [{"a": {"b": 1}}]
    assert found('{"a": 1} ```json\n{"b": 2}\n``` ')[0] == {"b": 2}
    assert found(r'{"a": "\usepackage \n x \\"}') == [{"a": "\\usepackage \n x \\"}]
    assert found("{" * 2000) == [] and found('{"a":' * 5000) == [] and found("[1, 2]") == []
    assert prompts.modal_answer('{} {"detailed_description": 7, "entity_name": "n"}') == {"detailed_description": "7", "entity_name": "n", "entity_type": "", "summary": ""}
    got = prompts.modal_answer('"detailed_description": "' + "x" * 200 + '", "entity_name": "n", "entity_name": "m"')
    assert got == {"detailed_description": "x" * 200, "entity_name": "n", "entity_type": "unknown", "summary": "x" * 100}


def test_reference_lines(spark):
    from docweave.functions.fixed_values import REFERENCE_MARKER

    text = f"{REFERENCE_MARKER}\n```\n[1] old\n```\n{REFERENCE_MARKER}\n\n```text\n[1] a.txt\n\n [2] b.txt\n```\n"
    assert one(spark, text, prompts.reference_lines) == ["[1] a.txt", "[2] b.txt"] and one(spark, "x", prompts.reference_lines) == []


def plain_answers(lines):
    out, n, held = [], 1, ""
    for x in filter(None, map(str.strip, lines)):
        if x.startswith(f"{n}."):
            held = x
        elif x.startswith(f"{n + 1}."):
            out.append(held)
            held, n = x, n + 1
        else:
            held += x
    return [*out, held]


def test_numbered_answers(spark):
    files = {"a": ["1. yes", "more", "", "2. no", "3. 5. x", "4. z"], "b": ["intro", "1. a", "1. again", "go on", "3. not yet", "2. b"], "c": ["only"]}
    df = spark.createDataFrame([(k, i, x) for k, v in files.items() for i, x in enumerate(v)], "f string, line int, text string")
    got = prompts.numbered_answers(df, ["f"]).collect()
    for k, v in files.items():
        assert [r.answer for r in sorted(got, key=lambda r: r.number) if r.f == k] == plain_answers(v)


def test_names_of_files(spark):
    for name, want in (("../../etc/pass wd", "pass_wd"), ("..hidden", "hidden"), ("a/b\\c d.txt", "c_d.txt"), ("", "unnamed"), ("naïve-1.md", "naïve-1.md")):
        assert one(spark, name, prompts.safe_name) == want
    for path, want in (("x/y", True), ("../z", False), ("/data/in/a", True), ("/data/in/../b", False), ("/data/inner", False)):
        assert one(spark, path, lambda c: prompts.inside(c, "/data/in")) == want
    assert prompts.quoted_identifier("a`b") == "`a``b`"


def test_enriched_query(spark):
    df = spark.createDataFrame([("q", ["image", "table"], ["a cat", None])], "q string, k array<string>, d array<string>")
    assert df.select(prompts.enriched_query(F.col("q"), F.col("k"), F.col("d"), "!")).first()[0] == "User query: q\n\nRelated image content: a cat\n\nRelated table content: !"
