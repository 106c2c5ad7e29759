"""Blocks of parsed documents: text and its context, templates of images, tables and equations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.fixed_values import BELONGS_TO_KEYWORDS
from docweave.functions.text import content_id, strip

from .scratch import written


def separated(blocks: DataFrame, doc: str = "doc_id", position: str = "position") -> tuple[DataFrame, DataFrame]:
    """The documents' texts (non-blank text blocks joined by blank lines), and all other blocks."""
    text = blocks.where((F.col("type") == "text") & (strip(F.col("text")) != ""))
    joined = text.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    return joined, blocks.where(F.col("type") != "text")


def page_context(blocks: DataFrame, width: int = 1, doc: str = "doc_id", page: str = "page_idx", position: str = "position", text: str = "text") -> DataFrame:
    """Each block with the texts of the pages around its own, `width` either way, its own text left out."""
    over = Window.partitionBy(doc).orderBy(page).rangeBetween(-width, width)
    near = F.array_sort(F.collect_list(F.struct(page, position, F.col(text).alias("t"))).over(over))
    df = blocks.withColumn("__n", near)
    kept = F.filter("__n", lambda x: (x[position] != F.col(position)) & (x["t"] != ""))
    return df.withColumn("context", F.array_join(F.transform(kept, lambda x: x["t"]), "\n")).drop("__n")


def chunk_context(blocks: DataFrame, width: int = 1, doc: str = "doc_id", position: str = "position", text: str = "text") -> DataFrame:
    """Each block with the texts of the blocks around it, `width` either way."""
    over = Window.partitionBy(doc).orderBy(position)
    sides = [F.collect_list(text).over(over.rowsBetween(a, b)) for a, b in ((-width, -1), (1, width))]
    return blocks.withColumn("context", F.array_join(F.filter(F.concat(*sides), lambda x: x != ""), "\n"))


def cut_context(c: Column, most: int) -> Column:
    """A context of at most so many characters: up to a sentence's end if that is in its last fifth, else with dots."""
    head = F.substring(c, 1, most)
    end = F.length(F.regexp_extract(head, r"(?s)^.*[.!?。！？\n]", 0))
    return F.when(F.length(c) <= most, c).when(end > 0.8 * most, F.substring(head, F.lit(1), end)).otherwise(F.concat(head, F.lit("...")))


def listed(c: Column) -> Column:
    """Captions or footnotes on one line; none: `None`."""
    return F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0, F.lit("None")).otherwise(F.array_join(c, ", "))


# The titles and lines of the chunks that stand for blocks.
IMAGE_LINES = ("\nImage Content Analysis:\nImage Path: ", "\nCaptions: ", "\nFootnotes: ", "\n\nVisual Analysis: ")
TABLE_LINES = ("Table Analysis:\nImage Path: ", "\nCaption: ", "\nStructure: ", "\nFootnotes: ", "\n\nAnalysis: ")
EQUATION_LINES = ("Mathematical Equation Analysis:\nEquation: ", "\nFormat: ", "\n\nMathematical Analysis: ")
GENERIC_LINES = (" Content Analysis:\nContent: ", "\n\nAnalysis: ")


def described(kind: Column, path: Column, captions: Column, footnotes: Column, body: Column, text: Column, text_format: Column, description: Column) -> Column:
    """The chunk text that stands for a block."""
    def filled(lines: tuple[str, ...], *values: Column) -> Column:
        return F.concat(*(x for line, v in zip(lines, values, strict=True) for x in (F.lit(line), F.coalesce(v, F.lit("")))))

    image = filled(IMAGE_LINES, path, listed(captions), listed(footnotes), description)
    table = filled(TABLE_LINES, path, listed(captions), body, listed(footnotes), description)
    equation = filled(EQUATION_LINES, text, text_format, description)
    other = F.concat(F.initcap(kind), filled(GENERIC_LINES, text, description))
    return F.when(kind == "image", image).when(kind == "table", table).when(kind == "equation", equation).otherwise(other)


def described_by(models: dict[str, Callable[[str], str]], content: Column, kind: Column | None = None) -> Column:
    """What the model of a block's kind answers about its content; kinds without one have that of `generic`, if there is one."""
    kind = F.col("type") if kind is None else kind

    def asked(model: Callable[[str], str]):
        def run(s: pd.Series) -> pd.Series:
            return s.map(model, na_action="ignore")

        return F.pandas_udf(run, "string")

    out = F.lit(None).cast("string")
    if "generic" in models:
        out = asked(models["generic"])(F.when(~kind.isin(*(k for k in models if k != "generic")), content))
    return F.coalesce(*(asked(m)(F.when(kind == k, content)) for k, m in models.items() if k != "generic"), out)


def modal_chunks(blocks: DataFrame, describe: Column) -> DataFrame:
    """Blocks (file_path, position, type, ...) as chunks: content by template, ids, order from 0 in their file, and their entity.

    describe: struct<description, entity_name, entity_type, summary>, what a model of the block's kind says.
    """
    have = set(blocks.columns)
    text = lambda c: F.col(c).cast("string") if c in have else F.lit("")
    many = lambda c: F.col(c) if c in have else F.array().cast("array<string>")
    kind = F.col("type")
    captions, notes = F.when(kind == "table", many("table_caption")).otherwise(many("image_caption")), F.when(kind == "table", many("table_footnote")).otherwise(many("image_footnote"))
    df = blocks.withColumn("__d", describe)
    df = df.withColumn("content", strip(described(kind, text("img_path"), captions, notes, text("table_body"), text("text"), text("text_format"), F.col("__d.description"))))
    over = Window.partitionBy("file_path").orderBy("position")
    return df.select(
        "file_path", (F.row_number().over(over) - 1).alias("chunk_order_index"), F.length("content").alias("tokens"), "content", content_id("chunk-", F.col("content")).alias("chunk_id"), kind.alias("original_type"),
        (F.col("page_idx") if "page_idx" in have else F.lit(0)).alias("page_idx"), F.col("__d.entity_name").alias("entity_name"), F.col("__d.entity_type").alias("entity_type"), F.col("__d.summary").alias("summary"),
    )


def with_main_entities(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records (chunk_id, ..., record_order, fields) of modal chunks with their main entities, and each entity's relation to its chunk's."""
    keys = ["chunk_id", "full_doc_id", "file_path", "chunk_order_index"]
    main = chunks.where("entity_name <> ''").select(*keys, "entity_name", "entity_type", "summary")
    own = main.select(*keys, F.lit(-1).alias("record_order"), F.array(F.lit("entity"), "entity_name", "entity_type", F.coalesce("summary", "entity_name")).alias("fields"))
    found = records.where((F.size("fields") == 4) & F.contains(F.col("fields")[0], F.lit("entity"))).join(main.select("chunk_id", "full_doc_id", F.col("entity_name").alias("__m")), ["chunk_id", "full_doc_id"]).where(F.col("fields")[1] != F.col("__m"))
    says = F.concat(F.lit("Entity "), F.col("fields")[1], F.lit(" belongs to "), F.col("__m"))
    part = found.select(*keys, (F.col("record_order") + 1_000_000).alias("record_order"), F.array(F.lit("relation"), F.col("fields")[1], F.col("__m"), F.lit(BELONGS_TO_KEYWORDS), says).alias("fields"))
    return records.unionByName(own).unionByName(part)


def content_list(files: DataFrame) -> DataFrame:
    """Parsers' content lists (path, modificationTime, json) as blocks, a row a block in order, of the newest list of each document.

    Lists are named <document>_content_list.json; relative image paths are taken from their list's folder.
    """
    name = F.regexp_replace(F.substring_index("path", "/", -1), "_content_list\\.json$", "")
    newest = files.where(F.col("path").endswith("_content_list.json")).groupBy(name.alias("doc_id")).agg(F.max_by(F.struct("path", "json"), F.struct("modificationTime", "path")).alias("f")).select("doc_id", "f.*")
    schema = "array<struct<type:string,text:string,text_level:int,img_path:string,table_img_path:string,equation_img_path:string,image_caption:array<string>,image_footnote:array<string>,table_caption:array<string>,table_body:string,table_footnote:array<string>,text_format:string,page_idx:int>>"
    rows = newest.select("doc_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("__at"), F.posexplode(F.from_json("json", schema)).alias("position", "b")).select("doc_id", "__at", "position", "b.*")
    for c in ("img_path", "table_img_path", "equation_img_path"):
        rows = rows.withColumn(c, F.when((F.col(c) != "") & ~F.col(c).startswith("/"), F.concat("__at", F.lit("/"), c)).otherwise(F.col(c)))
    return rows.drop("__at")


def flattened_tree(documents: DataFrame) -> DataFrame:
    """Trees of blocks as parsers give them, flattened: (doc_id, kind, num, label, text, caption, parent_kind, parent_num, place) -> blocks in reading order.

    A level at a time: children are joined to the level above, and a block's place is the list of places above it.
    Groups and the body itself are no blocks; a page holds ten. Formulas are equations; pictures and tables keep captions.
    """
    node = documents.withColumn("__row", F.struct("kind", "num", "label", "text", "caption"))
    level = node.where("kind = 'body'").select("doc_id", "kind", "num", "__row", F.array().cast("array<int>").alias("path"))
    out = None
    while level.limit(1).count():
        level = written(level)
        out = level if out is None else out.unionByName(level)
        child = node.select("doc_id", F.col("kind").alias("k"), F.col("num").alias("n"), "place", F.col("parent_kind").alias("kind"), F.col("parent_num").alias("num"), F.col("__row").alias("r"))
        level = level.select("doc_id", "kind", "num", "path").join(child, ["doc_id", "kind", "num"]).select("doc_id", F.col("k").alias("kind"), F.col("n").alias("num"), F.col("r").alias("__row"), F.concat("path", F.array("place")).alias("path"))
    if out is None:
        return documents.select("doc_id", F.lit(0).alias("position"), F.lit("text").alias("type"), "text", "caption", F.lit(0).alias("page_idx")).where("false")
    kind = F.when(F.col("__row.kind") == "pictures", "image").when((F.col("__row.kind") == "texts") & (F.col("__row.label") == "formula"), "equation").when(F.col("__row.kind") == "texts", "text").otherwise("table")
    blocks = out.where("kind not in ('groups', 'body')").select("doc_id", "path", kind.alias("type"), F.col("__row.text").alias("text"), F.col("__row.caption").alias("caption"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return blocks.withColumn("position", place).withColumn("page_idx", F.floor((F.col("position") + 1) / 10).cast("int")).drop("path")
