"""What goes into models and comes out of them: messages, markers of images, answers in JSON, reference lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .fixed_values import (
    ANSWER_SUFFIXES,
    CONTEXT_MARKER,
    EMPTY_INSTRUCTIONS,
    IMAGE_EXTENSIONS,
    INSTRUCTIONS_LINE,
    QUERY_LINE,
    REFERENCE_MARKER,
    SHORT_SUMMARY,
    STALE_LINES,
    UNNAMED_ENTITY,
    UNTYPED_ENTITY,
)
from .text import let, sanitize, strip

IMAGE_PATH = rf"Image Path:\s*([^\r\n]*?\.(?:{'|'.join(IMAGE_EXTENSIONS)}))"


# Messages


def without_empty_instructions(c: Column) -> Column:
    """Without lines that announce additional instructions and give none."""
    said = lambda line: F.lower(strip(F.regexp_replace(line, INSTRUCTIONS_LINE, "")))
    return strip(F.array_join(F.filter(F.split(c, r"\r?\n"), lambda x: ~(x.rlike(INSTRUCTIONS_LINE) & said(x).isin(*EMPTY_INSTRUCTIONS))), "\n"))


def cleaned_context(c: Column) -> Column:
    """A context without the request and the closing lines that an earlier packing left in it."""
    kept = F.get(F.split(c, QUERY_LINE, 2), F.lit(0))
    return strip(F.regexp_replace(strip(kept), "|".join(f"(?:{line})" for line in STALE_LINES), ""))


def repacked(system: Column, prompt: Column, upstream: Column | None = None, images: Column | None = None) -> Column:
    """struct<system, user> of a system prompt that holds the context: instructions apart from context and question.

    Null if there is no context with instructions before it, or nothing is left of it.
    """
    raw = strip(F.coalesce(system, F.lit("")))
    context = F.substring_index(raw, CONTEXT_MARKER, -1)
    role = strip(F.substring(raw, F.lit(1), F.length(raw) - F.length(context) - len(CONTEXT_MARKER)))
    rules = without_empty_instructions(role)
    first = strip(F.coalesce(upstream, F.lit(""))) if upstream is not None else F.lit("")
    whole = F.when((first != "") & (rules != ""), F.concat(first, F.lit("\n\n"), rules)).when(rules != "", rules).otherwise(first)
    text = cleaned_context(F.concat(F.lit(CONTEXT_MARKER), context))
    question = strip(F.coalesce(prompt, F.lit("")))
    suffix = F.when(F.coalesce(images, F.lit(False)) if images is not None else F.lit(False), ANSWER_SUFFIXES[1]).otherwise(ANSWER_SUFFIXES[0])
    user = F.when(question != "", F.concat(text, F.lit("\n\nUser Question: "), question, F.lit("\n\n"), suffix)).otherwise(text)
    fine = F.contains(raw, F.lit(CONTEXT_MARKER)) & (role != "") & (text != "")
    return F.when(fine, F.struct(whole.alias("system"), user.alias("user")))


def enriched_query(query: Column, kinds: Column, descriptions: Column, suffix: str = "") -> Column:
    """A request with what is known of the content that comes with it, a paragraph an item."""
    items = F.zip_with(kinds, descriptions, lambda k, d: F.concat(F.lit("\nRelated "), k, F.lit(" content: "), F.coalesce(d, F.lit(""))))
    return F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("User query: "), query)), items), "\n"), F.lit(suffix))


# Images


def marked_images(c: Column, readable: Column, most: int | None = None) -> Column:
    """struct<text, images>: image paths that are readable (a list of them) followed by [VLM_IMAGE_n] in order, `most` of them at most; and these paths."""
    cut = lambda t: F.split(t, rf"(?={IMAGE_PATH})")
    path = lambda p: F.regexp_extract(p, rf"^{IMAGE_PATH}", 1)

    def step(s: Column, p: Column) -> Column:
        found = strip(path(p))
        take = (found != "") & F.array_contains(readable, found)
        take = take if most is None else take & (F.size(s["images"]) < most)
        head = F.concat(F.lit("Image Path: "), found, F.lit("\n[VLM_IMAGE_"), (F.size(s["images"]) + 1).cast("string"), F.lit("]"))
        rest = F.substring(p, F.length(F.regexp_extract(p, rf"^{IMAGE_PATH}", 0)) + 1, F.length(p))
        return F.struct(F.concat(s["text"], F.when(take, F.concat(head, rest)).otherwise(p)).alias("text"), F.when(take, F.concat(s["images"], F.array(found))).otherwise(s["images"]).alias("images"))

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("images"))
    return F.aggregate(cut(F.coalesce(c, F.lit(""))), start, step)


def interleaved(c: Column, images: Column) -> Column:
    """array<struct<type, text, image>>: a text cut at its [VLM_IMAGE_n] marks, images (their list) in between; marks without an image stay text."""
    parts = F.split(c, r"(?=\[VLM_IMAGE_\d+\])|(?<=\[VLM_IMAGE_\d{1,6}\])")
    number = lambda p: F.regexp_extract(p, r"^\[VLM_IMAGE_(\d+)\]$", 1)

    def one(p: Column) -> Column:
        k = F.when(number(p) != "", F.try_element_at(images, F.greatest(number(p).try_cast("int"), F.lit(1))))
        return F.struct(F.when(k.isNotNull(), "image_url").otherwise("text").alias("type"), F.when(k.isNull(), p).alias("text"), k.alias("image"))

    return F.transform(F.filter(parts, lambda p: p != ""), one)


def image_tokens(t: Column, h: Column, w: Column, merge: int = 2, wrapper: int = 2) -> Column:
    """Tokens of an image whose grid is t * h * w patches; null for an unreadable one."""
    n = F.floor(t * h * w / (merge * merge))
    return F.when(n > 0, n + wrapper)


def valid_images(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """Files (path, length) that are images by their extension and not too large."""
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*IMAGE_EXTENSIONS) & (F.col("length") <= most_bytes))


def document_text(spans: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """(key, text, images): spans (key, position, type, text) of documents as one text each, [imageN] where an image is, `most` characters at most.

    images: the paths of the images that the text names, in order; the text of an image span is its path. What lies
    behind the limit is cut before a document's spans meet.
    """
    over = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    image = F.coalesce(F.col("type") == "image", F.lit(False))
    said = F.when(image, F.concat(F.lit("[image"), F.sum(image.cast("int")).over(over).cast("string"), F.lit("]"))).otherwise(F.coalesce("text", F.lit("")))
    rows = spans.select(key, "position", F.when(image, F.col("text")).alias("__path"), said.alias("__said"))
    rows = rows.withColumn("__before", F.sum(F.length("__said") + 1).over(over) - F.length("__said") - 1).where(F.col("__before") <= most)  # at the limit a span still gives the line feed before it
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "__said", F.when(F.col("__before") + F.length("__said") <= most, F.col("__path")).alias("path")))).alias("x"))
    return lists.select(key, F.substring(F.array_join(F.transform("x", lambda x: x["__said"]), "\n"), 1, most).alias("text"), F.filter(F.transform("x", lambda x: x["path"]), lambda p: p.isNotNull()).alias("images"))


# Answers


def sanitized_modal(c: Column) -> Column:
    """A description fit for storing, where a JSON parser has read \\beta and \\frac as control characters."""
    return sanitize(F.regexp_replace(F.regexp_replace(c, "\x08", r"\\b"), "\x0c", r"\\f"))


JSON = json.JSONDecoder(strict=False)
#: What is mended in an object that is no JSON: a string's backslashes that start no escape, curly quotes outside of strings, commas before an end.
MENDED = re.compile(r"""(?P<string>"(?:[^"\\]|\\.)*")|(?P<quote>[“”])|(?P<tick>[‘’])|,(?=\s*[}\]])""", re.DOTALL)
ESCAPE = re.compile(r"""\\(["\\/bfnrt]|u[0-9a-fA-F]{4})?""")


def mended(text: str) -> str:
    """A text that starts with a brace, mended where JSON has a rule that models break."""

    def one(m: re.Match) -> str:
        if m["string"]:
            return ESCAPE.sub(lambda e: e[0] if e[1] else r"\\", m[0])
        return '"' if m["quote"] else "'" if m["tick"] else ""

    return MENDED.sub(one, text)


def json_objects(text: str) -> Iterator[dict]:
    """The objects of a text, decoded from their opening braces on: those behind a fence, then all in order.

    Thoughts are no part of it. A brace that opens no object as it stands opens the mended one, if that is one; what lies
    inside an object, or behind a mended one, is not looked at again.
    """
    plain = re.sub(r"(?is)<(think|thinking)>.*?</\1>", "", text)
    fenced = [m.end() - 1 for m in re.finditer(r"```(?:json)?\s*\{", plain)]
    for starts in (fenced, [m.start() for m in re.finditer(r"\{", plain)]):
        end = 0
        for start in starts:
            for read in (str, mended) if start >= end else ():
                try:
                    found, length = JSON.raw_decode(read(plain[start:]))
                except (ValueError, RecursionError):
                    continue
                end = start + length if read is str else len(plain)
                yield found
                break


FIELDS = ("detailed_description", "entity_name", "entity_type", "summary")


def modal_answer(text: str) -> dict[str, str]:
    """description, entity_name, entity_type and summary of a model's answer: its first object that is not empty, else what it names."""
    found = next((x for x in json_objects(text) if x), None)
    if found is not None:
        entity = found.get("entity_info")
        flat = found | (entity if isinstance(entity, dict) else {}) | {FIELDS[0]: found.get(FIELDS[0], "")}
        return {k: str(flat.get(k, "")) for k in FIELDS}
    pairs = re.findall(rf"""(?s)"({'|'.join(FIELDS)})":\s*"((?:[^"\\]|\\.)*)\"""", text)
    named = dict.fromkeys(FIELDS, "") | dict(reversed(pairs))
    for field, value in zip(FIELDS[1:], (UNNAMED_ENTITY, UNTYPED_ENTITY, named[FIELDS[0]][:SHORT_SUMMARY]), strict=True):
        named[field] = named[field] or value
    return named


@F.pandas_udf(StructType([StructField(f, StringType()) for f in FIELDS]))
def parsed_modal_answer(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([modal_answer(t or "") for t in s], columns=list(FIELDS))


def described_block(c: Column) -> Column:
    """struct<description, entity_name, entity_type, summary> of a model's answer about a block."""
    x = parsed_modal_answer(c)
    return F.struct(sanitized_modal(x["detailed_description"]).alias("description"), sanitize(x["entity_name"]).alias("entity_name"), x["entity_type"].alias("entity_type"), sanitized_modal(x["summary"]).alias("summary"))


@F.pandas_udf(StringType())
def repaired_json(s: pd.Series) -> pd.Series:
    """The first object of a text as JSON, mended if it has to be; null without one."""
    first = lambda text: next(json_objects(text or ""), None)
    return s.map(lambda text: None if (x := first(text)) is None else json.dumps(x, ensure_ascii=False))


def reference_lines(c: Column) -> Column:
    """array<string>: the lines of the fenced block behind the last mark of a reference list."""
    behind = F.when(F.contains(c, F.lit(REFERENCE_MARKER)), F.substring_index(c, REFERENCE_MARKER, -1)).otherwise(F.lit(""))
    block = F.regexp_extract(behind, r"(?s)```(?:[a-zA-Z0-9_+-]+)?\s*\n(.*?)\n```", 1)
    return F.filter(F.transform(F.split(block, r"\r?\n"), strip), lambda x: x != "")


def numbered_answers(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, number, answer): lines (key, line, text) of numbered answers; a line that starts with the next number opens an answer, others go on with it.

    A fold over the lines of a file: which number is next depends on all before.
    """
    start = F.struct(F.lit(1).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x.startswith(F.concat((s["n"] + 1).cast("string"), F.lit("."))), s["n"] + 1).otherwise(s["n"])
        return F.struct(n.alias("n"), F.concat(s["of"], F.array(n)).alias("of"))

    texts = lines.select(*key, "line", strip(F.col("text")).alias("text")).where("text <> ''").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("t"))
    rows = texts.select(*key, F.posexplode(F.arrays_zip("t", F.aggregate("t", start, step, lambda s: s["of"]).alias("of"))).alias("i", "x")).select(*key, "i", "x.t", "x.of")
    # A line that names the number that is open starts its answer anew.
    again = F.max(F.when(F.col("t").startswith(F.concat(F.col("of").cast("string"), F.lit("."))), F.col("i")))
    begin = rows.groupBy(*key, "of").agg(again.alias("begin"))
    kept = rows.join(begin, [*key, "of"]).where(F.col("i") >= F.coalesce("begin", F.lit(0)))
    return kept.groupBy(*key, F.col("of").alias("number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("answer"))


# Names of files


def safe_name(c: Column, most: int = 200) -> Column:
    """A name that is one file's: no folders, no leading dots, word characters, dots and dashes only."""
    last = F.substring_index(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), "/", -1)
    return let(F.regexp_replace(F.regexp_replace(last, r"(?U)[^\w.\-]+", "_"), r"^\.+", ""), lambda x: F.when(F.translate(x, "_", "") == "", F.lit("unnamed")).otherwise(F.substring(x, 1, most)))


def inside(path: Column, folder: str) -> Column:
    """Whether a path, its `..` resolved, lies below a folder."""
    root = folder.rstrip("/")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path))

    def step(s: Column, x: Column) -> Column:
        return F.when(x.isin("", "."), s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))

    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/")).startswith(root + "/")


def quoted_identifier(name: str) -> str:
    """A name for SQL, back ticks doubled."""
    return "`" + name.replace("`", "``") + "`"
