"""Cleaning, identities and small string functions, as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed_values import DELIMITER_REPAIRS, FIELD_SEPARATOR, IMAGE_EXTENSIONS, SUMMARY_CHARS, TUPLE_DELIMITER

#: What a strip takes off, as a character class of Java.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
CJK = r"[\u4e00-\u9fa5]"
#: Full-width forms and their half-width ones.
WIDE = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)]) + "－＋／＊（）—　"
NARROW = "".join(chr(c - 0xFEE0) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0xFF10, 0xFF1A)]) + "-+/*()- "


#: The same characters as a string.
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def sanitize(c: Column, entities: bool = True) -> Column:
    """Text fit for storing: stripped, no control or non-characters, HTML entities resolved.

    Entities are resolved in Python, and only if the text has an ampersand; entities=False stays in the JVM.
    """
    c = F.regexp_replace(strip(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFE\uFFFF]", "")
    if entities:
        c = F.coalesce(unescape_html(F.when(c.contains("&"), c)), c)
    return strip(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""))


def let(value: Column, body) -> Column:
    """body(x) with value computed once, however often it asks for x; plans stay as long as they are written."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unquoted(c: Column, first: str, last: str) -> Column:
    """Without one pair of outer quotes, if there are none inside."""
    return F.regexp_replace(c, f"^{first}([^{first}{last}]*){last}$", "$1")


def normalize_name(c: Column, inner_quotes: bool = False) -> Column:
    """The surface of an extracted name or description: tags, widths, spaces beside CJK, quotes; bare short numbers go."""
    c = F.regexp_replace(c, r"(?i)</p\s*>|<p\s*>|<p/>|</br\s*>|<br\s*>|<br/>", "")
    c = F.translate(c, WIDE, NARROW)
    latin = r"[a-zA-Z0-9()\[\]@#$%!&*\-=+_]"
    for before, after in ((CJK, CJK), (CJK, latin), (latin, CJK)):
        c = F.regexp_replace(c, f"(?<={before}){SPACE}+(?={after})", "")
    for first, last in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")):
        c = unquoted(c, first, last)
    if inner_quotes:
        c = F.regexp_replace(c, "[“”‘’]", "")
        c = F.regexp_replace(c, f"['\"]+(?={CJK})|(?<={CJK})['\"]+", "")
        c = F.regexp_replace(F.translate(c, "\u00a0", " "), "(?<=[^0-9])\u202f", " ")
    # Short bare numbers are no names.
    return F.regexp_replace(strip(c), r"^(?:[0-9]{1,2}|(?=[0-9.]{1,5}$)[0-9.]*\.[0-9.]*)$", "")


def split_markers(c: Column, markers: list[str]) -> Column:
    """The stripped, non-blank parts between any of the literal markers."""
    quoted = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.filter(F.transform(F.split(c, quoted), strip), lambda x: x != "")


def repair_delimiters(c: Column) -> Column:
    """Broken tuple delimiters made whole, by the fixed list of repairs in order."""
    for pattern in DELIMITER_REPAIRS:
        c = F.regexp_replace(c, pattern, TUPLE_DELIMITER)
    return c


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)^(<think>.*?</think>|.*</think>)", ""))


def summary(c: Column, most: int = SUMMARY_CHARS) -> Column:
    return let(strip(c), lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(t))


def is_float(c: Column) -> Column:
    return c.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def json_string(c: Column) -> Column:
    """A string as JSON writes it, non-ASCII as it is; null stays null."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def json_line(**fields: Column) -> Column:
    """A line of JSON with a space behind commas and colons; numbers as they are, nulls as null."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(c, F.lit("null"))) for name, c in ((n, json_string(c)) for n, c in fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.encode(F.concat(*parts), "UTF-8")))


def pair_id(a: Column, b: Column) -> Column:
    """A relation's vector id, the same for both directions."""
    return content_id("rel-", F.least(a, b), F.greatest(a, b))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(FIELD_SEPARATOR, F.least(a, b), F.greatest(a, b))


def cache_key(mode: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws(":", mode, kind, digest)


def parse_cache_key(c: Column) -> Column:
    """mode, cache_type and digest; null unless there are three parts."""
    p = F.split(c, ":", 3)
    return F.when(F.size(p) == 3, F.struct(p[0].alias("mode"), p[1].alias("cache_type"), p[2].alias("digest")))


def lexical_key(c: Column) -> Column:
    """Names that differ in case, dashes, underscores or spaces have one key."""
    return strip(F.regexp_replace(F.lower(strip(c)), f"(?:[_-]|{SPACE})+", " "))


def image_paths(c: Column) -> Column:
    """Distinct image paths of a chunk's `Image Path:` lines, in order."""
    found = F.regexp_extract_all(c, F.lit(rf"(?i)Image Path:\s*([^\r\n]*?\.(?:{'|'.join(IMAGE_EXTENSIONS)}))"), F.lit(1))
    return F.array_distinct(F.transform(found, strip))


def history_tokens(role: Column, content: Column) -> Column:
    """A message's cost with a tokenizer of one token a character: role, content and four more."""
    return F.length(role) + F.length(content) + 4


def task_type(system_prompt: Column, prompt: Column, has_messages: Column | None = None, has_image: Column | None = None) -> Column:
    """What a model call is for: an ingest prompt names the JSON it wants, and then the first of the kinds it speaks of."""
    none = F.lit(False)
    low = F.lower(F.concat(F.coalesce(system_prompt, F.lit("")), F.lit("\n"), F.coalesce(prompt, F.lit(""))))
    structured = low.contains("provide a json response with the following structure") | low.contains("response must be a valid json object") | low.contains("entity_info")
    kind = F.when(low.contains("table"), "table").when(low.contains("equation") | low.contains("latex"), "equation").when(low.contains("image"), "image").otherwise("generic")
    return F.when(none if has_messages is None else has_messages, "query").when(none if has_image is None else has_image, "image").when(~structured, "query").otherwise(kind)


def answer_score(c: Column) -> Column:
    """A judge's 0 or 1: accuracy in a JSON answer, then `accuracy: n`, then the first 0 or 1 that stands alone in 120 characters; else 0."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    from_json = F.regexp_extract(F.get_json_object(F.when(F.trim(body).startswith("{"), body), "$.accuracy"), r"^([01])$", 1)
    named = F.regexp_extract(c, r"(?i)accuracy[\"']?\s*[:=]\s*[\"']?([01])\b", 1)
    alone = F.regexp_extract(F.substring(c, 1, 120), r"(?<![0-9.])([01])(?![0-9.])", 1)
    first = F.coalesce(*(F.when(x != "", x) for x in (from_json, named, alone)))
    return F.coalesce(first.cast("int"), F.lit(0))
