"""Documents from folders: found by extension, read as text by an extractor of their kind."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.ranking import numbered_in

# Files that are read as UTF-8 text.
TEXT_EXTENSIONS = (
    "txt", "md", "mdx", "html", "htm", "tex", "json", "xml", "yaml", "yml", "rtf", "odt", "epub", "csv", "log", "conf",
    "ini", "properties", "sql", "bat", "sh", "c", "h", "cpp", "hpp", "py", "java", "js", "ts", "swift", "go", "rb",
    "php", "css", "scss", "less",
)
OFFICE_EXTENSIONS = ("pdf", "docx", "pptx", "xlsx")


def local_name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def part_xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:  # no entity may blow a part up
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(data)


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in the order of the body; cells by tabs, blank lines around tables."""
    body = next(e for e in part_xml(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml") if local_name(e) == "body")

    def words(e: ElementTree.Element) -> str:
        return "".join((x.text or "") if local_name(x) == "t" else {"tab": "\t", "br": "\n"}.get(local_name(x), "") for x in e.iter())

    def cell(e: ElementTree.Element) -> str:
        text = "\n".join(words(p) for p in e.iter() if local_name(p) == "p")
        return text.replace("\\", "\\\\").replace("\t", "&emsp;&emsp;").replace("\r\n", "<br>").replace("\r", "<br>").replace("\n", "<br>")

    lines, in_table = [], False
    for e in body:
        if local_name(e) == "tbl":
            if not in_table:
                lines.append("")
            lines += ["\t".join(cell(c) for c in row if local_name(c) == "tc") for row in e if local_name(row) == "tr"]
            in_table = True
        elif local_name(e) == "p":
            if in_table:
                lines.append("")
                in_table = False
            lines.append(words(e))
    return "\n".join(lines)


def pptx_text(data: bytes) -> str:
    """The text of each shape of each slide, a line each."""
    z, out = zipfile.ZipFile(io.BytesIO(data)), []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    for name in slides:
        for shape in (e for e in part_xml(z, name).iter() if local_name(e) == "sp"):
            if any(local_name(e) == "txBody" for e in shape):
                out.append("\n".join("".join(t.text or "" for t in p.iter() if local_name(t) == "t") for p in shape.iter() if local_name(p) == "p"))
    return "".join(f"{x}\n" for x in out)


def xlsx_text(data: bytes) -> str:
    """A banner a sheet, rows by tabs as wide as the widest, tabs and line ends in cells escaped."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    strings = ["".join(t.text or "" for t in s.iter() if local_name(t) == "t") for s in part_xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    book = "xl/_rels/workbook.xml.rels"
    targets = {e.get("Id"): e.get("Target").lstrip("/").removeprefix("xl/") for e in part_xml(z, book)} if book in names else {}
    numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    out = []
    for k, sheet in enumerate(e for e in part_xml(z, "xl/workbook.xml").iter() if local_name(e) == "sheet"):
        title, to = sheet.get("name"), targets.get(next((v for a, v in sheet.attrib.items() if a.rpartition("}")[2] == "id"), None))
        name = f"xl/{to}" if to else numbered[k] if k < len(numbered) else None
        if name not in names:  # a chart, or a part that is lost
            continue
        rows: dict[int, dict[int, str]] = {}
        for c in (e for e in part_xml(z, name).iter() if local_name(e) == "c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            value = next((v.text or "" for v in c.iter() if local_name(v) in ("v", "t")), "")
            value = strings[int(value)] if c.get("t") == "s" and value else value
            rows.setdefault(int(row), {})[column] = value.replace("\t", "\\t").replace("\r\n", "\\n").replace("\n", "\\n").replace("\r", "\\n")
        width = max((max(r) for r in rows.values()), default=0)
        out.append(f"{'=' * 20} Sheet: {title} {'=' * 20}")
        for k in range(1, max(rows, default=0) + 1):
            row = [rows.get(k, {}).get(c, "") for c in range(1, width + 1)]
            out.append("\t".join(row) if any(row) else "")
        out.append("")
    return "\n".join(out).rstrip("\n")


def utf8_text(data: bytes) -> str:
    text = data.decode("utf-8")
    if not text.strip():
        raise ValueError("the file is empty")
    return text


EXTRACTORS: dict[str, Callable[[bytes], str]] = {**dict.fromkeys(TEXT_EXTENSIONS, utf8_text), "docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}


def find_files(spark: SparkSession, path: str, known: DataFrame | None = None, extensions: tuple[str, ...] = (*TEXT_EXTENSIONS, *OFFICE_EXTENSIONS)) -> DataFrame:
    """Supported files below a path, contents not read, without those in known (path, status?): all, or those that are processed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    files = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))
    if known is None:
        return files
    done = known.where("status = 'processed'") if "status" in known.columns else known
    return files.join(done.select("path"), "path", "left_anti")


def read_files(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error): the text of every supported file; files that can't be read say why, and fail nothing else.

    PDF and other formats need an extractor of their own: give one by extension.
    """
    by = EXTRACTORS | (extractors or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, data in zip(f.path, f.content, strict=True):
                read = by.get(p.rpartition(".")[2].lower())
                try:
                    rows.append((p, read(data), None) if read else (p, None, "no extractor for this kind of file"))
                except Exception as e:  # a broken file is a row of its own
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.mapInPandas(run, "path string, text string, error string")


def parse_files(spark: SparkSession, path: str, parser: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """(path, modificationTime, json, error): each file's content list by a parser of blocks that the caller gives, in the form content lists are read in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, at, data in zip(f.path, f.modificationTime, f.content, strict=True):
                try:
                    rows.append((f"{p}_content_list.json", at, json.dumps(parser(p, data), ensure_ascii=False), None))
                except Exception as e:  # a broken file is a row of its own
                    rows.append((p, at, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "modificationTime", "json", "error"])

    return files.mapInPandas(run, "path string, modificationTime timestamp, json string, error string")


def latest_output(files: DataFrame, document: str = "document") -> DataFrame:
    """Of each document's parser outputs the newest."""
    return files.groupBy(document).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def unique_names(files: DataFrame, name: str, order: list[str], now: int, taken: DataFrame | None = None, out: str = "file_name") -> DataFrame:
    """files with a name of their own: the first of a name keeps it, others have _001 to _999 before the extension, and then the time and a number.

    taken: (name) names that are there already. Numbers that a name of either table has are left out. A name that a third
    of all files have is ranked over ranges; what is gathered of a name are its numbers, 999 at most.
    """
    ranked = numbered_in(files, [name], [F.col(c) for c in order], "__r")
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.*?(\.[^.]*)?$", 1)
    every = files.select(F.col(name).alias("n")) if taken is None else files.select(F.col(name).alias("n")).unionByName(taken.select(F.col(name).alias("n")))
    part = lambda k: F.regexp_extract("n", r"^(.*)_([0-9]{3})(\.[^.]*)?$", k)
    used = every.select(F.concat(part(1), part(3)).alias(name), part(2).alias("k")).where("k <> ''").groupBy(name).agg(F.collect_set(F.col("k").try_cast("int")).alias("__used"))
    there = (files.select(name).limit(0) if taken is None else taken.select(name)).distinct().withColumn("__there", F.lit(1))
    rows = ranked.join(used, name, "left").join(there, name, "left")
    place = F.col("__r") - 1 + F.coalesce("__there", F.lit(0))  # 0 keeps the name
    free = F.array_except(F.sequence(F.lit(1), F.lit(999)), F.coalesce("__used", F.array().cast("array<int>")))
    number = F.try_element_at(free, F.least(F.greatest(place, F.lit(1)), F.lit(1000)).cast("int"))
    late = F.concat(stem, F.lit(f"_{now}_"), (place - F.size(free)).cast("string"), end)
    shown = F.when(place == 0, F.col(name)).when(number.isNotNull(), F.concat(stem, F.lit("_"), F.lpad(number.cast("string"), 3, "0"), end)).otherwise(late)
    return rows.select(*(F.col(c) for c in files.columns if c != out), shown.alias(out))
