"""Operator 12, a source divergence audit over term-block dense matrices.

Words are counted once, in the scan; what is shuffled are counts by language, source and word. The kept words of a
language are dealt into blocks of about TERMS by their hash, its sources into blocks of SOURCES by their number. A tile
(language, word block, two source blocks) is a dense int64 matrix of counts, source by word; the divergences of all its
pairs of sources are taken by broadcasting. Partial pair sums are added up over the word blocks, and each word block
hands on a heap of the best words of each source.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

LEAST_DOCS, TOP, UNIT = 10, 10, 10**9
#: Words and sources of a tile's sides.
TERMS, SOURCES = 512, 64
#: Counts that a task holds before it hands them on; bytes of a text that are cut into words at once.
HELD, STEP = 200_000, 1 << 20
#: In UTF-8 every byte of a code point beyond 7F is 80 or more, so terms can be cut from bytes.
TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
COUNTS = "lang string, source string, term string, n long, docs long"
TILE = "lang string, part string, one int, two int, term string, value long"


def slices(data: bytes, step: int) -> Iterator[bytes]:
    """A long text in pieces of about `step` bytes, cut between terms."""
    at = 0
    while len(data) - at > step:
        gap = GAP.search(data, at + step)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def counted(batches: Iterator[pa.RecordBatch], most: int, step: int) -> Iterator[pa.RecordBatch]:
    """COUNTS of the documents of a task, in parts; a row without a term for every language and source seen."""
    words: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def out() -> pa.RecordBatch:
        langs, sources, terms, n, of = [], [], [], [], []
        for (lang, source), found in words.items():
            langs += [lang] * (len(found) + 1)
            sources += [source] * (len(found) + 1)
            terms += [None, *found]
            n += [0, *found.values()]
            of += [0, *docs[lang, source].values()]  # both have their terms in one order
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            found: Counter = Counter()
            for piece in slices(text.encode().lower(), step):  # of bytes, lower() changes A-Z only
                found.update(TERM.findall(piece))
            mine, of = words[lang, source], docs[lang, source]
            held -= len(mine)
            mine.update(found)
            of.update(found.keys())
            held += len(mine)
            if held > most:
                yield out()
                words.clear()
                docs.clear()
                held = 0
    if words:
        yield out()


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact for totals up to 9e15: divided three digits at a time."""
    whole = np.asarray(total, np.int64) + 2 * kept
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, whole.shape), np.int64), counts + 2
    digits, rest = np.divmod(rest, whole)  # one only if a language has one word
    out += digits
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tile(table: pa.Table, sources: int) -> pa.Table:
    """Of one tile: partial sums of all pairs of its sources, and, on the diagonal, the best words of each source."""
    col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    head = table.column("term").is_null().to_numpy(zero_copy_only=False)
    number, total = col("number")[head], col("total")[head].astype(np.int64)
    order = np.argsort(number)
    number, total = number[order], total[order]
    kept, lang_total, width = (int(col(c)[head][0]) for c in ("kept", "lang_total", "width"))
    cells = table.filter(pa.array(~head))
    code = cells.column("term").combine_chunks().dictionary_encode()
    terms, at = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
    counts = np.zeros((len(number), len(terms) + 1), np.int64)  # the last column stands for the words of the block that these sources lack
    counts[np.searchsorted(number, cells.column("number").to_numpy()), at] = cells.column("n").to_numpy()
    p = shares(counts, total[:, None], kept) if kept else np.ones_like(counts)
    weight = np.ones(len(terms) + 1, np.int64)
    weight[-1] = width - len(terms)
    block = number // sources
    i, j = np.flatnonzero(block == a), np.flatnonzero(block == b)
    sums = (divergence(p[i][:, None, :], p[j][None, :, :]) * weight).sum(2)
    one, two = np.meshgrid(number[i], number[j], indexing="ij")
    fine = one < two
    pairs = {"one": one[fine], "two": two[fine], "value": sums[fine]}
    best: list[tuple[int, str, int]] = []
    if a == b and terms:
        in_lang = np.zeros(len(terms), np.int64)
        in_lang[at] = cells.column("lang_n").to_numpy()
        q = shares(in_lang, lang_total, kept)
        for k, row in enumerate(p[:, :-1]):
            over = np.flatnonzero((counts[k, :-1] > 0) & (row > q))
            f = divergence(row[over], q[over]).tolist()
            found = heapq.nsmallest(TOP, zip([-x for x in f], [terms[x].encode() for x in over.tolist()], strict=True))
            best += [(int(number[k]), t.decode(), -x) for x, t in found]
    n = len(pairs["one"])
    parts = [
        pa.array([lang] * (n + len(best)), pa.string()), pa.array(["pair"] * n + ["term"] * len(best), pa.string()), pa.array([*pairs["one"].tolist(), *(x[0] for x in best)], pa.int32()),
        pa.array([*pairs["two"].tolist(), *[None] * len(best)], pa.int32()), pa.array([*[None] * n, *(x[1] for x in best)], pa.string()), pa.array([*pairs["value"].tolist(), *(x[2] for x in best)], pa.int64()),
    ]
    return pa.table(parts, names=[c.split()[0] for c in TILE.split(", ")])


def audited(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and its telling words.

    A null language, source or text counts as ''. Every source that has a row is there, with texts or without. Terms are
    runs of letters A-Z in any case and of code points beyond 7F, from whole texts; a language keeps those that at least
    LEAST_DOCS of its rows have (repeated rows count each). Part `pair` has a row for each other source of the language;
    its value is zero where no term is kept. Part `term` has the TOP terms a source has more often than its language.
    Ties go to the lesser item by UTF-8 bytes. Other columns are ignored; an empty table gives no rows. Values are exact
    up to 9e15 words a language. Sources of a language are numbered in one task, a row a source: as their pairs are
    returned, there are far fewer than rows of any other step.
    """
    small_batches(docs.sparkSession)
    most, step, side = HELD, STEP, SOURCES  # as they are here, not where a task runs
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    cells = written(given.mapInArrow(lambda batches: counted(batches, most, step), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    vocabulary = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    blocks = F.ceil(F.col("kept") / TERMS)
    vocabulary = vocabulary.join(langs, "lang").select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"))
    found = written(cells.where("term is not null").select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cells.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number"), *(F.coalesce(c, none).alias(c) for c in ("total", "kept", "lang_total")))
    groups = written(groups.withColumn("last", F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / SOURCES).cast("int")))
    # A header for each source and word block, of blocks without words too where a language has none at all.
    widths = found.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("width"))
    widths = widths.unionByName(groups.where("kept = 0").select("lang", F.lit(0).alias("block"), none.alias("width")).distinct())
    text_of = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = groups.join(widths, "lang").select("lang", "block", "number", "last", "total", "kept", "lang_total", "width", text_of("term", "string"), text_of("n", "long"), text_of("lang_n", "long"))
    body = found.join(groups.select("lang", "source", "number", "last"), ["lang", "source"])
    body = body.select("lang", "block", "number", "last", *(text_of(c, "long") for c in ("total", "kept", "lang_total", "width")), "term", "n", "lang_n")
    own, other = F.floor(F.col("number") / SOURCES).cast("int"), F.explode(F.sequence(F.lit(0), "last")).alias("other")
    dealt = heads.unionByName(body).select("*", own.alias("own"), other)
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("own", "other", "last")
    tiles = written(dealt.groupBy("lang", "block", "a", "b").applyInArrow(tidy(lambda t: tile(t, side)), TILE))
    names = groups.select("lang", "number", "source")
    sums = tiles.where("part = 'pair'").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("one").alias("x"), F.col("two").alias("y")), F.struct(F.col("two").alias("x"), F.col("one").alias("y")))).alias("w")
    pairs = sums.select("lang", "value", ways).select("lang", F.col("w.x").alias("number"), F.col("w.y").alias("y"), "value")
    pairs = pairs.join(names.select("lang", F.col("number").alias("y"), F.col("source").alias("item")), ["lang", "y"]).drop("y")
    best = Window.partitionBy("lang", "number").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    top = tiles.where("part = 'term'").select("lang", F.col("one").alias("number"), F.col("term").alias("item"), "value")
    top = top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP).withColumn("part", F.lit("term"))
    return pairs.unionByName(top).join(names, ["lang", "number"]).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; audited() has the rules."""
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
w AS (SELECT lang, source, n, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
t AS (SELECT lang, source, n, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (kept.lang_n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
