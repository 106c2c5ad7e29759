"""Operator 4, document fingerprints of closed syncmers. DataFrame functions only.

A text's K bytes at a place are an anchor if the least hash of their inner substrings of S bytes is that of the first or
the last of these. That depends on the K bytes alone, so an edit moves no anchors but those it touches, and the anchors
of a text put together of two are those of the parts, by position, and those across the seam. A fingerprint is the
SKETCH least 32-bit hashes of the distinct anchors, in the order of their first positions. Two fingerprints are matched by
position: of the least hashes of their union, those that both have in the same order are counted (a longest increasing
run), so passages that were moved count for less than such as stand where they stood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_bytes

K, S, SKETCH = 16, 8, 64
W = K - S + 1
assert W % 3 == 0
BLOCK = 2048
#: Documents that lie together in a range of ids, about, and the most ranges.
RANGE_ROWS, MAX_RANGES, FAN = 1000, 65536, 256
#: Sampled ids for each range, about.
SAMPLE = 20
LEAST = -(2**63)


def let(value: Column, body) -> Column:
    """body(x) with value computed once, however often a lambda in it asks for x."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(data: Column) -> Column:
    """Anchors of binary data in order, each as position << 32 | the low half of the hash of its K bytes."""

    def block(x: Column, first: Column) -> Column:
        last = F.least(first + BLOCK, F.octet_length(x) - (K - 1))
        hashes = F.transform(F.sequence(first + 1, last + (W - 1)), lambda i: F.xxhash64(F.substring(x, i, F.lit(S))))

        def chosen(h: Column, least: Column) -> Column:
            # The least of W is that of W / 3 threes.
            inner = lambda j: F.least(*(F.get(least, j + k) for k in range(0, W, 3)))
            edge = F.filter(F.sequence(F.lit(0), F.size(h) - W), lambda j: inner(j) == F.least(F.get(h, j), F.get(h, j + (W - 1))))
            return F.transform(edge, lambda j: F.shiftleft((first + j).cast("long"), 32).bitwiseOR(F.xxhash64(F.substring(x, first + j + 1, F.lit(K))).bitwiseAND(F.lit(0xFFFFFFFF))))

        def threes(h: Column) -> Column:
            return F.transform(h, lambda v, i: F.least(v, F.get(h, i + 1), F.get(h, i + 2)))

        return let(hashes, lambda h: let(threes(h), lambda least: chosen(h, least)))

    found = let(data, lambda x: F.flatten(F.transform(F.sequence(F.lit(0), F.octet_length(x) - K, F.lit(BLOCK)), lambda first: block(x, first))))
    return F.when(F.octet_length(data) >= K, found).otherwise(F.array().cast("array<bigint>"))


def low(found: Column) -> Column:
    return F.transform(found, lambda a: a.bitwiseAND(F.lit(0xFFFFFFFF)))


def sketch(hashes: Column, data: Column) -> Column:
    """The fingerprint as numbers, of hashes in the order of their positions. A text without an anchor stands for itself; the empty text has none."""
    whole = F.when(F.octet_length(data) > 0, F.array(F.xxhash64(data).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    ordered = F.array_distinct(F.when(F.size(hashes) > 0, hashes).otherwise(whole))
    return let(ordered, lambda x: let(F.get(F.sort_array(x), F.least(F.size(x), F.lit(SKETCH)) - 1), lambda last: F.filter(x, lambda h: h <= last)))


def digits(numbers: Column) -> Column:
    return F.lower(F.array_join(F.transform(numbers, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def in_order(places: Column) -> Column:
    """The length of the longest increasing run of distinct numbers: the least end of a run of each length, kept in a fold."""

    def step(ends: Column, p: Column) -> Column:
        return let(F.filter(ends, lambda e: e < p), lambda less: F.concat(less, F.array(p), F.slice(ends, F.size(less) + 2, F.greatest(F.size(ends), F.lit(1)))))

    return F.size(F.aggregate(places, F.array().cast("array<int>"), step))


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches: the share of the least SKETCH hashes of their union that both have in one order. Two empty ones are alike."""

    def matched(x: Column) -> Column:
        union = F.slice(F.sort_array(F.array_union(x["a"], x["b"])), 1, SKETCH)
        shared = let(F.element_at(union, -1), lambda last: F.filter(F.array_intersect(x["a"], x["b"]), lambda h: h <= last))
        places = F.transform(shared, lambda h: F.array_position(x["b"], h).cast("int"))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(in_order(places) / F.size(union))

    return let(F.struct(a.alias("a"), b.alias("b")), matched)


def sampled_bounds(keys: DataFrame, rows: int, count: int) -> list[int]:
    """About count - 1 ascending bounds between ranges of keys, from those whose hash is among the least.

    The hash alone says which keys count, so a task that runs again finds the same; a key that repeats counts once. Some
    SAMPLE of them for each range reach the driver. They place rows and decide nothing else.
    """
    if count == 1:
        return []
    share = min(1.0, SAMPLE * count / rows)
    hashed = F.xxhash64("key", F.lit(SAMPLE)).bitwiseAND(F.lit(2**53 - 1))
    found = sorted(r[0] for r in keys.where(hashed < F.lit(int(share * 2**53))).select("key").distinct().collect())
    return sorted({found[len(found) * i // count] for i in range(1, count)}) if found else []


def ranges(bounds: list[int], key: Column) -> Column:
    """How many of the ascending bounds are at most the key, by a search of two levels."""
    if not bounds:
        return F.lit(0)
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731  # one literal once folded
    c = F.size(F.filter(longs(bounds[::FAN]), lambda x: x <= key))
    fine = lambda c: F.size(F.filter(F.slice(longs(bounds), (c - 1) * FAN + 1, F.lit(FAN)), lambda x: x <= key))
    return let(c, lambda c: F.when(c == 0, F.lit(0)).otherwise((c - 1) * FAN + fine(c)))


def with_next(rows: DataFrame, add) -> DataFrame:
    """rows (doc_id, data) with what `add` makes of each row, and the struct `next` of the row that follows by descending doc_id.

    After the last row comes the first. Equal ids are in the order of their data; null ids come last. Rows are dealt by
    ranges of ids (quantiles of a sample), with the first row of each range copied to the one before it in this order,
    so data is shuffled once and no order over all rows is needed in one task.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    rows = rows.withColumn("key", key)
    n = rows.count()
    count = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    rows = rows.withColumn("range", ranges(sampled_bounds(rows, n, count), F.col("key")))
    tops = sorted((r[0], r[1]) for r in rows.groupBy("range").agg(F.max("key")).collect())  # a row a range
    # The greatest id of a range follows the least of the next range; that of the last range follows the least of all.
    copies = [(top, to[0], 0) for (_, top), to in zip(tops, tops[1:], strict=False)] + [(tops[-1][1], tops[0][0], 1)] if tops else []
    copies = rows.sparkSession.createDataFrame(copies, "key long, to int, wrap int")
    here = F.struct(F.col("range").alias("range"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))
    there = F.struct(F.col("to").alias("range"), F.col("wrap").alias("wrap"), F.lit(True).alias("copy"))
    dealt = rows.join(F.broadcast(copies), "key", "left").withColumn("x", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("doc_id", "data", "key", "x.range", "x.wrap", "x.copy")
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range")
    made = add(dealt)
    names = [c for c in made.columns if c not in ("doc_id", "key", "range", "wrap", "copy")]
    order = Window.partitionBy("range").orderBy("wrap", F.desc("key"), "copy", "data")
    return made.withColumn("next", F.lead(F.struct(*names)).over(order)).where(~F.col("copy")).drop("key", "range", "wrap", "copy")


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are to each other and to the next document's.

    Null text: empty. Null doc_ids come last in the descending order, equal ids in the order of their texts; rows that
    repeat keep a row each. A single document is its own next one; an empty table gives no rows. Texts without an anchor
    have the fingerprint of the whole text, empty ones an empty fingerprint.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_bytes().alias("data"))
    df = with_next(docs, lambda d: d.withColumn("anchors", anchors(F.col("data"))).withColumn("sketch", sketch(low(F.col("anchors")), F.col("data"))))
    text = F.col("data").cast("string")
    df = df.withColumn("n_chars", F.length(text).cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    df = df.withColumn("head", F.left(text, (F.col("n_chars") - F.col("half")).cast("int")).cast("binary"))
    df = df.withColumn("tail", F.left(F.col("next.data").cast("string"), F.col("half")).cast("binary"))
    inside = lambda found, end: let(end - K, lambda e: F.filter(found, lambda a: F.shiftright(a, 32) <= e))
    h, t = F.octet_length("head"), F.octet_length("tail")
    seam = F.concat(F.substring("head", F.greatest(h - (K - 2), F.lit(1)), F.lit(K - 1)), F.substring("tail", F.lit(1), F.lit(K - 1)))
    df = df.withColumn("seam", seam)
    df = df.withColumn("edited", F.concat(inside(F.col("anchors"), h), anchors(F.col("seam")), inside(F.col("next.anchors"), t)))
    whole = F.concat("head", "tail")
    df = df.select("doc_id", "n_chars", F.sha2(whole, 256).alias("edited_sha256"), "sketch", sketch(low(F.col("edited")), whole).alias("edited"), F.col("next.sketch").alias("next"))
    return df.select("doc_id", "n_chars", "edited_sha256", digits(F.col("sketch")).alias("fingerprint"), digits(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited")).alias("near_edited"), likeness(F.col("sketch"), F.col("next")).alias("near_next"))
