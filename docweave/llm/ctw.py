"""Operator 10, language-model scoring by context-tree weighting.

A text is coded byte by byte, each byte as eight binary decisions; a decision's context is the bytes before, DEPTH of
them at most. Every node of a context tree, one tree a decision, holds a Krichevsky-Trofimov estimate of the training
bits seen there, and a node's probability weighs its own estimate and its children's product half each. With all
training counts in place, the weights that this gives mix the estimates of all depths from no context to DEPTH bytes.
Nodes that saw no bit hold no estimate; what they would weigh stays with the node above. A text starts after END bytes
and ends with one, a byte that UTF-8 never has, so probabilities of all texts sum to one at most.

1. Training grams (context and byte) and words are counted by Spark: sorted runs of keys with counts a part of a task,
   summed by bucket. A bucket holds all contexts with some two last bytes, so it builds its nodes of two bytes and more
   alone; of the nodes above buckets give their shares of the sums. Two bytes that over a share of the corpus ends in
   (by a sample, which decides places only, not results) are split by the byte before, and so on, so no bucket is much
   larger than others; such contexts, at most 1 / SHARE a length, are nodes above.
2. Groups of documents ask the buckets for the keys they have and get each key back with a number. The model is never in
   one place, and grows with the corpus.

Words for the base score are counted by 64-bit hash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import small_batches, text_bytes, tidy, tidy2, written
from .runs import mix, pack_sorted, unpack_sorted

_U = np.uint64
DEPTH, END, FOLDS, HELD_OUT = 5, 0xFF, 5, 1
WORDS, GRAMS, TOP = 0, 1, 2
#: Bytes of text counted at once; documents and bytes of a group; bytes of text for each bucket, about.
COUNT_STEP, SCORE_STEP, GROUP_ROWS, GROUP_BYTES, BUCKET_BYTES = 8 << 20, 2 << 20, 4000, 16 << 20, 16 << 20
#: A context is split if it has so many times a bucket's even share, but not for a smaller share of all bytes than SHARE;
#: documents of the sample that tells, about.
UNEVEN, SHARE, SAMPLE = 4, 1 / 8192, 4096
HALF = np.log(0.5)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


# Keys


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte of the texts and of their ends, and where each text's keys start.

    A key has the byte before in its highest place, then the one before that; the byte itself is in the lowest.
    """
    pad = bytes([END]) * DEPTH
    b = np.frombuffer(b"".join(x for t in texts for x in (pad, t, pad[:1])), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = len(b) - DEPTH
    key = b[DEPTH:].astype(_U)
    for d in range(1, DEPTH + 1):
        key |= b[DEPTH - d : DEPTH - d + n].astype(_U) << _U(8 * (DEPTH + 1 - d))
    keep = np.ones(n, bool)
    heads = (starts + DEPTH * np.arange(len(texts)))[1:]  # the next text's padding is no text
    keep[(heads[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return key[keep], starts


def context(keys: np.ndarray, d: int) -> np.ndarray:
    """The last d bytes before, the very last in the highest place."""
    return keys >> _U(8 * (DEPTH + 1 - d))


class Split:
    """Which bucket a gram belongs to: by its last two bytes or, where these are common, as many more as it takes."""

    def __init__(self, common: dict[int, np.ndarray], few: int):
        """common: by length, from 2 to DEPTH - 1, ascending contexts that are split. 2^few buckets."""
        self.common, self.few = common, few

    def depth(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), 2)
        for d in range(2, DEPTH):
            if len(self.common.get(d, ())):
                at = np.flatnonzero(out == d)
                out[at[np.isin(context(keys[at], d), self.common[d])]] += 1
        return out

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if not self.few:
            return np.zeros(len(keys), np.int64)
        d = self.depth(keys)
        own = keys >> (8 * (DEPTH + 1 - d)).astype(_U)
        return (mix(own * _U(8) + d.astype(_U)) >> _U(64 - self.few)).astype(np.int64)

    def above(self, d: int) -> np.ndarray:
        """The contexts of d bytes whose nodes lie over several buckets, ascending."""
        return self.common.get(d, np.zeros(0, _U)) if d > 1 else np.arange(256**d, dtype=_U)

    @classmethod
    def of(cls, rows: DataFrame, n: int, few: int) -> Split:
        least = max(SHARE, UNEVEN / (1 << few))
        if least >= 1:
            return cls({}, few)

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for some in in_steps([t.as_py() for t in b.column(0)], COUNT_STEP):
                    k, c = np.unique(context(grams(some)[0], DEPTH - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([pack_sorted(k)]), pa.array([packed_counts(c)])], names=["keys", "counts"])

        some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
        found = some.mapInArrow(counts, "keys binary, counts binary").collect()
        k, c = summed([unpack_sorted(bytes(r[0])) for r in found], [unpacked_counts(bytes(r[1])) for r in found])
        common = {}
        for d in range(2, DEPTH):
            ctx, n_ = summed([k >> _U(8 * (DEPTH - 1 - d))], [c])
            common[d] = ctx[n_ > least * c.sum()]
        return cls(common, few)


def word_hashes(words) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(w, 42) for w in words), _U, len(words))


def packed_counts(counts: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if w == 8 or counts.max(initial=0) < 256**w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate([*keys, np.zeros(0, _U)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
    return k[head], np.add.reduceat(c, head) if len(head) else c


def by_bucket(keys: np.ndarray, kind: int, split: Split) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of ascending keys; positions ascend."""
    of = split.bucket(keys) if kind == GRAMS else (keys >> _U(64 - split.few)).astype(np.int64) if split.few else np.zeros(len(keys), np.int64)
    order = np.argsort(of, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(some):
            yield int(of[some[0]]), some


def in_steps(texts: list[bytes], step: int) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t) + 1
        if size >= step:
            yield out
            out, size = [], 0
    if out:
        yield out


# The tree


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1/2, by Stirling's series after eight steps up."""
    low = np.log(x)
    for k in range(1, 8):
        low = low + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def estimated(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1.0)


def decisions(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, 8): the decision of each bit (1 and the bits before it) and the bit."""
    b, x = np.arange(8), symbols.astype(np.int64)[:, None]
    return 1 << b | x >> 8 - b, x >> 7 - b & 1


class Tree:
    """The nodes of a bucket's contexts, from ascending keys and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, split: Split):
        self.contexts, self.nodes, self.bits, self.roots = {}, {}, {}, []
        least = split.depth(keys)
        decision, bit = decisions(keys & _U(255))
        weight = np.repeat(counts[:, None], 8, axis=1)
        child = None
        for d in range(DEPTH, 1, -1):
            own_ = least <= d
            ctx = context(keys[own_], d)
            head = np.concatenate([[True], ctx[1:] != ctx[:-1]])[: len(ctx)]
            self.contexts[d] = ctx[head]
            node = ((np.cumsum(head) - 1)[:, None] * 256 + decision[own_]).ravel()
            names, index = np.unique(node, return_inverse=True)
            ones = np.bincount(index, (weight[own_] * bit[own_]).ravel(), len(names))
            zeros = np.bincount(index, weight[own_].ravel(), len(names)) - ones
            own = estimated(zeros, ones)
            if child is None:
                whole, stay = own, np.ones(len(names))
            else:
                lower, total = child
                parent = np.searchsorted(self.contexts[d], self.contexts[d + 1][lower >> 8] >> _U(8)) * 256 + (lower & 255)
                below = np.bincount(np.searchsorted(names, parent), total, len(names))
                whole = np.logaddexp(HALF + own, HALF + below)
                stay = np.exp(HALF + own - whole)
            self.nodes[d], self.bits[d] = names, (zeros, ones, stay)
            # The topmost nodes here hang on nodes of d - 1 bytes that lie over several buckets; the others have a parent.
            top = (least[own_][head] == d)[names >> 8]
            if top.any():
                above = np.searchsorted(split.above(d - 1), self.contexts[d][names[top] >> 8] >> _U(8))
                name, index = np.unique(above * 256 + (names[top] & 255), return_inverse=True)
                self.roots.append((d - 1, name, np.stack([np.bincount(index, x[top], len(name)) for x in (zeros, ones, whole)])))
            child = names[~top], whole[~top]

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """(keys, 8): the mixed probability of each bit of the keys' bytes; nan where no node of the bucket has seen the decision."""
        decision, bit = decisions(keys & _U(255))
        p = np.full(decision.shape, np.nan)
        for d in range(DEPTH, 1, -1):
            if not len(self.contexts[d]):
                continue
            ctx = context(keys, d)
            at = np.minimum(np.searchsorted(self.contexts[d], ctx), len(self.contexts[d]) - 1)
            name = at[:, None] * 256 + decision
            node = np.minimum(np.searchsorted(self.nodes[d], name), len(self.nodes[d]) - 1)
            seen = (self.nodes[d][node] == name) & (self.contexts[d][at] == ctx)[:, None]
            p = mixed(p, seen, *(x[node] for x in self.bits[d]), bit)
        return p


def mixed(below: np.ndarray, seen: np.ndarray, zeros: np.ndarray, ones: np.ndarray, stay: np.ndarray, bit: np.ndarray) -> np.ndarray:
    own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    here = np.where(np.isnan(below), own, stay * own + (1 - stay) * below)
    return np.where(seen, here, below)


class Top:
    """The nodes above the buckets', from no context on, by sums[d] (3, contexts, 256): zeros, ones, and what lies below."""

    def __init__(self, split: Split, sums: dict[int, np.ndarray]):
        self.split, self.levels = split, {}
        for d in sorted(sums, reverse=True):
            zeros, ones, below = sums[d]
            own = estimated(zeros, ones)
            whole = np.where(zeros + ones > 0, np.logaddexp(HALF + own, HALF + below), 0.0)
            self.levels[d] = zeros, ones, np.exp(HALF + own - whole)
            if d:
                parent = np.searchsorted(split.above(d - 1), split.above(d) >> _U(8))
                for k, x in enumerate((zeros, ones, whole)):
                    np.add.at(sums[d - 1][k], parent, x)

    def log10(self, keys: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 of the probability of the keys' bytes, p the mixtures of the nodes below."""
        decision, bit = decisions(keys & _U(255))
        for d, (zeros, ones, stay) in self.levels.items():
            above, ctx = self.split.above(d), context(keys, d)
            if len(above):
                at = np.minimum(np.searchsorted(above, ctx), len(above) - 1)
                here, at = (above[at] == ctx)[:, None], (at[:, None], decision)
                z, o = zeros[at], ones[at]
                p = mixed(p, here & (z + o > 0), z, o, stay[at], bit)
        return np.log10(np.where(np.isnan(p), 0.5, p)).sum(1)


# Counting

COUNTED = "kind int, bucket int, keys binary, counts binary"
MODEL = "kind int, bucket int, keys binary, counts binary, total long, n_distinct long"


def count(rows: DataFrame, split: Split) -> DataFrame:
    """The model: sums of words and grams by bucket, and what each bucket gives to the nodes above it (kind TOP, total: their depth)."""

    def part(texts: list[bytes]) -> pa.RecordBatch:
        out: list[tuple] = []
        words: Counter = Counter()
        for t in texts:
            words.update(t.lower().split())
        keys, n = word_hashes(words), np.fromiter(words.values(), np.int64, len(words))
        order = np.argsort(keys)
        sets = [(WORDS, keys[order], n[order])]
        key, _ = grams(texts)
        key.sort()
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sets.append((GRAMS, key[head], np.diff(np.append(head, len(key)))))
        for kind, k, c in sets:
            out += [(kind, b, pack_sorted(k[at]), packed_counts(c[at])) for b, at in by_bucket(k, kind, split)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "keys", "counts"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                held.append(t.as_py())
                size += len(held[-1]) + 1
                if size >= COUNT_STEP:
                    yield part(held)
                    held, size = [], 0
        if held:
            yield part(held)

    def add(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts = summed([unpack_sorted(x) for x in table.column("keys").to_pylist()], [unpacked_counts(x) for x in table.column("counts").to_pylist()])
        out = [(kind, bucket, pack_sorted(keys), packed_counts(counts), int(counts.sum()), len(keys))]
        if kind == GRAMS:
            for d, name, sums in Tree(keys, counts, split).roots:
                out.append((TOP, bucket, name.astype("<i8").tobytes(), sums.astype("<f8").tobytes(), d, 0))
        return pa.table({c: list(v) for c, v in zip(("kind", "bucket", "keys", "counts", "total", "n_distinct"), zip(*out, strict=True), strict=True)}, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("n_distinct", pa.int64())]))

    train = rows.where("not held_out").select("text")
    return train.mapInArrow(runs, COUNTED).groupBy("kind", "bucket").applyInArrow(tidy(add), MODEL)


def top_of(model: DataFrame, split: Split) -> Top:
    """The topmost nodes. A node below belongs to one bucket, so what comes here is bounded by SHARE, whatever the corpus."""
    sums = {d: np.zeros((3, len(split.above(d)) * 256)) for d in range(DEPTH)}
    for r in model.where(F.col("kind") == TOP).select("keys", "counts", "total").toLocalIterator():
        sums[r[2]][:, np.frombuffer(bytes(r[0]), "<i8")] += np.frombuffer(bytes(r[1]), "<f8").reshape(3, -1)
    return Top(split, {d: x.reshape(3, -1, 256) for d, x in sums.items()})


# Scoring


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys once each, ascending; sorts them where they are."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]]


def distinct_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a group's words, and its grams, ascending."""
    words: set[bytes] = set()
    found = np.zeros(0, _U)
    held: list[np.ndarray] = []
    for some in in_steps(texts, SCORE_STEP):
        for t in some:
            words.update(t.lower().split())
        held.append(distinct(grams(some)[0]))
        if len(held) == 8:
            found, held = distinct(np.concatenate([found, *held])), []
    return np.sort(word_hashes(words)), distinct(np.concatenate([found, *held]))


class Numbered(defaultdict):
    """Words by number, in the order of their first places. The end of a text is the empty word, number 0."""

    def __init__(self):
        super().__init__(self.__len__, {b"": 0})

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words and ends of the texts, and how many each text has."""
        words: list[bytes] = []
        sizes = []
        for t in texts:
            before = len(words)
            words += t.lower().split()
            words.append(b"")
            sizes.append(len(words) - before)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words)), np.array(sizes, np.int64)


class Lookup:
    """Values by key: a table of hashed keys, and a search for the few keys whose places clash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = _U(64 - min(24, max(8, int(len(keys)).bit_length() + 3)))
        size = 1 << 64 - int(self.shift)
        place = (keys * _U(0x9E3779B97F4A7C15)) >> self.shift
        self.table = np.zeros(size, values.dtype)
        self.table[place] = values
        twice = np.bincount(place.astype(np.int64), minlength=size) > 1
        self.table[twice] = np.nan

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self.table[(keys * _U(0x9E3779B97F4A7C15)) >> self.shift]
        clash = np.flatnonzero(np.isnan(out))
        out[clash] = self.values[np.searchsorted(self.keys, keys[clash])]
        return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """Scores of whole texts by a model learned from all documents that are not held out; a row a row of docs.

    Null text counts as empty: no word, one end. Null doc_ids are in the fold of the empty id. Without any training
    document each bit has probability 1/2.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_bytes().alias("text"))
    n, size, ends = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).first()
    few = max(2, (size // BUCKET_BYTES).bit_length())
    split = Split.of(rows, n, few)
    model = written(count(rows, split))
    totals = model.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    tokens, vocabulary = totals[0] + ends, totals[1] + (1 if ends else 0)
    top = spark.sparkContext.broadcast(top_of(model, split))
    groups = max(1, -(-n // GROUP_ROWS), -(-size // GROUP_BYTES))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    by_group = rows.groupBy("group")

    def ask(table: pa.Table) -> pa.Table:
        hashes, found = distinct_keys([t.as_py() for t in table.column("text")])
        group, out = table.column("group")[0].as_py(), []
        for kind, keys in ((WORDS, hashes), (GRAMS, found)):
            out += [(kind, b, group, pack_sorted(keys[at])) for b, at in by_bucket(keys, kind, split)]
        return pa.table({c: list(v) for c, v in zip(("kind", "bucket", "group", "keys"), zip(*out, strict=True), strict=True)}, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("group", pa.int32()), ("keys", pa.binary())]))

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"group": [], "kind": [], "keys": [], "data": []}, schema=pa.schema([("group", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("data", pa.binary())]))
        kind = asked.column("kind")[0].as_py()
        runs = [unpack_sorted(x) for x in asked.column("keys").to_pylist()]
        keys = unpack_sorted(known.column("keys")[0].as_py()) if known.num_rows else np.zeros(0, _U)
        counts = unpacked_counts(known.column("counts")[0].as_py()) if known.num_rows else np.zeros(0, np.int64)
        every = np.unique(np.concatenate(runs))
        if kind == WORDS:
            at = np.searchsorted(keys, every)
            at[at == len(keys)] = 0
            value = np.where(keys[at] == every, counts[at], 0) if len(keys) else np.zeros(len(every), np.int64)
            data = [packed_counts(value[np.searchsorted(every, x)]) for x in runs]
        else:
            value = np.empty(len(every), "<f4")
            tree = Tree(keys, counts, split)
            for i in range(0, len(every), 1 << 16):
                some = every[i : i + (1 << 16)]
                value[i : i + len(some)] = top.value.log10(some, tree.probabilities(some))
            data = [value[np.searchsorted(every, x)].tobytes() for x in runs]
        return pa.table({"group": asked.column("group"), "kind": asked.column("kind"), "keys": asked.column("keys"), "data": pa.array(data, pa.binary())})

    def tell(table: pa.Table, told: pa.Table) -> pa.Table:
        texts = [t.as_py() for t in table.column("text")]

        def answers(kind: int, unpack, dtype) -> tuple[np.ndarray, np.ndarray]:
            some = told.filter(pc.equal(told.column("kind"), kind))
            keys = np.concatenate([*map(unpack_sorted, some.column("keys").to_pylist()), np.zeros(0, _U)])
            values = np.concatenate([*map(unpack, some.column("data").to_pylist()), np.zeros(0, dtype)])
            order = np.argsort(keys)
            return keys[order], values[order]

        numbered, numbers = Numbered(), []
        for some in in_steps(texts, SCORE_STEP):
            numbers.append(numbered.of(some))
        names = list(numbered)[1:]
        keys, values = answers(WORDS, unpacked_counts, np.int64)
        counts = np.concatenate([[ends], values[np.searchsorted(keys, word_hashes(names))]])
        logs = np.log10((counts + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        look = Lookup(*answers(GRAMS, lambda x: np.frombuffer(x, "<f4"), np.float32))
        base, n_tokens, n_known, scores = [], [], [], []
        for some, (number, sizes) in zip(in_steps(texts, SCORE_STEP), numbers, strict=True):
            key, starts = grams(some)
            scores.append(np.add.reduceat(look(key).astype(np.float64), starts))
            starts = np.cumsum(sizes) - sizes
            base.append(np.add.reduceat(logs[number], starts))
            n_known.append(np.add.reduceat((counts > 0)[number], starts, dtype=np.int64))
            n_tokens.append(sizes)
        base, n_tokens, n_known, scores = map(np.concatenate, (base, n_tokens, n_known, scores))
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": [tokens] * len(texts), "base_score": base, "score": scores})

    asked = by_group.applyInArrow(tidy(ask), "kind int, bucket int, group int, keys binary")
    known = model.where(F.col("kind") != TOP).select("kind", "bucket", "keys", "counts")
    told = known.groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket")).applyInArrow(tidy2(answer), "group int, kind int, keys binary, data binary")
    return by_group.cogroup(told.groupBy("group")).applyInArrow(tidy2(tell), SCORED)


def op10_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a context tree of five bytes learned from those with crc32(doc_id) mod 5 other than 1."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
