"""Operator 9, SimHash near-dedup by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two fingerprints within the radius share a
variant, and two that share one are within it, so owners of a variant are linked to the first of them and no pairs are
made. Variants are exchanged twice: first as sorted runs of their hashes alone, cut to a few more bits than their number
has, which shows the hashes that occur more than once; then only variants with such a hash, whole and with their owners,
are brought together and verified.

For texts that are similar rather than almost equal a wide fingerprint is cut into blocks, each ball-hashed in itself. As
blocks are short, unrelated texts of a large corpus have equal ones; so a block's variants are shuffled together with
the least shingle of one part of the hash range, which two texts have in common as likely as they are similar. Pairs are
verified over all bits. There links only say which texts may be similar: they make families, in which all texts of
different groups are compared by their shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docweave.operators.components import components

from .common import small_batches, text_bytes, tidy, tidy2, trim, written
from .runs import among, mix, pack_sorted, shared, unpack_sorted

_U = np.uint64
#: Bytes of variant keys that a run makes, and variants that meet in a bucket, about. Both are large, as a run sends a
#: row to each bucket.
RUN_BYTES, BUCKET_KEYS = 24 << 20, 3 << 20
#: Runs that there are at least, if there is something for each, so that all cores have work.
SPREAD = 32
STEP = 1 << 15
#: Texts of a family that are compared in one task, and shingles that are counted at a time there.
BLOCK, COLUMNS = 512, 2048


@dataclass(frozen=True)
class Ball:
    """words: of 64 bits; blocks of width bits with variants of up to half changed bits; links at radius bits at most.

    salted: each block's keys go with a number of 32 bits that comes behind the words of the fingerprint.
    """

    words: int = 1
    blocks: int = 1
    width: int = 64
    half: int = 2
    radius: int = 4
    salted: bool = False

    @property
    def masks(self) -> np.ndarray:
        bits = [1 << i for i in range(self.width)]
        return np.array([sum(c) for n in range(self.half + 1) for c in itertools.combinations(bits, n)], _U)

    @property
    def certain(self) -> bool:
        """Any two owners of a variant are within the radius."""
        return self.blocks == 1 and 2 * self.half <= self.radius

    @property
    def variants(self) -> int:
        return self.blocks * len(self.masks)

    def parsed(self, fingerprints: list[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
        """(fingerprints, words), and (fingerprints, blocks) salts."""
        both = np.frombuffer(b"".join(fingerprints), np.uint8).reshape(len(fingerprints), 8 * self.words + 4 * self.blocks * self.salted)
        fps = np.ascontiguousarray(both[:, : 8 * self.words]).view("<u8")
        return fps, np.ascontiguousarray(both[:, 8 * self.words :]).view("<u4") if self.salted else None

    def keys(self, fps: np.ndarray, salts: np.ndarray | None = None) -> np.ndarray:
        """(fingerprints, variants): mixed keys of all variants of all blocks. A block's number is part of its keys."""
        parts = []
        for k in range(self.blocks):
            word, bit = divmod(k * self.width, 64)
            v = fps[:, word] >> _U(bit)
            if bit + self.width > 64:
                v = v | fps[:, word + 1] << _U(64 - bit)
            if self.width < 64:
                v = v & _U((1 << self.width) - 1)
            v = v[:, None] ^ self.masks[None, :]
            v = v if self.blocks == 1 else v | _U(k << self.width)
            parts.append(v if salts is None else v | salts[:, k : k + 1].astype(_U) << _U(32))
        return mix(parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1))


#: The contract of op9, and the ball for five-word shingles at a similarity of 0.8: expected distance 48 bits, spread 6.4;
#: a block of 16 is at most two bits apart with 56 %, and has an equal salt with 80 %; one of 20 blocks with 99.999 %.
#: Unrelated texts have a distance of 160, spread 9.
EXACT, SIMILAR = Ball(), Ball(words=5, blocks=20, width=16, half=1, radius=76, salted=True)
#: Texts of up to so many shingles have few for a fingerprint; they become candidates by the shingles themselves.
SHORT = 64
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's shingles, repeats included, some at a time; ASCII-lower-cased words."""
    words = text.lower().split()
    if not words:
        return
    if len(words) <= size:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], _U)
        return
    for first in range(0, len(words) - size + 1, STEP):
        some = words[first : first + STEP + size - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(some) - size + 1
        yield np.array([xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], _U)


def byte_table() -> np.ndarray:
    """A random word for each byte, that of capitals A-Z the small letters'."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    table[65:91] = table[97:123]
    return table


_TABLE = byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


class Powers:
    """Powers of the base and of its inverse, as many as the longest piece so far has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, base, _U)]), dtype=_U) for base in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start, and their hashes: sums of byte numbers times powers of their place."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[b], [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS(len(b) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[b] * up[: len(b)], dtype=_U)])
    return start, mix((sums[end] - sums[start]) * down[start])


def joined_words(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` words that follow each other."""
    h = np.zeros(max(0, len(words) - size + 1), _U)
    for k in range(size):
        h = mix(h * _U(31) + words[k : k + len(h)])
    return h


def few_words(words: np.ndarray, size: int) -> np.ndarray:
    """The only shingle of a text of fewer than `size` words; none without a word."""
    return mix(joined_words(words, len(words)) + _U(len(words))) if 0 < len(words) < size else np.zeros(0, _U)


def long_shingle_set(text: bytes, size: int) -> np.ndarray:
    """As shingle_sets, of one text, a piece at a time; a piece ends with a word."""
    parts, before, first = [], np.zeros(0, _U), 0
    while first < len(text):
        reach, cut = PIECE, len(text)
        while first + reach < len(text):
            space = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, reach, first)])
            if len(space):
                cut = first + int(space[-1]) + 1
                break
            reach *= 2
        words = np.concatenate([before, word_hashes(np.frombuffer(text, np.uint8, cut - first, first))[1]])
        parts.append(np.unique(joined_words(words, size)))
        before, first = words[max(0, len(words) - size + 1) :], cut
    found = np.unique(np.concatenate([*parts, np.zeros(0, _U)]))
    return found if len(found) else few_words(before, size)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of `size` words of each text, ASCII-lower-cased, as ascending hashes; fewer words are one shingle."""
    held: list[bytes] = []
    room = PIECE
    for t in texts:
        if held and len(t) > room:
            yield from short_sets(held, size)
            held, room = [], PIECE
        if len(t) > PIECE:
            yield long_shingle_set(t, size)
        else:
            held.append(t)
            room -= len(t) + 1
    if held:
        yield from short_sets(held, size)


def short_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    start, words = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    shingles, first = joined_words(words, size), 0
    for end in ends.tolist():
        yield np.unique(shingles[first : end - size + 1]) if end - first >= size else few_words(words[first:end], size)
        first = end


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


def salts(shingles: np.ndarray, blocks: int) -> np.ndarray:
    """The least shingle in each of equal parts of the hash range, 32 bits of it; 0 where there is none."""
    bounds = np.array([(1 << 64) // blocks * k for k in range(blocks)], _U)
    at = np.searchsorted(shingles, bounds)
    end = np.append(at[1:], len(shingles))
    return np.where(at < end, np.append(shingles, _U(0))[at], _U(0)).astype("<u4")


def majority(hashes: Iterable[np.ndarray], words: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the hashes; with several words each is of hashes mixed anew. No hashes: zero."""
    total, n = np.zeros(words * 64, np.int64), 0
    for h in hashes:
        h = h[:, None] if words == 1 else mix(h[:, None] + _U(_BASE) * np.arange(1, words + 1, dtype=_U))
        n += len(h)
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8), bitorder="little").view(_U).reshape(len(h), words * 8)
        for i in range(0, len(bits), 255):  # eight one-byte counters a word
            total += bits[i : i + 255].sum(0, dtype=_U).view(np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view("<u8") if n else np.zeros(words, "<u8")


def fingerprints(docs: DataFrame, size: int, ball: Ball, sets: float | None = None) -> DataFrame:
    """(doc_id, text_hash, fp binary) of whole texts; null text counts as empty.

    sets: None for fingerprints of all XXH64 shingles, repeats included; a similarity for fingerprints of distinct
    shingles, and for `short`, the shingles of texts of up to SHORT / sets of them, so all that are similar to a text of
    up to SHORT have theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, short = [], []
            texts = [t.as_py() for t in b.column(2)]
            if sets is None:
                fps = [majority(shingle_hashes(t, size), ball.words).tobytes() for t in texts]
            for s in shingle_sets(texts, size) if sets is not None else ():
                fp = majority(np.split(s, range(STEP, len(s), STEP)), ball.words) if len(s) else np.zeros(ball.words, "<u8")
                fps.append(fp.tobytes() + (salts(s, ball.blocks).tobytes() if ball.salted else b""))
                short.append(s.view(np.int64) if 0 < len(s) <= SHORT / sets else None)
            columns = {"doc_id": b.column(0), "text_hash": b.column(1), "fp": pa.array(fps, pa.binary())}
            if sets is not None:
                columns["short"] = pa.array(short, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("text_hash"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp binary" + (", short array<long>" if sets is not None else ""))


def short_links(distinct: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between (node, short) that may be similar: from the least node of a shingle to all others of its texts.

    Of n shingles the rarest n - ceil(least n) + 1 count: two sets of at least this similarity share one of them, and
    shingles that many texts have are hardly ever among them.
    """
    owners = written(distinct.where("short IS NOT NULL").select("node", F.size("short").alias("n"), F.explode("short").alias("shingle")))
    often = owners.groupBy("shingle").agg(F.count("*").alias("times"), F.min("node").alias("a")).where("times > 1")
    ranked = owners.join(often, "shingle", "left").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "shingle")))
    rare = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1)
    return rare.where("a < node").select("a", F.col("node").alias("b")).distinct()


def links(distinct: DataFrame, ball: Ball) -> DataFrame:
    """Edges (a, b) over the nodes of (node long, doc long, fp binary), distinct in fp, that lose no linked component.

    Owners of a variant are taken in the order of doc; each is linked to the first before it within the radius that is
    not itself linked to an earlier one.
    """
    n = distinct.count()
    total = max(1, n * ball.variants)
    bits = min(64, total.bit_length() + 7)
    per_run = max(1, RUN_BYTES // (8 * ball.variants))
    run_count = max(-(-n // per_run), min(SPREAD, n // BLOCK)) or 1
    few = max(0, (total // BUCKET_KEYS).bit_length())
    shift = _U(64 - bits)

    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fps, salt = ball.parsed(table.column("fp").to_pylist())
        return fps, ball.keys(fps, salt)

    def first(table: pa.Table) -> pa.Table:
        _, keys = hashes(table)
        h = keys.reshape(-1) >> shift
        h.sort()
        cuts = np.searchsorted(h, np.arange(1, 1 << few, dtype=_U) << _U(bits - few)) if few else []
        runs = [(k, pack_sorted(x)) for k, x in enumerate(np.split(h, cuts)) if len(x)]
        return pa.table({"bucket": pa.array([k for k, _ in runs], pa.int32()), "run": pa.array([table.column("run")[0].as_py()] * len(runs), pa.int32()), "data": pa.array([x for _, x in runs], pa.binary())})

    def owners(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"bucket": [], "keys": [], "at": [], "node": [], "doc": [], "fp": []}
        if left.num_rows and right.num_rows:
            fps, keys = hashes(left)
            known = np.sort(np.concatenate([unpack_sorted(x) for x in right.column("data").to_pylist()]))
            at = np.flatnonzero(among(keys.reshape(-1) >> shift, known))
            keys, at = keys.reshape(-1)[at], at // keys.shape[1]
            node, doc = left.column("node").to_numpy(), left.column("doc").to_numpy()
            of = (keys >> _U(64 - few)).astype(np.int64) if few else np.zeros(len(keys), np.int64)
            for k in np.unique(of).tolist():
                some = of == k
                rows, index = np.unique(at[some], return_inverse=True)
                for name, value in (("keys", keys[some]), ("at", index.astype("<u4")), ("node", node[rows]), ("doc", doc[rows]), ("fp", fps[rows])):
                    found[name].append(value.tobytes())
                found["bucket"].append(k)
        return pa.table(found, schema=pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in list(found)[1:])]))

    def meet(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        nodes = np.frombuffer(b"".join(columns["node"]), np.int64)
        docs = np.frombuffer(b"".join(columns["doc"]), np.int64)
        fps = np.frombuffer(b"".join(columns["fp"]), _U).reshape(-1, ball.words)
        bases = np.cumsum([0, *(len(x) // 8 for x in columns["node"])])
        at = np.concatenate([np.frombuffer(x, "<u4").astype(np.int64) + base for x, base in zip(columns["at"], bases, strict=False)])
        keys = np.frombuffer(b"".join(columns["keys"]), _U)
        by_doc = np.empty(len(nodes), np.int64)
        by_doc[np.lexsort((nodes, docs))] = np.arange(len(nodes))
        order = np.lexsort((by_doc[at], keys))
        keys, at = keys[order], at[order]
        edges, label = [], np.arange(len(nodes))
        while len(keys):
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            leader = at[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]
            far = np.bitwise_count(fps[leader] ^ fps[at]).sum(1, dtype=np.int64)
            near = far <= ball.radius
            hit = near & (leader != at)
            if ball.certain:
                edges.append(np.unique(np.stack([leader[hit], at[hit]]), axis=1))
                keys, at = keys[~near], at[~near]
                continue
            hit &= label[leader] != label[at]
            edges.append(joined(label, np.unique(np.stack([leader[hit], at[hit]]), axis=1)))
            # An owner near the leader may also be near one that is not: by the triangle only if that one is not too far.
            starts, group = np.flatnonzero(head), np.cumsum(head) - 1
            least = np.minimum.reduceat(np.where(near, np.int64(1) << 32, far), starts)[group]
            stay = ~near | (leader != at) & (far >= least - ball.radius)
            keys, at = keys[stay], at[stay]
            if len(keys):
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                sizes = np.diff(np.append(starts, len(keys)))
                open_ = np.repeat(np.minimum.reduceat(label[at], starts) != np.maximum.reduceat(label[at], starts), sizes)
                keys, at = keys[open_], at[open_]
        e = np.unique(np.concatenate(edges, axis=1), axis=1)
        return pa.table({"a": pa.array(nodes[e[0]]), "b": pa.array(nodes[e[1]])})

    runs = distinct.withColumn("run", F.pmod(F.xxhash64("node"), F.lit(run_count)).cast("int"))
    one = runs.groupBy("run").applyInArrow(tidy(first), "bucket int, run int, data binary")
    two = one.groupBy("bucket").applyInArrow(tidy(shared), "run int, data binary")
    three = runs.groupBy("run").cogroup(two.groupBy("run")).applyInArrow(tidy2(owners), "bucket int, keys binary, at binary, node binary, doc binary, fp binary")
    return three.groupBy("bucket").applyInArrow(tidy(meet), "a long, b long").distinct()


def grouped(docs: DataFrame, size: int, ball: Ball, verify: float | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): component_id is the least doc_id reachable over links. A row of docs, a row.

    verify: the least Jaccard similarity of the sets of shingles of two texts that are linked; None: links stand as the
    fingerprints give them. Rows with null doc_id are grouped too, but name no component. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fps = written(fingerprints(docs, size, ball, verify))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), "text_hash", *(["short"] if verify is not None else []))).alias("x")
    distinct = fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("doc"), first).withColumn("node", F.xxhash64("fp"))
    distinct = written(distinct.select("fp", "doc", "node", "x.id", "x.text_hash", "x.short") if verify is not None else distinct.select("fp", "doc", "node"))
    edges = links(distinct.select("fp", "doc", "node"), ball)
    if verify is not None:
        edges = written(edges.unionByName(short_links(distinct, verify)))
        edges = written(similar(docs, distinct, edges, size, verify))
    root = components(edges)
    named = distinct.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "root").select("fp", "root", F.when(F.col("component_id") < 2**63 - 1, F.col("component_id")).alias("component_id"))
    return fps.select("doc_id", "text_hash", "fp").join(named, "fp")


def joined(label: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The edges (2, n) that join two groups, taken one by one; label, the group of each node, is brought up to date."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    kept = []
    for n, (x, y) in enumerate(zip(label[edges[0]].tolist(), label[edges[1]].tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(n)
    if root:
        new = np.arange(len(label))
        for i in list(root):
            new[i] = find(i)
        label[:] = new[label]
    return edges[:, kept]


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): how many hashes two sets share."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left]).reshape(len(left), len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    of = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    hashes = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*hashes)
    at = [np.searchsorted(both, h) for h in hashes]
    found = [both[np.minimum(i, len(both) - 1)] == h if len(both) else np.zeros(len(h), bool) for i, h in zip(at, hashes, strict=True)]
    of, at = ([x[f] for x, f in zip(xs, found, strict=True)] for xs in (of, at))
    order = [np.argsort(i, kind="stable") for i in at]
    of, at = ([x[o] for x, o in zip(xs, order, strict=True)] for xs in (of, at))
    for first in range(0, len(both), COLUMNS):
        parts = []
        for x, i, rows in zip(of, at, (left, right), strict=True):
            a, b = np.searchsorted(i, [first, first + COLUMNS])
            part = np.zeros((len(rows), min(COLUMNS, len(both) - first)), np.float32)
            part[x[a:b], i[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def compared(table: pa.Table, least: float) -> pa.Table:
    """Edges that join the groups (own) of a table's families by pairs of sets of at least this similarity.

    side 0: a row is compared with all of its family; sides 1 and 2: with those of the other side.
    """
    out: list[np.ndarray] = []
    if table.num_rows:
        family, node, own, side = (table.column(c).to_numpy() for c in ("family", "node", "own", "side"))
        sets = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
        order = np.argsort(family, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            one, two = (rows, rows) if not side[rows].any() else (rows[side[rows] == 1], rows[side[rows] == 2])
            if not len(one) or not len(two):
                continue
            both = common([sets[i] for i in one], [sets[i] for i in two])
            n, m = (np.array([len(sets[i]) for i in x]) for x in (one, two))
            x, y = np.nonzero((both >= least * (n[:, None] + m[None, :] - both)) & (own[one][:, None] != own[two][None, :]))
            _, label = np.unique(own[rows], return_inverse=True)
            place = np.empty(len(own), np.int64)
            place[rows] = np.arange(len(rows))
            out.append(rows[joined(label, place[np.stack([one[x], two[y]])])])
    e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(node[e[0]] if table.num_rows else [], pa.int64()), "b": pa.array(node[e[1]] if table.num_rows else [], pa.int64())})


def similar(docs: DataFrame, distinct: DataFrame, edges: DataFrame, size: int, least: float) -> DataFrame:
    """Edges between texts whose sets of shingles have at least this Jaccard similarity; of a fingerprint, its first text.

    edges only name candidates. What they connect is a family, and whatever is similar in a family gets connected: a
    family of up to BLOCK texts is compared pair by pair. In a larger one the edges are verified first; then blocks of
    its texts are compared with each other, but not those of one group that is connected already.
    """
    family = written(components(edges).withColumnRenamed("root", "family"))
    member = written(family.unionByName(family.select(F.col("family").alias("node"), "family").distinct()))
    of = member.join(distinct.select("node", "id", "text_hash"), "node").select("node", F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("text_hash"), text_bytes().alias("text"))
    texts = rows.join(of, rows["doc_id"].eqNullSafe(of["__id"]) & (rows["text_hash"] == of["__hash"])).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.tobytes() for s in shingle_sets([t.as_py() for t in b.column(1)], size)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "hashes"])
            trim()

    found = written(texts.mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"]))
    sizes = written(member.groupBy("family").agg(F.count("*").alias("n")))
    parts = max(1, member.count() // BLOCK)
    task = F.pmod(F.xxhash64("family"), F.lit(parts))
    small = member.join(sizes.where(F.col("n") <= BLOCK), "family").select(task.alias("task"), "family", "node", F.col("node").alias("own"), F.lit(0).alias("side"))
    large = sizes.where(F.col("n") > BLOCK).select("family")
    stars = None
    if large.limit(1).count():
        stars = written(verified(edges.join(member.join(large, "family", "left_semi").select(F.col("node").alias("a")), "a", "left_semi"), found, least))
        inside = member.join(large, "family", "left_semi").join(components(stars), "node", "left").select("family", "node", F.coalesce("root", "node").alias("own"))
        small = small.unionByName(block_pairs(written(inside)))
    pairs = small.join(found, "node").select("task", "family", "node", "own", "side", "hashes")
    links_ = pairs.groupBy("task").applyInArrow(tidy(lambda t: compared(t, least)), "a long, b long")
    return links_ if stars is None else links_.unionByName(stars)


def block_pairs(inside: DataFrame) -> DataFrame:
    """(task, family, node, own, side): all pairs of blocks of (family, node, own) but those within one own.

    An own of BLOCK nodes or more has blocks of its own, so that they need not meet each other; others share blocks.
    """
    owns = inside.groupBy("family", "own").agg(F.count("*").alias("c"))
    rest = owns.where(F.col("c") < BLOCK).groupBy("family").agg(F.sum("c").alias("s"))
    owns = owns.join(rest, "family", "left").withColumn("lone", F.when(F.col("c") >= BLOCK, F.col("own")))
    cuts = F.ceil(F.when(F.col("lone").isNotNull(), F.col("c")).otherwise(F.col("s")) / F.lit(BLOCK)).cast("long")
    owns = owns.select("family", "own", "lone", cuts.alias("cuts"))
    number = F.pmod(F.xxhash64(F.when(F.col("lone").isNotNull(), F.col("node")).otherwise(F.col("own"))), F.col("cuts"))
    placed = written(inside.join(owns, ["family", "own"]).withColumn("number", number).withColumn("block", F.xxhash64("family", "lone", "number")))
    blocks = placed.select("family", "lone", "block").distinct()
    p, q = (blocks.select("family", F.col("lone").alias(f"lone_{x}"), F.col("block").alias(x)) for x in "pq")
    pairs = p.join(q, "family").where("p <= q AND (lone_p IS NULL OR lone_q IS NULL OR lone_p <> lone_q)")
    pairs = pairs.withColumn("task", F.xxhash64("family", "p", "q"))
    sides = F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("p").alias("block"), F.lit(1).alias("side")), F.struct(F.col("q").alias("block"), F.lit(2).alias("side")))
    )
    sides = pairs.select("family", "task", F.explode(sides).alias("x")).select("family", "task", "x.block", "x.side")
    return placed.join(sides, ["family", "block"]).select("task", "family", "node", "own", "side")


def verified(edges: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The edges whose sets (node, hashes) have at least this Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= least * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    pairs = edges.join(found.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    pairs = pairs.join(found.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles of all documents, and their components at up to four differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    value = F.lower(F.hex("fp"))
    df = grouped(docs, 4, EXACT)
    # The bytes are little-endian; the digits name the number.
    digits = F.concat(*(F.substring(value, i, 2) for i in range(15, 0, -2)))
    return df.select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar texts, that of the least doc_id; all columns kept.

    Candidates are fingerprints of distinct shingles that share a variant and its salt, and short texts that share one of
    their rarest shingles; a link stands if the sets of shingles have at least this similarity. Equal rows count as copies; rows of one doc_id with texts that are not similar all stay.
    Null doc_ids come after all others.
    """
    groups = written(grouped(docs, size, SIMILAR, similarity).select("doc_id", "text_hash", "root"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("__id"), F.col("x.text_hash").alias("__hash"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text_bytes()).alias("__hash"))
    kept = rows.join(first, rows["__id"].eqNullSafe(first["__id"]) & (rows["__hash"] == first["__hash"]), "left_semi")
    if groups.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__id", "__hash"])
    return kept.select("__row.*")
