"""Operator 8, suffix-array dedup by a common-prefix-aware distributed merge sort.

Which bytes lie in a string of LENGTH bytes that also starts in a document before? Any window of LENGTH bytes holds
substrings of K bytes; the one with the least hash is its anchor, the same wherever the window's bytes occur. So a
sparse suffix array does, of the suffixes that start at anchors:

1. Hashes of anchors are exchanged as sorted runs; those that occur in one document alone can't be in a repeat.
2. For the others each group of documents makes a run of suffixes (from the anchor on, as far as its windows reach),
   sorted and front-coded: the length of the prefix shared with the one before, and the rest. The bytes before the
   anchor, which its windows need too, go along. Equal contexts in a run are sent once, with the least doc_id; the
   others are known repeats.
3. Runs are merged by a loser tree that keeps the common prefix of each loser with the winner that beat it, so no
   prefix that is known to agree is compared again. Common prefixes of neighbours give the classes of windows' right
   parts; with their left parts, the least doc_id of each window.
4. What is covered comes back to the documents as intervals.

An anchor that over HOT documents have (a line that most pages share, in differing surroundings) would make one bucket
as long as the corpus. Its windows are taken apart instead: each group sends the hashes of their LENGTH bytes, each once
with the least doc_id, to buckets by hash, and gets back the least doc_id of all groups.

Copies of whole texts are found first, by hash, and take no part but for the first of them. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_bytes, tidy, tidy2
from .runs import among, mix, pack_sorted, repeated, unpack_sorted

_U = np.uint64
LENGTH, K = 50, 24
W = LENGTH - K + 1
#: Bytes of text worked on at once; documents and bytes of a group; anchors and suffixes that meet in a bucket, about.
STEP, GROUP_ROWS, GROUP_BYTES, BUCKET_ANCHORS, BUCKET_BYTES = 1 << 18, 1000, 8 << 20, 1 << 20, 4 << 20
#: Documents (by estimate, at most twice as many) from which an anchor's windows are dealt by themselves.
HOT = 8192
#: Tasks that buckets are dealt over, up to which there are as many as buckets.
TASKS = 4096
#: Kinds of what goes along with a group's rows: copies, anchors that recur, intervals, hot anchors, hot windows.
COPY, ANCHORS, SPANS, HOT_ANCHORS, HOT_WINDOWS = range(5)
_LOW = _U((1 << 24) - 1)
NO_ID = 2**63 - 1


def chunks(texts: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes), about STEP bytes at a time. Longer texts are cut so that each window is in one part."""
    out, size = [], 0
    for row, t in texts:
        for first in range(0, max(1, len(t) - LENGTH + 1), STEP):
            out.append((row, first, t[first : first + STEP + LENGTH - 1]))
            size += len(out[-1][2])
            if size >= STEP:
                yield out
                out, size = [], 0
    if out:
        yield out


def substring_hashes(b: np.ndarray, size: int = K) -> np.ndarray:
    """The mixed hash of each `size` bytes, by doubling."""
    h, power, length = b.astype(_U) + _U(1), _U(0x9E3779B97F4A7C15), 1
    total, done, n = None, 0, len(b) - size + 1
    while True:
        if size & length:
            part = h[done : done + n]
            total = part.copy() if total is None else total * power + part
            done += length
        if length * 2 > size:
            return mix(total)
        h = h[:-length] * power + h[length:]
        power, length = power * power, length * 2


def anchored(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first and last window, anchor (positions in the joined bytes), its hash, part; the bytes."""
    buffer = np.frombuffer(b"".join(x for _, _, x in parts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(buffer) < LENGTH:
        return none, none, none, none.astype(_U), none, buffer
    with np.errstate(over="ignore"):
        h = substring_hashes(buffer)
    least = (h & ~_LOW) | np.arange(len(h), dtype=_U)  # equal hashes: the first
    span = 1
    while span * 2 <= W:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < W:
        least = np.minimum(least[: len(least) - (W - span)], least[W - span :])
    at = (least & _LOW).astype(np.int64)
    inside, starts = in_parts(parts)
    change = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    anchor = at[first]
    # An anchor's hash is the least of many; mixed anew, hashes are spread evenly over buckets.
    return first, last, anchor, mix(h[anchor]), np.searchsorted(starts, first, "right") - 1, buffer


def in_parts(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of the joined bytes, whether it lies in one part; where each part starts."""
    sizes = np.array([len(x) for _, _, x in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    wide = sizes >= LENGTH
    mark = np.zeros(max(0, int(sizes.sum()) - LENGTH + 1) + 1, np.int32)
    mark[starts[wide]] += 1
    mark[starts[wide] + sizes[wide] - LENGTH + 1] -= 1
    return np.cumsum(mark)[:-1] > 0, starts


def tallied(hashes: np.ndarray) -> np.ndarray:
    """Ascending hashes with as many copies as documents, cut to 1 + ceil(log2(documents)) copies each."""
    values, counts = np.unique(hashes, return_counts=True)
    return np.repeat(values, 1 + np.ceil(np.log2(counts)).astype(np.int64))


def recurring(table: pa.Table, hot: int) -> pa.Table:
    """Of a bucket's tallied runs (run, data), each run's anchors that more than one document has: those of `hot` documents apart."""
    names, blobs = table.column("run").to_pylist(), table.column("data").to_pylist()
    parts = []
    for x in blobs:
        values, counts = np.unique(unpack_sorted(x), return_counts=True)
        parts.append(values << _U(8) | counts.astype(_U))  # hashes have at most 56 bits
    every = np.concatenate(parts)
    del parts
    every.sort()
    head = np.flatnonzero(np.concatenate([[True], (every[1:] ^ every[:-1]) >> _U(8) != 0]))
    documents = np.add.reduceat(np.int64(1) << ((every & _U(255)).astype(np.int8) - 1).astype(np.int64), head)
    every = every[head] >> _U(8)
    cool, warm = every[(documents > 1) & (documents < hot)], every[documents >= hot]
    del every, documents, head
    out: dict[str, list] = {"run": [], "kind": [], "data": []}
    for run, x in zip(names, blobs, strict=True):
        v = np.unique(unpack_sorted(x))
        for kind, known in ((ANCHORS, cool), (HOT_ANCHORS, warm)):
            if len(found := v[among(v, known)]):
                for c, x in (("run", run), ("kind", kind), ("data", pack_sorted(found))):
                    out[c].append(x)
    return pa.table(out, schema=pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())]))


def window_blob(keys: np.ndarray, least: np.ndarray) -> bytes:
    packed = pack_sorted(keys)
    return len(packed).to_bytes(8, "little") + packed + least.astype("<i8").tobytes()


def window_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 8 + int.from_bytes(blob[:8], "little")
    return unpack_sorted(blob[8:end]), np.frombuffer(blob, "<i8", offset=end)


def hot_runs(keys: np.ndarray, docs: np.ndarray, few: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of a group's hot windows: ascending keys, twice if more than one document has them, and the least doc_id of each."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = np.maximum.reduceat(docs, head) > docs[head]
    values, least = keys[head], docs[head]
    of = (values >> _U(64 - few)).astype(np.int64) if few else np.zeros(len(values), np.int64)
    for some in np.split(np.arange(len(values)), np.flatnonzero(np.diff(of)) + 1):
        yield int(of[some[0]]), window_blob(np.repeat(values[some], 1 + several[some]), least[some])


def least_documents(table: pa.Table) -> pa.Table:
    """Of a bucket's hot windows, each group's that more than one document has, with the least doc_id of all groups."""
    runs = [window_keys(x) for x in table.column("rests").to_pylist()]
    values = [np.unique(k) for k, _ in runs]
    every, least = np.concatenate([k for k, _ in runs]), np.concatenate(values)
    twice = repeated(np.sort(every))
    order = np.argsort(least, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(least[order]) != 0]))
    docs = np.minimum.reduceat(np.concatenate([d for _, d in runs])[order], head)
    known = least[order][head]
    out: dict[str, list] = {"group": [], "kind": [], "data": []}
    for group, v in zip(table.column("group").to_pylist(), values, strict=True):
        if len(found := v[among(v, twice)]):
            out["group"].append(group)
            out["kind"].append(HOT_WINDOWS)
            out["data"].append(window_blob(found, docs[np.searchsorted(known, found)]))
    return pa.table(out, schema=TOLD)


def hot_spans(rows: list[tuple[int, bytes]], docs: np.ndarray, blobs: list[bytes]) -> dict[int, list[np.ndarray]]:
    """By row the hot windows that a smaller doc_id has too, as (first, end)."""
    out: dict[int, list[np.ndarray]] = {}
    if not blobs:
        return out
    found = [window_keys(x) for x in blobs]
    keys, least = np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])
    order = np.argsort(keys)
    keys, least = keys[order], least[order]
    for parts in chunks(rows):
        buffer = np.frombuffer(b"".join(x for _, _, x in parts), np.uint8)
        if len(buffer) < LENGTH:
            continue
        inside, starts = in_parts(parts)
        with np.errstate(over="ignore"):
            h = substring_hashes(buffer, LENGTH)
        at = np.flatnonzero(among(h, keys) & inside)
        part = np.searchsorted(starts, at, "right") - 1
        row = np.array([p[0] for p in parts], np.int64)[part]
        later = docs[row] > least[np.searchsorted(keys, h[at])]
        first = (at - starts[part] + np.array([p[1] for p in parts], np.int64)[part])[later]
        row = row[later]
        for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
            if len(some):
                out.setdefault(int(row[some[0]]), []).append(np.stack([first[some], first[some] + LENGTH], axis=1))
    return out


def texts_of(table: pa.Table, side: pa.Table) -> list[tuple[int, bytes]]:
    """(row, text) of those long enough that are no copies of an earlier document's text."""
    copies = {(d, h) for d, h, kind in zip(side.column("doc_id").to_pylist(), side.column("text_hash").to_pylist(), side.column("kind").to_pylist(), strict=True) if kind == COPY}
    rows = zip(table.column("doc_id").to_pylist(), table.column("text_hash").to_pylist(), table.column("text"), strict=True)
    return [(i, t.as_py()) for i, (d, h, t) in enumerate(rows) if (d, h) not in copies]


def front_coded(b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Of sorted strings (rows of b, padded with zeros): the prefix shared with the one before, and the rests together."""
    width = b.shape[1]
    differ = b[1:] != b[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1]))])[: len(b)]
    column = np.arange(width)
    return lcp.astype(np.uint8), b[(column >= lcp[:, None]) & (column < sizes[:, None])].tobytes()


def decoded(lcp: bytes, sizes: bytes, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for shared_size, size in zip(lcp, sizes, strict=True):
        end = at + size - shared_size
        before = before[:shared_size] + rests[at:end]
        out.append(before)
        at = end
    return out


def merge(runs: list[list[bytes]], lcps: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs by a loser tree: the run of each string in order, and its common prefix with the one before.

    A node keeps the loser's run and the common prefix of its string with the winner's. Of two strings that share
    different lengths with the last winner, the one that shares more is less; only at a tie are bytes compared, from
    there on, and the loser keeps how far they agree.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    position = [0] * k
    loser, agree = [0] * k, [0] * k

    def contest(x: int, hx: int, y: int, hy: int) -> tuple[int, int, int, int]:
        """Winner and its prefix with the last winner of all, loser and its prefix with its winner. -1: a run at its end."""
        if hx != hy:
            return (x, hx, y, hy) if hx > hy else (y, hy, x, hx)
        if hx < 0:
            return x, hx, y, hy
        a, b, h = head[x], head[y], hx
        end = min(len(a), len(b))
        while h < end and a[h] == b[h]:
            h += 1
        if h == len(a) or h < len(b) and a[h] < b[h]:
            return x, hx, y, h
        return y, hy, x, h

    winners = [(i, 0 if head[i] is not None else -1) for i in range(k)]
    for level in range(k.bit_length() - 1):
        base = k >> level + 1
        nxt = []
        for i in range(0, len(winners), 2):
            w, hw, lost, hl = contest(*winners[i], *winners[i + 1])
            loser[base + i // 2], agree[base + i // 2] = lost, hl
            nxt.append((w, hw))
        winners = nxt
    w, hw = winners[0]
    order, shares = [], []
    while hw >= 0:
        order.append(w)
        shares.append(hw)
        position[w] = at = position[w] + 1
        run = runs[w]
        if at < len(run):
            head[w], h = run[at], lcps[w][at]
        else:
            head[w], h = None, -1
        x, node = w, k + w >> 1
        while node:
            hy = agree[node]
            if h < hy:
                y = loser[node]
                loser[node], agree[node] = x, h
                x, h = y, hy
            elif h == hy and h >= 0:
                a, b, y, m = head[x], head[loser[node]], loser[node], h
                end = min(len(a), len(b))
                while m < end and a[m] == b[m]:
                    m += 1
                if m == len(a) or m < len(b) and a[m] < b[m]:
                    agree[node] = m
                else:
                    loser[node], agree[node] = x, m
                    x = y
            node >>= 1
        w, hw = x, h
    return order, shares


RECORDS = ("doc", "text_hash", "at", "right", "left", "sizes", "lcp", "rests", "lefts")
TOLD = pa.schema([("group", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
SUFFIX_SCHEMA = "bucket int, group int, " + ", ".join(f"{c} binary" for c in RECORDS) + ", known binary"


def suffix_runs(table: pa.Table, side: pa.Table, shift: int, few: int) -> pa.Table:
    """A group's suffixes at anchors that occur in other documents, a sorted front-coded run a bucket; and known repeats.

    Buckets of hot windows have numbers below zero, and the windows as `rests`.
    """
    rows = texts_of(table, side)
    docs, hashes = table.column("doc_id").to_numpy(), table.column("text_hash").to_numpy()
    told = list(zip(side.column("data").to_pylist(), side.column("kind").to_pylist(), strict=True))
    known, hot = (np.sort(np.concatenate([*(unpack_sorted(x) for x, kind in told if kind == k), np.zeros(0, _U)])) for k in (ANCHORS, HOT_ANCHORS))
    windows: list[tuple[np.ndarray, np.ndarray]] = []
    found: dict[str, list] = {c: [] for c in ("row", "at", "right", "left", "hash", "r", "l")}
    for parts in chunks(rows):
        first, last, anchor, h, part, buffer = anchored(parts)
        if len(hot) and (keep := among(h >> _U(shift), hot)).any():
            spans = last[keep] - first[keep] + 1
            at = np.repeat(first[keep] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
            with np.errstate(over="ignore"):
                windows.append((substring_hashes(buffer, LENGTH)[at], docs[np.array([p[0] for p in parts], np.int64)[np.repeat(part[keep], spans)]]))
        keep = among(h >> _U(shift), known)
        first, last, anchor, h, part = (x[keep] for x in (first, last, anchor, h, part))
        starts = np.concatenate([[0], np.cumsum([len(x) for _, _, x in parts])])
        right, left = last + LENGTH - anchor, anchor - first
        padded = np.concatenate([buffer, np.zeros(LENGTH, np.uint8)])
        r = padded[anchor[:, None] + np.arange(LENGTH)]
        r[np.arange(LENGTH) >= right[:, None]] = 0
        lead = np.concatenate([np.zeros(W, np.uint8), buffer])
        back = lead[anchor[:, None] + W - 1 - np.arange(W - 1)]  # the byte before the anchor first
        back[np.arange(W - 1) >= left[:, None]] = 0
        found["row"].append(np.array([p[0] for p in parts], np.int64)[part])
        found["at"].append(anchor - starts[part] + np.array([p[1] for p in parts], np.int64)[part])
        for c, x in (("right", right), ("left", left), ("hash", h), ("r", r), ("l", back)):
            found[c].append(x)
    out: dict[str, list] = {c: [] for c in ("bucket", *RECORDS, "known")}
    if found["row"]:
        f = {c: np.concatenate(x) for c, x in found.items()}
        of = (f["hash"] >> _U(64 - few)).astype(np.int64) if few else np.zeros(len(f["hash"]), np.int64)
        order = np.argsort(of, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(some):
                out["bucket"].append(int(of[some[0]]))
                for c, x in coded({c: v[some] for c, v in f.items()}, docs, hashes).items():
                    out[c].append(x)
    if windows:
        for bucket, blob in hot_runs(*map(np.concatenate, zip(*windows, strict=True)), few):
            for c in out:
                out[c].append(b"")
            out["bucket"][-1], out["rests"][-1] = -1 - bucket, blob
    types = [("bucket", pa.int32()), ("group", pa.int32()), *((c, pa.binary()) for c in (*RECORDS, "known"))]
    group = [int(table.column("group")[0].as_py()) if table.num_rows else 0] * len(out["bucket"])
    return pa.table({"bucket": out["bucket"], "group": group, **{c: out[c] for c in (*RECORDS, "known")}}, schema=pa.schema(types))


def intervals(docs: np.ndarray, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([docs, hashes, first, last]).astype("<i8").tobytes()


def coded(f: dict[str, np.ndarray], docs: np.ndarray, hashes: np.ndarray) -> dict[str, bytes]:
    doc, text_hash = docs[f["row"]], hashes[f["row"]]
    with np.errstate(over="ignore"):
        lead = np.zeros(len(doc), _U)
        for k in range(W - 1):
            lead = mix(lead * _U(31) + f["l"][:, k] + _U(1))
        lead = mix(lead + f["left"].astype(_U) * _U(64) + f["right"].astype(_U))
    strings = np.ascontiguousarray(f["r"]).view(f"V{LENGTH}").reshape(-1)
    keys = f["r"].view(">u8") if LENGTH % 8 == 0 else np.concatenate([f["r"], np.zeros((len(doc), -LENGTH % 8), np.uint8)], axis=1).view(">u8")
    order = np.lexsort((f["at"], doc, lead, *(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1))))
    same = np.concatenate([[False], (strings[order][1:] == strings[order][:-1]) & (lead[order][1:] == lead[order][:-1])]) if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    repeat = doc[order] > doc[order][head]  # the same context is in this run with a smaller doc_id
    gone, order = order[repeat], order[~repeat]
    lcp, rests = front_coded(f["r"][order], f["right"][order])
    left = f["left"][order]
    return {
        "doc": doc[order].astype("<i8").tobytes(), "text_hash": text_hash[order].astype("<i8").tobytes(), "at": f["at"][order].astype("<i8").tobytes(),
        "right": f["right"][order].astype(np.uint8).tobytes(), "left": left.astype(np.uint8).tobytes(), "sizes": f["right"][order].astype(np.uint8).tobytes(), "lcp": lcp.tobytes(), "rests": rests,
        "lefts": f["l"][order][np.arange(W - 1) < left[:, None]].tobytes(),
        "known": intervals(doc[gone], text_hash[gone], f["at"][gone] - f["left"][gone], f["at"][gone] + f["right"][gone]),
    }


def covered(table: pa.Table) -> pa.Table:
    """Merges a bucket's runs and tells each group what is covered: doc_id, text hash, first byte, end, as a blob."""
    if table.column("bucket")[0].as_py() < 0:
        return least_documents(table)
    c = table.to_pydict()
    runs = [decoded(*x) for x in zip(c["lcp"], c["sizes"], c["rests"], strict=True)]
    order, shares = merge(runs, [list(x) for x in c["lcp"]])
    bases = np.cumsum([0, *map(len, runs)])
    of = np.array(order, np.int64)
    step = np.empty(len(of), np.int64)  # the k-th string of a run, in the order of the merge
    by = np.argsort(of, kind="stable")
    step[by] = np.arange(len(of))  # runs lie one after another, so this is base + k
    joined = {x: np.frombuffer(b"".join(c[x]), t)[step] for x, t in (("doc", "<i8"), ("text_hash", "<i8"), ("at", "<i8"), ("right", np.uint8), ("left", np.uint8))}
    doc, right, left = joined["doc"], joined["right"].astype(np.int64), joined["left"].astype(np.int64)
    lengths = np.frombuffer(b"".join(c["left"]), np.uint8)
    back = np.zeros((len(of), W - 1), np.uint8)
    back[np.arange(W - 1) < lengths[:, None]] = np.frombuffer(b"".join(c["lefts"]), np.uint8)
    back = back[step]
    share = np.array(shares, np.int64)
    low, high = np.full(len(of), W), np.full(len(of), -1)
    lead = np.zeros(len(of), _U)
    with np.errstate(over="ignore"):
        for o in range(W):  # windows that start o bytes before their anchor
            if o:
                lead = mix(lead * _U(31) + back[:, o - 1] + _U(1))
            some = np.flatnonzero((left >= o) & (right >= LENGTH - o))
            # A window's right part: as far as the common prefixes go. A run of one is no repeat.
            kind = np.cumsum(share < LENGTH - o)[some]
            pair = mix(kind.astype(_U) * _U(0x9E3779B97F4A7C15) ^ lead[some])
            edge = kind[1:] == kind[:-1]
            alone = ~(np.concatenate([[False], edge]) | np.concatenate([edge, [False]]))[: len(kind)]
            some, pair = some[~alone], pair[~alone]
            if not len(some):
                continue
            at = np.argsort(pair)
            head = np.flatnonzero(np.concatenate([[True], pair[at][1:] != pair[at][:-1]]))
            first = np.minimum.reduceat(doc[some[at]], head)
            later = np.empty(len(some), bool)
            later[at] = doc[some[at]] > np.repeat(first, np.diff(np.append(head, len(at))))
            hit = some[later]
            low[hit] = np.minimum(low[hit], o)
            high[hit] = np.maximum(high[hit], o)
    hit = high >= 0
    first, last = joined["at"] - high, joined["at"] - low + LENGTH
    data = []
    for k, known in enumerate(c["known"]):
        own = hit & (of == k)
        data.append(known)
        data.append(intervals(doc[own], joined["text_hash"][own], first[own], last[own]))
    groups = np.repeat(c["group"], 2)
    keep = [i for i, x in enumerate(data) if x]
    return pa.table({"group": pa.array(groups[keep], pa.int32()), "kind": pa.array([SPANS] * len(keep), pa.int32()), "data": pa.array([data[i] for i in keep], pa.binary())})


def united(spans: np.ndarray) -> np.ndarray:
    """Rows of (first, end), sorted and joined where they overlap or touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    at = np.flatnonzero(head)
    return np.stack([spans[at, 0], end[np.append(at[1:], len(spans)) - 1]], axis=1)


def spans_of(docs: DataFrame, extra: list[str], cut, schema):
    """Runs `cut` on each group's rows with their repeated spans: cut(table, list of (n, 2) arrays) -> table.

    docs: doc_id, text and the columns `extra`. Null ids are taken as the largest.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes().alias("text"), *extra)
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    facts = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count, size = facts[0], facts[1] or 0
    groups = max(1, -(-count // GROUP_ROWS), -(-size // GROUP_BYTES))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups)).cast("int"))
    # Copies: rows whose text is in a document before them, by two hashes and the size.
    keys = rows.select("doc_id", "text_hash", "group", F.md5("text").alias("md5"), F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    firsts = keys.groupBy("md5", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = keys.join(firsts, ["md5", "size"]).where("doc_id > first").select("group", "doc_id", "text_hash")
    none = F.lit(None).cast("binary").alias("data")
    side = copies.select(*(F.col(c).alias(c) for c in ("group", "doc_id", "text_hash"))).select("group", F.lit(COPY).alias("kind"), "doc_id", "text_hash", none)

    anchors = max(1, size * 2 // (W + 1))
    bits = min(56, anchors.bit_length() + 16)
    few, spread = max(0, (anchors // BUCKET_ANCHORS).bit_length()), max(3, (size // BUCKET_BYTES).bit_length())
    shift = 64 - bits

    def first(table: pa.Table, side: pa.Table) -> pa.Table:
        found = []
        for parts in chunks(texts_of(table, side)):
            _, _, _, h, part, _ = anchored(parts)
            row = np.array([p[0] for p in parts], _U)[part]
            if bits <= 40:
                found.append(np.unique((h >> _U(shift)) << _U(24) | row))
            else:
                pairs = np.stack([h >> _U(shift), row])
                found.append(np.unique(pairs, axis=1) if pairs.size else pairs)
        if bits <= 40:
            h = np.unique(np.concatenate([*found, np.zeros(0, _U)])) >> _U(24)
        else:
            h = np.sort(np.concatenate([*(x[0] for x in found), np.zeros(0, _U)]))
        h = tallied(h)
        cuts = np.searchsorted(h, np.arange(1, 1 << few, dtype=_U) << _U(bits - few)) if few else []
        runs = [(k, pack_sorted(x)) for k, x in enumerate(np.split(h, cuts)) if len(x)]
        group = table.column("group")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([k for k, _ in runs], pa.int32()), "run": pa.array([group] * len(runs), pa.int32()), "data": pa.array([x for _, x in runs], pa.binary())})

    by_group = rows.groupBy("group")
    one = by_group.cogroup(side.groupBy("group")).applyInArrow(tidy2(first), "bucket int, run int, data binary")
    hot = HOT
    two = one.groupBy("bucket").applyInArrow(tidy(lambda t: recurring(t, hot)), "run int, kind int, data binary")
    asked = side.unionByName(two.select(F.col("run").alias("group"), "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), "data"))
    three = by_group.cogroup(asked.groupBy("group")).applyInArrow(tidy2(lambda t, s: suffix_runs(t, s, shift, spread)), SUFFIX_SCHEMA)
    # A task for each few buckets: so many partitions that buckets don't pile up in one of them.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << spread, TASKS))
    four = three.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(tidy(covered), "group int, kind int, data binary")
    told = side.unionByName(four.select("group", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_hash"), "data"))

    def last(table: pa.Table, side: pa.Table) -> pa.Table:
        kinds = side.column("kind").to_pylist()
        copies = {(d, h) for d, h, k in zip(side.column("doc_id").to_pylist(), side.column("text_hash").to_pylist(), kinds, strict=True) if k == COPY}
        told = list(zip(side.column("data").to_pylist(), kinds, strict=True))
        blobs = [np.frombuffer(x, "<i8").reshape(4, -1) for x, k in told if k == SPANS]
        hot = hot_spans(texts_of(table, side), table.column("doc_id").to_numpy(), [x for x, k in told if k == HOT_WINDOWS])
        every = np.concatenate([*blobs, np.zeros((4, 0), np.int64)], axis=1)
        every = every[:, np.lexsort((every[1], every[0]))]
        edge = np.flatnonzero((np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)) + 1
        by = {(int(x[0, 0]), int(x[1, 0])): x[2:].T for x in np.split(every, edge, axis=1) if x.shape[1]}
        spans = []
        for i, (d, h, t) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text_hash").to_pylist(), table.column("text"), strict=True)):
            if (d, h) in copies:
                spans.append(np.array([[0, len(t.as_buffer())]]))
            elif found := [*([by[d, h]] if (d, h) in by else []), *hot.get(i, [])]:
                spans.append(united(np.concatenate(found)))
            else:
                spans.append(np.zeros((0, 2), np.int64))
        return cut(table, spans)

    return by_group.cogroup(told.groupBy("group")).applyInArrow(tidy2(last), schema)


def kept(text: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for first, end in spans.tolist():
        out.append(text[at:first])
        at = end
    return b"".join([*out, text[at:]])


def ids_back(table: pa.Table) -> pa.Array:
    return pa.array([None if x == NO_ID else x for x in table.column("doc_id").to_pylist()], pa.int64())


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the bytes covered by 50-byte strings that also start in a document with a smaller doc_id, and what is left.

    Null text: empty. Null doc_ids count as larger than all others. Rows that repeat a doc_id don't cover each other.
    """

    def cut(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        texts = [t.as_py() for t in table.column("text")]
        removed = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
        sums = [hashlib.sha256(kept(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)]
        return pa.table({"doc_id": ids_back(table), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(map(len, spans), pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans_of(docs, [], cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def on_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without the parts of characters at their ends, so that what is left is UTF-8."""
    out = []
    for first, end in spans.tolist():
        while first < end and text[first] & 0xC0 == 0x80:
            first += 1
        while end > first and end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        if first < end:
            out.append((first, end))
    return np.array(out, np.int64).reshape(-1, 2)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated 50-byte strings cut from their texts, all columns kept; n_chars, if there, counts what is left.

    The first occurrence, by doc_id, stays. A document is never dropped, even if nothing is left of its text; null
    texts stay null.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != "text"), F.col("text").isNull().alias("__null")).alias("__row")
    kind = docs.select(row, F.col("text").cast("binary").alias("__text")).schema

    def cut(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        texts = [t.as_py() for t in table.column("text")]
        left = [kept(t, on_characters(t, s)) if len(s) else t for t, s in zip(texts, spans, strict=True)]
        return pa.table({"__row": table.column("__row"), "__text": pa.array(left, pa.binary())})

    df = spans_of(docs, [row], cut, kind)
    text = F.when(~F.col("__row.__null"), F.col("__text").cast("string"))
    back = {"text": text} | ({"n_chars": F.when(F.col("__row.n_chars").isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return df.select(*(back.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names))
