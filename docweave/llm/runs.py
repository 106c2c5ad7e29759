"""Sorted runs of 64-bit keys as bytes: what the exchanges of this package ship instead of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending keys as differences of two, four or eight bytes, whichever takes least; repeats are kept.

    A difference that doesn't fit is led by fillers, the largest word, each of which adds its value and is no key.
    """
    n = len(values)
    if not n:
        return b""
    values = values.astype(_U, copy=False)
    gaps = np.diff(values)
    best, width = None, 8
    for w in (2, 4):
        over = gaps // _U(256**w - 1)
        size = w * (n + int(over.sum()))
        if best is None or size < best:
            best, width = size, w
    head = values[:1].astype("<u8").tobytes() + bytes([width])
    if width == 8 or best >= 8 * n:
        return values[:1].astype("<u8").tobytes() + bytes([8]) + gaps.astype("<u8").tobytes()
    most = 256**width - 1
    over = (gaps // _U(most)).astype(np.int64)
    if not over.any():
        return head + gaps.astype(f"<u{width}").tobytes()
    out = np.full(len(gaps) + int(over.sum()), most, f"<u{width}")
    out[np.cumsum(over + 1) - 1] = (gaps - over.astype(_U) * _U(most)).astype(f"<u{width}")
    return head + out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, _U)
    first, width = np.frombuffer(data, "<u8", 1)[0], data[8]
    steps = np.frombuffer(data, f"<u{width}", offset=9)
    out = np.empty(len(steps) + 1, _U)
    out[0] = first
    np.cumsum(steps, dtype=_U, out=out[1:])
    out[1:] += first
    if width < 8 and len(steps) and (filler := steps == 256**width - 1).any():
        out = out[np.concatenate([[True], ~filler])]
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """The distinct values that an ascending array has more than once."""
    same = values[1:] == values[:-1]
    hit = values[1:][same]
    return hit[np.concatenate([[True], hit[1:] != hit[:-1]])] if len(hit) else hit


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known (ascending): a table of their low bits turns most others away first."""
    if not len(known):
        return np.zeros(len(values), bool)
    bits = min(24, max(10, int(len(known)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    low = _U((1 << bits) - 1)
    table[known & low] = True
    out = table[values & low]
    at = np.flatnonzero(out)
    some = values[at]
    k = np.searchsorted(known, some)
    k[k == len(known)] = 0
    out[at] = known[k] == some
    return out


def shared(table: pa.Table) -> pa.Table:
    """Of a bucket's runs (run, data), each run's keys that occur more than once in the bucket."""
    runs = [unpack_sorted(x) for x in table.column("data").to_pylist()]
    every = np.concatenate(runs)
    every.sort()
    twice = repeated(every)
    kept = [pack_sorted(np.unique(x[among(x, twice)])) for x in runs]
    asked = np.array([bool(x) for x in kept])
    return pa.table({"run": table.column("run"), "data": pa.array(kept, pa.binary())}).filter(pa.array(asked))
