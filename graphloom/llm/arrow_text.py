"""Vectorised access to UTF-8 text columns inside Arrow batches.

The helpers work on flat byte buffers: one ``uint8`` array holding all
texts of a slice and one ``int64`` array of row boundaries.  Slices are
bounded in bytes, so the working set of a task does not follow the size
of an Arrow batch; a single text longer than the bound is a slice of its
own, because texts are always processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row boundaries of a string column; a null is an empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts sum to about ``limit`` bytes, one row at least."""
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base or of its inverse modulo 2**64."""
    if len(_powers[kind]) < n:
        size = max(n, SLICE_BYTES + 4096)
        steps = np.full(size, _BASE if kind == "up" else _BASE_INV, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of every span ``data[starts:ends]``.

    A polynomial over the bytes modulo 2**64, taken from one running sum,
    divided by the power at the span's start and then mixed; equal spans
    hash alike wherever they stand.
    """
    n = len(data)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", n), out=run[1:])
        raw = (run[ends] - run[starts]) * _power_table("down", n + 1)[starts]
        raw ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(raw)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and, per row, the
    index of its first word (one entry more than rows)."""
    ink = ~_WS[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' first-item indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
