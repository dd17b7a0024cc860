"""Exact removal of repeated byte strings with a Burrows-Wheeler transform.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Three passes over the texts share the work:

1. Winnowing: the smallest hash of the 20-byte grams inside a window
   names it, so equal windows have equal names.  Names are counted in
   packed sorted arrays; those of two documents or more are *shared*.
2. Runs of windows with one shared name become segments.  Equal segments
   are folded to the smallest id, the rest meet by name.  There a
   generalised suffix array and its transform are built for about a
   megabyte of whole names at a time, and breadth-first backward extension
   derives the common prefixes by increasing value, stopping at ``length``:
   what is left joined are the intervals of equal windows, and each passes
   on its smallest document id.
3. Each document looks up its segments and drops what they cover.

A name that very many documents share is *heavy*: its windows are keyed
one by one, by name and both ends, so that no task holds a whole group.
Results of a pass are sorted hash arrays in the shared folder, mapped by
the workers of the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.arrow_text import flat_text, mix64, slices
from graphloom.llm.hash_store import HashArray, by_part, exists, new_folder, parts_for, read_arrays, write_arrays

#: Bytes of a gram, fewer where windows are short; longer grams are shared by fewer unlike windows, but name more segments.
GRAM = 20
HEAD = 7
#: Flags of shared names: one content everywhere, several, or too many for one task.
SAME, MIXED, HEAVY = 1, 2, 3
PASS_BYTES = 2 << 20
FLUSH_BYTES = 12 << 20
NO_DOC = np.iinfo(np.int64).max
#: Text behind one part.
SEGMENT_PART_BYTES = 32 << 20
#: Segments ordered at once; a suffix order takes about 60 bytes for each byte of theirs.
ORDER_BYTES = 1 << 20


@dataclass(frozen=True)
class Segments:
    """Runs of windows with one name: the first window's start and the end of
    the last window's bytes, in the slice; the row, the name and a 48-bit
    key of the content of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    name: np.ndarray
    key: np.ndarray

    def take(self, keep: np.ndarray) -> Segments:
        return Segments(*(getattr(self, k)[keep] for k in ("start", "end", "row", "name", "key")))

    def join(self, other: Segments) -> Segments:
        return Segments(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("start", "end", "row", "name", "key")))


def _load8(data: np.ndarray, n: int, at: int) -> np.ndarray:
    return np.ndarray((n,), "<u8", data, offset=at, strides=(1,))


def _gram(length: int) -> int:
    return min(GRAM, length - 8)


def _content(run: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> np.ndarray:
    """Key of spans from the running sum of their grams' hashes: overlapping
    grams fix each other's order."""
    with np.errstate(over="ignore"):
        return mix64(run[end - gram + 1] - run[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16)


def winnow(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[Segments, np.ndarray]:
    """Segments of all windows of ``length`` bytes inside the rows, and the
    running sum of gram hashes."""
    n = len(data) - length + 1
    none, nil = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n <= 0:
        return Segments(none, none, none, nil, nil), nil
    data, gram = np.ascontiguousarray(data), _gram(length)
    with np.errstate(over="ignore"):
        grams = len(data) - gram + 1
        low = _load8(data, grams, 0) * np.uint64(0x9E3779B97F4A7C15)
        spare = _load8(data, grams, 8) * np.uint64(0xC2B2AE3D27D4EB4F)
        low += spare
        if gram > 16:
            low += np.multiply(_load8(data, grams, gram - 8), np.uint64(0x165667B19E3779F9), out=spare)
        low ^= np.right_shift(low, np.uint64(32), out=spare)
        low *= np.uint64(0xD6E8FEB86659FD93)
        low ^= np.right_shift(low, np.uint64(29), out=spare)
        del spare
        run = np.zeros(grams + 1, np.uint64)
        np.cumsum(low, out=run[1:])
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    # windows that would cross into the next row start no run and end the run before
    edges = bounds[1:-1]
    for back in range(length):
        at = edges - back
        new[at[(at >= 0) & (at < n)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    row = np.searchsorted(bounds, first, side="right") - 1
    inside = first + length <= bounds[row + 1]
    first, last, row = first[inside], last[inside], row[inside]
    end = last + length
    return Segments(first, end, row, low[first] >> np.uint64(16), _content(run, first, end, gram)), run


def _windows(seg: Segments, run: np.ndarray, length: int) -> Segments:
    """Segments as single windows."""
    sizes = seg.end - seg.start - length + 1
    start = np.repeat(seg.start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return Segments(start, start + length, np.repeat(seg.row, sizes), np.repeat(seg.name, sizes), _content(run, start, start + length, _gram(length)))


def _part_of(route: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(route + np.uint64(11)) % np.uint64(parts)).astype(np.int64)


def _route_check(route: np.ndarray) -> np.ndarray:
    """Bits of a route that are stored with a segment's key: both have to agree."""
    return (route & np.uint64(0xFFFF)).astype("<u2")


def _lookup(folder: str, prefix: str, keys: np.ndarray, part: np.ndarray, dtypes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(positions found, index in the part's arrays, arrays) for each part."""
    for p, idx in by_part(part):
        if exists(folder, f"{prefix}-{p}"):
            offsets, low, *rest = read_arrays(folder, f"{prefix}-{p}", ["<u8", "<u4", *dtypes])
            at = HashArray(offsets, low).find(keys[idx])
            ok = at >= 0
            yield idx[ok], at[ok], rest


def shared_items(data: np.ndarray, bounds: np.ndarray, length: int, folder: str, parts: int) -> tuple[Segments, np.ndarray, np.ndarray]:
    """Segments with a shared name, heavy ones window by window; the 48-bit
    route of each, one for all segments that can hold an equal window; and
    whether its route has different segments."""
    seg, run = winnow(data, bounds, length)
    flag = np.zeros(len(seg.name), np.uint8)
    for idx, at, (flags,) in _lookup(folder, "shared", seg.name, _part_of(seg.name, parts), ["u1"]):
        flag[idx] = flags[at]
    light = (flag == SAME) | (flag == MIXED)
    items, route, mixed = seg.take(light), seg.name[light], flag[light] == MIXED
    if (flag == HEAVY).any():
        heavy, gram = _windows(seg.take(flag == HEAVY), run, length), _gram(length)
        with np.errstate(over="ignore"):
            ends = mix64((run[heavy.start + 1] - run[heavy.start]) * np.uint64(3) + run[heavy.end - gram + 1] - run[heavy.end - gram])
        items, route = items.join(heavy), np.concatenate([route, (ends ^ heavy.name) & np.uint64((1 << 48) - 1)])
        mixed = np.concatenate([mixed, np.ones(len(heavy.start), bool)])
    return items, route, mixed


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, heads): all suffixes by their first ``depth`` symbols or
    more, ties in any order, and the first ``HEAD`` symbols of each row packed
    into a number.  Symbols are 0..256; prefix doubling from the heads."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a part holds 2 GiB of segments; use more parts")
    padded = np.zeros(n + HEAD, np.int64)
    padded[:n] = text
    heads = np.zeros(n, np.int64)
    for k in range(HEAD):
        heads = (heads << 9) | padded[k : k + n]
    key, have = heads, HEAD
    while True:
        order = np.argsort(key)
        ranked = key[order]
        if have >= depth:
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        after = np.zeros(n, np.int64)
        after[: max(n - have, 0)] = rank[have:] + 1
        key = rank * (n + 1) + after
        have *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order.astype(np.int32), place, heads[order]


def bounded_boundaries(text: np.ndarray, order: np.ndarray, place: np.ndarray, heads: np.ndarray, length: int) -> np.ndarray:
    """True at each row of the suffix order whose common prefix with the row
    before is shorter than ``length``; symbol 0 separates texts.

    The search starts at the intervals of equal heads.  Intervals of rows
    are extended backwards by every symbol that the transform shows in them,
    breadth first.  An interval found at a level whose right boundary is
    still open sets it: that is the common prefix there.  Only such
    intervals are extended further, and none by a separator.
    """
    n = len(text)
    before = text[order - 1]
    back = place[order - 1]
    bound = np.ones(n + 1, bool)
    bound[1:n] = heads[1:] != heads[:-1]
    edges = np.flatnonzero(bound)
    lb, rb = edges[:-1], edges[1:]
    for _ in range(HEAD, length):
        sizes = rb - lb
        rows = np.repeat(lb - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        symbol = before[rows]
        keep = symbol > 0
        rows, key = rows[keep], (np.repeat(np.arange(len(lb)), sizes)[keep] * 257) + symbol[keep]
        if not len(rows):
            break
        by = np.argsort(key)
        key = key[by]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        target = back[rows[by]]
        left, right = np.minimum.reduceat(target, cut), np.maximum.reduceat(target, cut) + 1
        fresh = ~bound[right]
        bound[right] = True
        lb, rb = left[fresh], right[fresh]
    return bound[:n]


def covered_windows(items: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each item the starts of its windows that a smaller document holds."""
    sizes = np.array([len(x) for x in items], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw = np.frombuffer(b"".join(x + b"\0" for x in items), np.uint8)
    text = raw.astype(np.int16) + np.int16(1)
    text[at[1:] - 1] = 0
    order, place, heads = suffix_order(text, length + 6)
    bound = bounded_boundaries(text, order, place, heads, length)
    own = np.searchsorted(at, order, side="right") - 1
    offset = order - at[own]
    whole = offset + length <= sizes[own]
    doc = np.where(whole, docs[own], NO_DOC)
    first = np.flatnonzero(bound)
    lowest = np.minimum.reduceat(doc, first)[np.cumsum(bound) - 1]
    hit = np.flatnonzero(whole & (lowest < doc))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(items)
    by = np.lexsort((offset[hit], own[hit]))
    hit = hit[by]
    cuts = np.flatnonzero(np.diff(own[hit])) + 1
    for group in np.split(hit, cuts) if len(hit) else ():
        out[own[group[0]]] = offset[group]
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unblob(blob: bytes, dtypes: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], "<u8")[0])
    sizes, at, out = np.frombuffer(raw[8 : 8 + 8 * n], "<u8").astype(int), 8 + 8 * n, []
    for size, dtype in zip(sizes, dtypes):
        out.append(np.frombuffer(raw[at : at + size], dtype))
        at += size
    return out


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of 64-bit numbers, one plane a byte."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)


def _from_planes(planes: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((planes.size // width, 8), np.uint8)
    wide[:, :width] = planes.reshape(width, -1).T
    return wide.view(np.uint64).ravel()


def _steps(sorted48: np.ndarray) -> np.ndarray:
    """Ascending 48-bit values as byte planes of their differences."""
    return _planes(np.diff(sorted48, prepend=np.uint64(0)), 6)


def _from_steps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_from_planes(planes, 6), dtype=np.uint64)


def _stretches(route: np.ndarray, sizes: np.ndarray, limit: int) -> list[np.ndarray]:
    """Positions of sorted ``route`` in stretches of whole routes of about
    ``limit`` bytes; what is above it is the last route of a stretch."""
    first = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
    number = (np.cumsum(sizes) - sizes)[first] // limit
    return np.split(np.arange(len(route)), first[1:][number[1:] != number[:-1]])


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, data, bounds) of rows whose id is not null, slice by slice."""
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid()) if batch.column(0).null_count else batch
        data, bounds = flat_text(batch.column(1))
        ids = np.asarray(batch.column(0)) if batch.num_rows else np.zeros(0, np.int64)
        for lo, hi in slices(bounds, PASS_BYTES):
            yield ids[lo:hi], data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]


_PACKED = pa.schema([("part", pa.int32()), ("packed", pa.binary())])


def _send(part: np.ndarray, pack: object) -> Iterator[pa.RecordBatch]:
    for p, idx in by_part(part):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pack(idx)], pa.binary())], schema=_PACKED)


def _find_shared(source: DataFrame, length: int, folder: str, parts: int) -> None:
    """Pass 1: write the names of two documents or more with their flags."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(names: list, rows: list, keys: list) -> Iterator[pa.RecordBatch]:
            name, row, key = np.concatenate(names), np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(name)
            name, row, key = name[order], row[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            sizes = np.diff(np.append(first, len(name)))
            docs = np.where((np.minimum.reduceat(row, first) == np.maximum.reduceat(row, first)), 1, sizes).astype("<u4")
            low, high = np.minimum.reduceat(key, first), np.maximum.reduceat(key, first)
            name, print_, same = name[first], low.astype("<u4"), low == high
            yield from _send(_part_of(name, parts), lambda i: _blob(_steps(name[i]), docs[i], np.ascontiguousarray(print_[i]), np.packbits(same[i])))

        names, rows, keys, held, base = [], [], [], 0, 0
        for ids, data, bounds in _text_slices(batches):
            seg, _ = winnow(data, bounds, length)
            names.append(seg.name)
            rows.append(seg.row + base)
            keys.append(seg.key)
            base += len(ids)
            held += len(data)
            if held >= FLUSH_BYTES:
                yield from flush(names, rows, keys)
                names, rows, keys, held = [], [], [], 0
        if sum(map(len, names)):
            yield from flush(names, rows, keys)

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got = []
        for x in table.column("packed"):
            planes, docs, print_, same = _unblob(x.as_py(), ["u1", "<u4", "<u4", "u1"])
            got.append((_from_steps(planes), docs.astype(np.int64), print_, np.unpackbits(same)[: len(docs)]))
        name, docs, print_, same = (np.concatenate(c) for c in zip(*got))
        order = np.argsort(name)
        name, docs, print_, same = name[order], docs[order], print_[order], same[order]
        first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        docs = np.add.reduceat(docs, first)
        one = (np.minimum.reduceat(print_, first) == np.maximum.reduceat(print_, first)) & (np.minimum.reduceat(same, first) == 1)
        limit = max(256, docs.sum() // 64)
        flag = np.where(one, SAME, np.where(docs > limit, HEAVY, MIXED)).astype("u1")
        keep = docs > 1
        write_arrays(folder, f"shared-{part}", [*HashArray.layout(name[first][keep]), flag[keep]])
        return pa.table({"part": pa.array([part], pa.int32()), "packed": pa.array([b""], pa.binary())})

    source.mapInArrow(spread, "part int, packed binary").groupBy("part").applyInArrow(merge, "part int, packed binary").count()


def _smallest(route: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each distinct (route, key) the item with the smallest document, by route."""
    order = np.lexsort((doc, key, route))
    new = np.ones(len(order), bool)
    k, r = key[order], route[order]
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return order[new]


def _find_cover(source: DataFrame, length: int, folder: str, parts: int, all_bytes: bool = False) -> bool:
    """Pass 2: for each distinct segment its first document and which of its
    windows a still smaller document holds in another segment.

    Bytes travel only for routes with several segments.  Pass 1 tells those
    by 32-bit prints; False says that a print was mistaken, and the pass has
    to be run again with ``all_bytes``.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: list, docs: list, routes: list, texts: list) -> Iterator[pa.RecordBatch]:
            key, doc, route = np.concatenate(keys), np.concatenate(docs), np.concatenate(routes)
            text = [x for y in texts for x in y]
            first = _smallest(route, key, doc)

            def pack(i: np.ndarray) -> bytes:
                own = first[i]
                body = [text[j] for j in own.tolist()]
                sizes = np.array([len(b) for b in body], np.int64)
                return _blob(_steps(route[own]), _planes(key[own], 6), _planes(doc[own], 8), _planes(sizes, 4), np.frombuffer(b"".join(body), np.uint8))

            yield from _send(_part_of(route[first], parts), pack)

        keys, docs, routes, texts, held = [], [], [], [], 0
        for ids, data, bounds in _text_slices(batches):
            items, route, mixed = shared_items(data, bounds, length, folder, parts)
            own = _smallest(route, items.key, ids[items.row])
            whole = data.tobytes()
            keys.append(items.key[own])
            docs.append(ids[items.row[own]])
            routes.append(route[own])
            sent = mixed[own] | all_bytes
            body = np.full(len(own), b"", object)
            body[sent] = [whole[a:b] for a, b in zip(items.start[own[sent]].tolist(), items.end[own[sent]].tolist())]
            texts.append(body.tolist())
            held += sum(map(len, texts[-1])) + 24 * len(own)
            if held >= FLUSH_BYTES:
                yield from flush(keys, docs, routes, texts)
                keys, docs, routes, texts, held = [], [], [], [], 0
        if sum(map(len, keys)):
            yield from flush(keys, docs, routes, texts)

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got, raws, base = [], [], 0
        for x in table.column("packed"):
            steps, keys, docs, sizes, raw = _unblob(x.as_py(), ["u1"] * 5)
            sizes = _from_planes(sizes, 4).view(np.int64)
            ends = base + np.cumsum(sizes)
            got.append((_from_steps(steps), _from_planes(keys, 6), _from_planes(docs, 8).view(np.int64), ends - sizes, ends))
            raws.append(raw)
            base += len(raw)
        route, key, doc, a, b = (np.concatenate(c) for c in zip(*got))
        first = _smallest(route, key, doc)
        first = first[np.argsort(key[first])]
        route, key, doc, a, b = route[first], key[first], doc[first], a[first], b[first]
        # a route with a single segment is one interval a window, of one document
        by = np.argsort(route)
        several = np.zeros(len(route), bool)
        twin = route[by][1:] == route[by][:-1]
        several[by[1:][twin]] = several[by[:-1][twin]] = True
        mixed = by[several[by]]
        sizes, flat = np.zeros(len(key), np.int64), np.zeros(0, "<u4")
        mistaken = int((a[mixed] == b[mixed]).sum())
        if len(mixed) and not mistaken:
            whole = b"".join(r.tobytes() for r in raws)
            covered = np.full(len(key), None, object)
            for own in (mixed[i] for i in _stretches(route[mixed], (b - a)[mixed], ORDER_BYTES)):
                for k, windows in zip(own, covered_windows([whole[x:y] for x, y in zip(a[own].tolist(), b[own].tolist())], doc[own], length)):
                    covered[k], sizes[k] = windows.astype("<u4"), len(windows)
            flat = np.concatenate(covered[several].tolist())
        write_arrays(folder, f"cover-{part}", [*HashArray.layout(key), doc.astype("<i8"), np.cumsum(np.append(0, sizes)).astype("<u4"), _route_check(route), flat])
        return pa.table({"part": pa.array([part], pa.int32()), "mistaken": pa.array([mistaken], pa.int64())})

    done = source.mapInArrow(spread, "part int, packed binary").groupBy("part").applyInArrow(merge, "part int, mistaken long")
    return not done.agg(F.sum("mistaken")).first()[0]


def _removed(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int, folder: str, parts: int) -> np.ndarray:
    """Which bytes of a slice go."""
    items, route, _ = shared_items(data, bounds, length, folder, parts)
    delta = np.zeros(len(data) + 1, np.int32)
    for idx, at, (first, cuts, check, windows) in _lookup(folder, "cover", items.key, _part_of(route, parts), ["<i8", "<u4", "<u2", "<u4"]):
        same = check[at] == _route_check(route[idx])
        idx, at = idx[same], at[same]
        own = ids[items.row[idx]]
        late = idx[first[at] < own]
        np.add.at(delta, items.start[late], 1)
        np.add.at(delta, items.end[late], -1)
        mine = first[at] == own
        a, b = cuts[at[mine]].astype(np.int64), cuts[at[mine] + 1].astype(np.int64)
        sizes = b - a
        if sizes.sum():
            take = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            starts = np.repeat(items.start[idx[mine]], sizes) + windows[take]
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + length, -1)
    return np.cumsum(delta[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, parts: int | None = None, whole_rows: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with
    ``whole_rows`` instead the rows of ``docs``, their text cut to what is kept.

    A null text is empty.  Rows with a null id take no part and lose nothing;
    rows that repeat an id do not remove each other.  Kept bytes become text
    again without the parts of characters cut in two at a removed span; a
    null text stays null.
    Windows need ``length`` bytes, at least 24.
    """
    if length < 24:
        raise ValueError("length must be at least 24 bytes")
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix-dedup")
    text_at = docs.columns.index(text_col)
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    parts = parts or parts_for(source, text_col, max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), SEGMENT_PART_BYTES)
    _find_shared(source, length, folder, parts)
    if not _find_cover(source, length, folder, parts):
        _find_cover(source, length, folder, parts, all_bytes=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_in = batch.column(1 + text_at if whole_rows else 1)
            data, bounds = flat_text(texts_in)
            missing = np.asarray(batch.column(0).is_null())
            ids = np.asarray(batch.column(0).fill_null(0)) if batch.num_rows else np.zeros(0, np.int64)
            for lo, hi in slices(bounds, PASS_BYTES):
                part, at, own = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], ids[lo:hi]
                # a null id stands before all others, and is put back below
                gone = _removed(np.where(missing[lo:hi], np.iinfo(np.int64).min, own), part, at, length, folder, parts)
                for i in np.flatnonzero(missing[lo:hi]):
                    gone[at[i] : at[i + 1]] = False
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                edge = at[:-1][at[:-1] < len(gone)]
                start[edge] = gone[edge]
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[at])
                whole, kept = part[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[at].tolist()
                left = [whole[a:b] for a, b in zip(kept, kept[1:])]
                if whole_rows:
                    null = texts_in[lo:hi].is_null().to_pylist()
                    texts = pa.array([None if gap else x.decode("utf-8", "ignore") for x, gap in zip(left, null)], pa.string())
                    yield pa.RecordBatch.from_arrays([texts if k == text_at else c[lo:hi] for k, c in enumerate(batch.columns[1:])], names=[f"c{k}" for k in range(batch.num_columns - 1)])
                    continue
                columns = [batch.column(0)[lo:hi], *(pa.array(x.astype(np.int64)) for x in (np.diff(at), total(gone), total(start))), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    if whole_rows:
        carried = docs.select(F.col(id_col).cast("long").alias("_0"), *((F.col(c).cast("string") if k == text_at else F.col(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)))
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in carried.schema.fields[1:]])
        return carried.mapInArrow(finish, schema).toDF(*docs.columns)
    return source.mapInArrow(finish, "c0 long, c1 long, c2 long, c3 long, c4 string").toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
