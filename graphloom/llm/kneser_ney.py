"""Interpolated modified Kneser-Ney model of order three (or two).

Counting runs in Spark: tasks count the trigrams of their texts, deal them
to parts as packed sorted arrays and the parts merge them.  Every part
writes its share of the model to the shared folder as sorted hash arrays;
scoring workers memory-map the files, so a worker's memory does not follow
the size of the model.

A word is the upper 48 bits of its 64-bit content hash.  Trigrams are dealt
by their middle word: the trigrams of one part then hold all that follows
the pair (first, middle), all that precedes the pair (middle, last) and all
pairs of the middle word.  Middle words with a part's share of all tokens
(heavy ones, at most ``2 * parts``) are dealt twice instead, by their first
and by their last pair, and pairs that are as frequent by the whole
trigram; the sums of these few words and pairs are added up in Spark and
travel with the model's header.

What follows a pair that occurs once (most pairs) is not stored: the pair is
in the table of pairs, and its statistics are those of one token.

Two begin marks stand before a text and one end behind it.  The highest
order uses counts, the lower ones the number of distinct words before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_text import flat_text, lower_ascii, mix64, slices, span_hashes, words
from graphloom.llm.hash_store import HashArray, by_part, exists, new_folder, parts_for, read_arrays, write_arrays
from graphloom.llm.shared import cut_lineage

BEGIN, END = np.uint64(1), np.uint64(2)
FLUSH_TOKENS = 2_000_000
SCORE_BYTES = 2 << 20
PART_BYTES = 32 << 20
WHOLE, AFTER, BEFORE = 0, 1, 2


def token_stream(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, place in the row) of every token; each row ends with ``END``."""
    starts, ends, first = words(data, bounds)
    hashes = span_hashes(lower_ascii(data), starts, ends) >> np.uint64(16)
    counts = np.diff(first) + 1
    rows = np.repeat(np.arange(len(bounds) - 1), counts)
    last = np.cumsum(counts) - 1
    token = np.empty(len(rows), np.uint64)
    mask = np.ones(len(rows), bool)
    mask[last] = False
    token[mask], token[last] = hashes, END
    place = np.arange(len(rows)) - np.repeat(last - counts + 1, counts)
    return token, rows, place


def trigrams(token: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names in order and the indices (first, middle, last) of every token's
    trigram; with order two the first word is always the begin mark."""
    names, last = np.unique(np.append(token, BEGIN), return_inverse=True)
    begin, last = last[-1], last[:-1]
    before = []
    for k in (2, 1):
        x = np.full(len(last), begin)
        if k < order:
            x[k:] = np.where(place[k:] >= k, last[:-k], begin)
        before.append(x)
    return names, [*before, last]


def distinct(columns: list[np.ndarray], counts: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of indices below ``size``, in order, with summed counts."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, np.int64)
    bits = max(1, int(size - 1).bit_length())
    if bits * len(columns) < 64:
        key = columns[0].astype(np.int64)
        for x in columns[1:]:
            key = key << bits | x
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[new]
        out = [key >> bits * k & (1 << bits) - 1 for k in range(len(columns) - 1, -1, -1)]
    else:
        order = np.lexsort(columns[::-1])
        out = [x[order] for x in columns]
        new = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in out], axis=0))))
        out = [x[new] for x in out]
        counts = None if counts is None else counts[order]
    return out, np.diff(np.append(new, n)) if counts is None else np.add.reduceat(counts, new)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def _pack(*columns: tuple[str, np.ndarray]) -> bytes:
    """Columns of kinds k (48-bit keys in order), i (indices) and c (counts);
    a column is its length and its bytes, lowest ones first, all compressed."""
    head = np.array([len(x) for _, x in columns], "<i8").tobytes()
    blobs = [_planes(np.diff(x.view(np.int64), prepend=0), 6) if kind == "k" else _planes(x, 4 if kind == "i" else 8) for kind, x in columns]
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(blobs))


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob[: 8 * len(kinds)], "<i8")
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 * len(kinds) :]), np.uint8), 0, []
    for kind, n in zip(kinds, sizes):
        width = {"k": 6, "i": 4, "c": 8}[kind]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at : at + width * n].reshape(width, n).T
        at += width * n
        value = wide.view("<i8").ravel()
        out.append(np.cumsum(value).view(np.uint64) if kind == "k" else value)
    return out


def _rises(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x``, in order within each run of ``group``, as differences."""
    out = np.diff(x, prepend=0)
    new = _starts(group)
    out[new] = x[new]
    return out


def _risen(group: np.ndarray, rises: np.ndarray) -> np.ndarray:
    new, run = _starts(group), np.cumsum(rises)
    return run - np.repeat(run[new] - rises[new], np.diff(np.append(new, len(run))))


def pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(u * np.uint64(0x9E3779B97F4A7C15) + v) >> np.uint64(16)


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(u * np.uint64(0x9E3779B97F4A7C15) + v) * np.uint64(31) + w) >> np.uint64(16)


def _spread(key: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(key + np.uint64(7)) % np.uint64(parts)).astype(np.int64)


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Index of ``x`` in the sorted array ``few``, -1 if absent."""
    if not len(few):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(few, x), len(few) - 1)
    return np.where(few[at] == x, at, -1)


def deal(u: np.ndarray, v: np.ndarray, w: np.ndarray, parts: int, words_: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part for what follows (u, v), part for what precedes (v, w), is v heavy)."""
    after = _spread(v, parts)
    before = after.copy()
    hot = _among(v, words_) >= 0
    at = np.flatnonzero(hot)
    if len(at):
        whole = triple_key(u[at], v[at], w[at])
        for out, a, b in ((after, u, v), (before, v, w)):
            key = pair_key(a[at], b[at])
            out[at] = _spread(np.where(_among(key, pairs) >= 0, whole, key), parts)
    return after, before, hot


def narrow(x: np.ndarray) -> list[np.ndarray]:
    """Counts as single bytes; those of 255 and more aside."""
    over = np.flatnonzero(x >= 255)
    return [np.minimum(x, 255).astype(np.uint8), over.astype("<i8"), x[over].astype("<i8")]


def widen(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    small, over, values = arrays
    out = small[at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = values[np.searchsorted(over, at[big])]
    return out


def narrow_stats(stats: np.ndarray) -> list[np.ndarray]:
    """Rows of four counts as one byte, a place in the table of the 255 most
    frequent rows of counts below 16; other rows aside."""
    code = np.where((stats < 16).all(axis=1), stats @ np.array([4096, 256, 16, 1]), -1)
    freq = np.bincount(code[code >= 0], minlength=1 << 16)
    table = np.argsort(-freq, kind="stable")[:255]
    place = np.full((1 << 16) + 1, 255)
    place[table] = np.arange(255)
    byte = place[code]
    over = np.flatnonzero(byte == 255)
    return [byte.astype(np.uint8), table.astype("<i8"), over.astype("<i8"), stats[over].astype("<i8").ravel()]


def widen_stats(arrays: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    byte, table, over, values = arrays
    byte = byte[at]
    code = table[np.minimum(byte, 254)]
    out = np.stack([code >> 12, code >> 8 & 15, code >> 4 & 15, code & 15], axis=1)
    big = np.flatnonzero(byte == 255)
    out[big] = values.reshape(-1, 4)[np.searchsorted(over, at[big])]
    return out


def _stats(counts: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(sum, ones, twos, threes and more) of the groups that start at ``new``."""
    if not len(new):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), new) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in columns], axis=0))))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of items seen once to four times; a
    class that is empty falls back to one absolute discount."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """The header: everything but the hash arrays in ``folder``."""

    folder: str
    parts: int
    order: int
    tokens: int
    vocabulary: int
    bigrams: int
    top_discounts: tuple[float, float, float]
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float
    heavy_words: np.ndarray
    heavy_pairs: np.ndarray
    word_stats: np.ndarray
    pair_stats: np.ndarray
    pair_counts: np.ndarray


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        data, bounds = flat_text(batch.column(0))
        for lo, hi in slices(bounds):
            token, _, place = token_stream(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            yield token, place


def heavy_keys(texts: DataFrame, parts: int, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Context words, and keys of pairs of words, with one part's share of all
    tokens or nearly: at most ``2 * parts`` of each.  They only decide how
    trigrams are dealt.  A pair whose first or second word is not heavy
    itself is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, place in _streams(batches):
            names, (_, v, w) = trigrams(token, place, order)
            often = np.bincount(v, minlength=len(names)) * 8 * parts >= len(w)
            at = np.flatnonzero(often[v])
            (pv, pw), c = distinct([v[at], w[at]], None, len(names))
            big = c * 8 * parts >= len(w)
            kinds = np.r_[np.zeros(1, np.int64), np.ones(often.sum(), np.int64), np.full(big.sum(), 2)]
            keys = np.concatenate([np.zeros(1, np.uint64), names[often], pair_key(names[pv[big]], names[pw[big]])]).view(np.int64)
            firsts = np.concatenate([np.zeros(1 + often.sum(), np.uint64), names[pv[big]]]).view(np.int64)
            counts = np.r_[len(w), np.bincount(v, minlength=len(names))[often], c[big]]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(firsts), pa.array(counts)], names=["kind", "key", "first", "n"])

    found = cut_lineage(texts.mapInArrow(run, "kind long, key long, first long, n long").groupBy("kind", "key", "first").agg(F.sum("n").alias("n")))
    total = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("kind") > 0) & (F.col("n") * (8 * parts) >= F.lit(7 * total))).collect() if total else []
    known = np.sort(np.array([r["key"] for r in rows if r["kind"] == 1], np.int64).view(np.uint64))
    pairs = [r["key"] for r in rows if r["kind"] == 2 and np.int64(r["first"]).view(np.uint64) in known]
    return known, np.sort(np.array(pairs, np.int64).view(np.uint64))


_MERGED = "kind int, part int, key long, a long, b long, c long, d long, packed binary"
_MERGED_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), *((x, pa.int64()) for x in "abcd"), ("packed", pa.binary())])


def fit(texts: DataFrame, text_col: str = "text", parts: int | None = None, order: int = 3) -> Model:
    """Count ``texts`` and write the model; null and empty texts are one end.

    The model's folder stays in the shared folder until the caller removes
    it, because scoring is lazy.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("t"))
    parts = parts or parts_for(texts, "t", max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), PART_BYTES)
    folder = new_folder(spark, "kneser-ney")
    heavy, heavy_pairs = heavy_keys(texts, parts, order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(tokens: list, places: list) -> Iterator[pa.RecordBatch]:
            names, (u, v, w) = trigrams(np.concatenate(tokens), np.concatenate(places), order)
            (v, u, w), c = distinct([v, u, w], None, len(names))
            after, before, hot = deal(names[u], names[v], names[w], parts, heavy, heavy_pairs)
            again = np.flatnonzero(hot)
            row = np.concatenate([np.arange(len(v)), again])
            role = np.concatenate([np.where(hot, AFTER, WHOLE), np.full(len(again), BEFORE)])
            for slot, at in by_part(np.concatenate([after, before[again]]) * 3 + role):
                idx = row[at]
                used, local = np.unique(np.concatenate([v[idx], u[idx], w[idx]]), return_inverse=True)
                a, b, d = np.split(local, 3)
                packed = _pack(("k", names[used]), ("i", np.diff(a, prepend=0)), ("i", _rises(a, b)), ("i", d), ("c", c[idx]))
                yield pa.RecordBatch.from_arrays([pa.array([slot // 3], pa.int32()), pa.array([slot % 3], pa.int32()), pa.array([packed], pa.binary())], names=["part", "role", "packed"])

        tokens, places, n = [], [], 0
        for token, place in _streams(batches):
            tokens.append(token)
            places.append(place)
            n += len(token)
            if n >= FLUSH_TOKENS:
                yield from flush(tokens, places)
                tokens, places, n = [], [], 0
        if tokens:
            yield from flush(tokens, places)

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        roles = table.column("role").to_pylist()
        got = [_unpack(x.as_py(), "kiiic") for x in table.column("packed")]
        names = np.unique(np.concatenate([x[0] for x in got]))
        by_role = []
        for role in (WHOLE, AFTER, BEFORE):
            mine = [(np.searchsorted(names, x[0]), x) for r, x in zip(roles, got) if r == role]
            v, u, w, c = (np.concatenate(x) if mine else np.zeros(0, np.int64) for x in ([at[np.cumsum(x[1])] for at, x in mine], [at[_risen(np.cumsum(x[1]), x[2])] for at, x in mine], [at[x[3]] for at, x in mine], [x[4] for _, x in mine]))
            by_role.append((*distinct([v, u, w], c, len(names)),))
        del got

        rows: list[tuple] = []
        (v, u, w), c = ([np.concatenate(x) for x in zip(by_role[WHOLE][0], by_role[AFTER][0])], np.concatenate([by_role[WHOLE][1], by_role[AFTER][1]]))
        rows += [(0, -1, k, int((c == k).sum()), 0, 0, 0, None) for k in (1, 2, 3, 4)]
        key = triple_key(names[u], names[v], names[w])
        by_key = np.argsort(key)
        write_arrays(folder, f"top-{part}", [*HashArray.layout(key[by_key]), *narrow(c[by_key])])
        new = _starts(v, u)
        key, stats = pair_key(names[u[new]], names[v[new]]), _stats(c, new)
        hot = _among(key, heavy_pairs) >= 0
        rows += [(1, -1, int(x.view(np.int64)), *map(int, s), None) for x, s in zip(key[hot], stats[hot])]
        kept = ~hot & ((stats[:, 0] > 1) | (names[u[new]] == BEGIN)) if order == 3 else ~hot
        by_key = np.flatnonzero(kept)
        by_key = by_key[np.argsort(key[by_key])]
        write_arrays(folder, f"top-contexts-{part}", [*HashArray.layout(key[by_key]), *narrow_stats(stats[by_key])])

        v, w = (np.concatenate([by_role[r][0][k] for r in (WHOLE, BEFORE)]) for k in (0, 2))
        c = np.concatenate([by_role[r][1] for r in (WHOLE, BEFORE)])
        by_role.clear()
        (pv, pw), total = distinct([v, w], c, len(names))
        _, n = distinct([v, w], None, len(names))
        key = pair_key(names[pv], names[pw])
        hot = _among(key, heavy_pairs) >= 0
        rows += [(2, -1, int(k.view(np.int64)), int(x), int(f), int(l), 0, None) for k, x, f, l in zip(key[hot], n[hot], names[pv[hot]].view(np.int64), names[pw[hot]].view(np.int64))]
        preds = np.where(hot, 0, 1)
        cold = np.flatnonzero(~hot)
        cn, cv = n[cold], pv[cold]
        rows += [(3, -1, k, int((cn == k).sum()), 0, 0, 0, None) for k in (1, 2, 3, 4)]
        by_key = np.argsort(key[cold])
        write_arrays(folder, f"pairs-{part}", [*HashArray.layout(key[cold][by_key]), *narrow(cn[by_key])])
        new = _starts(cv)
        context, stats = names[cv[new]], _stats(cn, new)
        hot = _among(context, heavy) >= 0
        rows += [(4, -1, int(x.view(np.int64)), *map(int, s), None) for x, s in zip(context[hot], stats[hot])]
        write_arrays(folder, f"contexts-{part}", [*HashArray.layout(context[~hot]), *narrow_stats(stats[~hot])])

        (ww,), total = distinct([pw], total, len(names))
        _, preds = distinct([pw], preds, len(names))
        ww = names[ww]
        for p, idx in by_part(_spread(ww, parts)):
            rows.append((5, p, 0, 0, 0, 0, 0, _pack(("k", ww[idx]), ("c", preds[idx]), ("c", total[idx]))))
        return pa.Table.from_pylist([dict(zip(_MERGED_SCHEMA.names, r)) for r in rows], schema=_MERGED_SCHEMA)

    merged = cut_lineage(texts.mapInArrow(count, "part int, role int, packed binary").groupBy("part").applyInArrow(merge, _MERGED))
    sums = merged.where("kind < 5").groupBy("kind", "key").agg(F.sum("a").alias("a"), *(F.when(F.col("kind") == 2, F.max(x)).otherwise(F.sum(x)).alias(x) for x in "bc"), F.sum("d").alias("d")).collect()
    told = {(r["kind"], r["key"]): [r[x] for x in "abcd"] for r in sums}
    signed = lambda x: int(x.view(np.int64))
    gather = lambda kind, keys: np.array([told.get((kind, signed(k)), [0] * 4) for k in keys], np.int64).reshape(-1, 4)
    pair_stats, word_stats, pair_rows = gather(1, heavy_pairs), gather(4, heavy), gather(2, heavy_pairs)
    pair_counts = pair_rows[:, 0]
    times = [told.get((3, k), [0])[0] + int((pair_counts == k).sum()) for k in (1, 2, 3, 4)]
    seen = pair_counts > 0
    np.add.at(word_stats, _among(pair_rows[seen, 1].view(np.uint64), heavy), np.stack([pair_counts, pair_counts == 1, pair_counts == 2, pair_counts >= 3], axis=1)[seen])
    extra, extra_n = np.unique(pair_rows[seen, 2].view(np.uint64), return_counts=True)

    def unigrams(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, preds, total = (np.concatenate(x) for x in zip(*(_unpack(x.as_py(), "kcc") for x in table.column("packed"))))
        names, at = np.unique(keys, return_inverse=True)
        (_,), total = distinct([at], total, len(names))
        _, preds = distinct([at], preds, len(names))
        more = _among(names, extra)
        preds[more >= 0] += extra_n[more[more >= 0]]
        write_arrays(folder, f"words-{part}", [*HashArray.layout(names), *narrow(preds), *narrow(total)])
        return pa.table({"words": [len(names)], "tokens": [int(total.sum())], "pairs": [int(preds.sum())], **{f"n{k}": [int((preds == k).sum())] for k in (1, 2, 3, 4)}, "many": [int((preds >= 3).sum())]})

    counted = cut_lineage(merged.where("kind = 5").select("part", "packed").groupBy("part").applyInArrow(unigrams, "words long, tokens long, pairs long, n1 long, n2 long, n3 long, n4 long, many long"))
    t = counted.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in counted.columns)).first()
    word_d = discounts([t[f"n{k}"] for k in (1, 2, 3, 4)])
    backoff = (word_d[0] * t["n1"] + word_d[1] * t["n2"] + word_d[2] * t["many"]) / t["pairs"] if t["pairs"] else 1.0
    return Model(
        folder, parts, order, int(t["tokens"]), int(t["words"]), int(t["pairs"]), discounts([told.get((0, k), [0])[0] for k in (1, 2, 3, 4)]), discounts(times), word_d, backoff,
        heavy, heavy_pairs, word_stats, pair_stats, pair_counts,
    )


def _off(model_discounts: tuple[float, float, float], n: np.ndarray) -> np.ndarray:
    return np.take(np.array([0.0, *model_discounts]), np.minimum(n, 3).astype(np.int64))


def _found(model: Model, name: str, keys: np.ndarray, *dtypes: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which keys a file has, their places in it, and its further arrays."""
    off, low, *rest = read_arrays(model.folder, name, ["<u8", "<u4", *dtypes])
    at = HashArray(off, low).find(keys)
    return at, rest


def _interpolate(prob: np.ndarray, n: np.ndarray, stats: np.ndarray, off: tuple[float, float, float]) -> np.ndarray:
    total = stats[:, 0]
    known = total > 0
    out = prob.copy()
    out[known] = (np.maximum(n - _off(off, n), 0.0)[known] + (stats[known, 1:] @ np.array(off)) * prob[known]) / total[known]
    return out


_COUNTS, _STATS = ("u1", "<i8", "<i8"), ("u1", "<i8", "<i8", "<i8")


def score_tokens(model: Model, names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, log10 probability) of tokens after their two words before;
    ``u``, ``v`` and ``w`` are indices of ``names``, in the order of the texts."""
    count, preds, stats = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros((len(names), 4), np.int64)
    floor = model.word_backoff / (model.vocabulary + 1)
    if not model.tokens:
        return count[w], np.full(len(w), np.log10(floor))
    for p, idx in by_part(_spread(names, model.parts)):
        if exists(model.folder, f"words-{p}"):
            at, rest = _found(model, f"words-{p}", names[idx], *_COUNTS, *_COUNTS)
            ok = at >= 0
            preds[idx[ok]], count[idx[ok]] = widen(rest[:3], at[ok]), widen(rest[3:], at[ok])
        if exists(model.folder, f"contexts-{p}"):
            at, rest = _found(model, f"contexts-{p}", names[idx], *_STATS)
            stats[idx[at >= 0]] = widen_stats(rest, at[at >= 0])
    prob = (floor + np.maximum(preds - _off(model.word_discounts, preds), 0.0) / model.bigrams)[w]
    uu, vv, ww = names[u], names[v], names[w]
    after, before, _ = deal(uu, vv, ww, model.parts, model.heavy_words, model.heavy_pairs)
    top = np.zeros((len(w), 4), np.int64)
    if model.order == 3:
        at = _among(names, model.heavy_words)
        stats[at >= 0] = model.word_stats[at[at >= 0]]
        key = pair_key(vv, ww)
        n = np.zeros(len(w), np.int64)
        for p, idx in by_part(before):
            if exists(model.folder, f"pairs-{p}"):
                at, rest = _found(model, f"pairs-{p}", key[idx], *_COUNTS)
                n[idx[at >= 0]] = widen(rest, at[at >= 0])
        at = _among(key, model.heavy_pairs)
        n[at >= 0] = model.pair_counts[at[at >= 0]]
        prob = _interpolate(prob, n, stats[v], model.pair_discounts)
        once = np.zeros(len(w), bool)
        once[1:] = (n[:-1] > 0) & (place[1:] > 0)
        top[once] = (1, 1, 0, 0)
    key, context = triple_key(uu, vv, ww), pair_key(uu, vv)
    n = np.zeros(len(w), np.int64)
    for p, idx in by_part(after):
        if exists(model.folder, f"top-{p}"):
            at, rest = _found(model, f"top-{p}", key[idx], *_COUNTS)
            n[idx[at >= 0]] = widen(rest, at[at >= 0])
            at, rest = _found(model, f"top-contexts-{p}", context[idx], *_STATS)
            top[idx[at >= 0]] = widen_stats(rest, at[at >= 0])
    at = _among(context, model.heavy_pairs)
    top[at >= 0] = model.pair_stats[at[at >= 0]]
    return count[w], np.log10(_interpolate(prob, n, top, model.top_discounts))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every whole text.

    ``score`` is the log10 probability of the text with its end,
    ``base_score`` that of an add-one unigram model.  Words never trained on
    share the mass of one unknown word; a null or empty text is one end.
    """
    scale = float(np.log10(model.tokens + model.vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_text(batch.column(1))
            out = np.zeros((4, batch.num_rows))
            for lo, hi in slices(bounds, SCORE_BYTES):
                token, rows, place = token_stream(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                names, (u, v, w) = trigrams(token, place, model.order)
                count, logp = score_tokens(model, names, u, v, w, place)
                for k, x in enumerate((None, count > 0, np.log10(count + 1.0) - scale, logp)):
                    out[k, lo:hi] = np.bincount(rows, weights=x, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[2]), pa.array(out[3])], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(run, f"{id_col} long, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id", folds: int = 7, held: int = 2) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is ``held``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == held, F.lit(False))
