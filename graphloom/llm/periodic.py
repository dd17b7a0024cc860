"""Periodic runs of words by Baier's grouping.

Phase one of Baier's suffix sorter deals the suffixes of a text into groups
by their longest Lyndon prefix: groups are taken from the largest down, and
what stands just before a taken suffix gets that suffix's context appended
and moves to a new group above its old one.  What a suffix's context has
grown to when its group is taken is its entry in the Lyndon array, so the
array falls out of the grouping, with no suffix array and no LCE query.  The
same grouping under the reverse order of the words gives the second array.

By the runs theorem every maximal run has one of its Lyndon roots as the
longest Lyndon word of some position under one of the two orders.  Each
candidate root is extended to both sides through longest common extensions
with itself, one period on.

A run of exponent four or more holds each of its words four times at least.
Words that are rarer in their text can stand in no such run, so the text is
cut at them and the stretches are grouped one by one; stretches shorter than
the shortest run asked for have none.  Nothing else is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 6
MIN_EXPONENT = 4

Run = tuple[int, int, int]


def lyndon_array(word_ids: list[int], reverse: bool = False) -> list[int]:
    """Length of the longest Lyndon word at each position, by Baier's phase one.

    ``reverse`` turns the order of the symbols round; the end of the text is
    smaller than every symbol under both orders.

    Positions whose group has not been taken form a linked list (``before``,
    ``after``); the context of a position reaches to its next one in the list.
    """
    n = len(word_ids)
    firsts: dict[int, list[int]] = {}
    for i, c in enumerate(word_ids, 1):  # place 0 is the list's head
        firsts.setdefault(c, []).append(i)
    members = [firsts[c] for c in sorted(firsts, reverse=not reverse)]  # largest first
    group = [0] * (n + 2)
    for g, places in enumerate(members):
        for i in places:
            group[i] = g
    end = -1
    below = [*range(1, len(members)), end]
    above = list(range(-1, len(members) - 1))
    before, after = list(range(-1, n + 1)), list(range(1, n + 3))
    out = [0] * (n + 1)
    g = 0 if n else end
    while g != end:
        grown: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue  # moved to a larger group since, and taken with it
            left, right = before[i], after[i]
            out[i] = right - i
            after[left], before[right] = right, left
            if left:
                grown[left] = grown.get(left, 0) + 1
        if len(grown) == 1:
            moved = [(group[left], k, [left]) for left, k in grown.items()]
        else:
            by: dict[tuple[int, int], list[int]] = {}
            for left, k in grown.items():
                by.setdefault((group[left], k), []).append(left)
            moved = [(h, k, by[h, k]) for h, k in sorted(by, reverse=True)]  # more repeats are larger
        for h, _, places in moved:
            new = len(members)
            members.append(places)
            over = above[h]
            above.append(over)
            below.append(h)
            below[over] = above[h] = new  # a group of a suffix not yet taken is below g, so it has one above
            for i in places:
                group[i] = new
        g = below[g]
    return out[1:]


def _ahead(x: np.ndarray, i: int, j: int) -> int:
    """Longest common extension of ``x[i:]`` and ``x[j:]``, i < j."""
    n, at, step = len(x) - j, 0, 16
    while at < n:
        a, b = x[i + at : i + min(at + step, n)], x[j + at : j + min(at + step, n)]
        if not np.array_equal(a, b):
            return at + int(np.argmax(a != b))
        at, step = at + step, step * 2
    return max(n, 0)


def _behind(x: np.ndarray, i: int, j: int) -> int:
    """Longest common extension of ``x[:i]`` and ``x[:j]`` to the left, i < j."""
    return _ahead(x[:j][::-1], 0, j - i)


def _runs_of_stretch(x: np.ndarray, offset: int, min_words: int, min_exponent: int, found: set[Run]) -> None:
    n, ids = len(x), x.tolist()
    for reverse in (False, True):
        root = np.array(lyndon_array(ids, reverse))
        # the first root of a run starts in its first period: two more follow it
        at = np.flatnonzero(np.arange(n) + 2 * root <= n)
        p = root[at]
        same = (x[at] == x[at + p]) & (x[at + p - 1] == x[at + 2 * p - 1])
        passed: dict[int, int] = {}
        for i, q in zip(at[same].tolist(), p[same].tolist()):
            if i < passed.get(q, 0):
                continue  # a later root of a run that is known
            on = _ahead(x, i, i + q)
            passed[q] = i + on
            back = _behind(x, i, i + q)
            length = back + q + on
            if length >= max(min_words, min_exponent * q):
                found.add((offset + i - back, length, q))


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """(start, length, period) of all maximal runs of a text, by start, then period.

    A run has its smallest period, is as long as ``min_exponent`` periods and
    ``min_words`` words at least, and no word beside it carries the period on.
    """
    if min_exponent < 3:
        raise ValueError("a root of a run has to be followed by a whole period: three periods at least")
    if len(words) < min_words:
        return []
    names: dict[bytes, int] = {}
    x = np.array([names.setdefault(w, len(names)) for w in words])
    often = np.bincount(x)[x] >= min_exponent
    edge = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8)))
    found: set[Run] = set()
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= min_words:
            _runs_of_stretch(x[a:b], a, min_words, min_exponent, found)
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but for those that stand in a run after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted runs: about one text in ten is made periodic from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of every text, and the text without their repeats.

    ``runs`` are structs (start, length, period) counted in words, by start,
    then period; ``collapsed`` is the kept words joined by one space.
    ``rewrite(id, words)`` may change the words before the search.  Null and
    empty texts and texts of white space have no words and no runs; repeated
    rows are rows of their own; other columns are not read.  A text is always
    searched whole, by one task, in memory proportional to its length and
    time proportional to it but for sorting; texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 512):
                sizes, spans, texts = [], [], []
                some = batch.slice(at, 512)
                for k, (doc, text) in enumerate(zip(some.column(0).to_pylist(), some.column(1))):
                    raw = text.as_buffer()
                    words = bytes(raw).split() if raw is not None else []  # bytes split at 20 and 09-0D exactly
                    if rewrite is not None:
                        words = rewrite(doc, words)
                    runs = find_runs(words, min_words, min_exponent)
                    sizes.append(len(words))
                    spans.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(without_repeats(words, runs)))
                columns = [ids.slice(at, 512), pa.array(sizes, pa.int64()), pa.array(spans, RUN_TYPE), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["c0", "n_words", "runs", "collapsed"])

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("c0"), F.col(f"`{text_col}`").cast("string").alias("c1"))
    schema = "c0 long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return read.mapInArrow(run, schema).withColumnRenamed("c0", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document the number of runs, its run of greatest exponent (ties: smallest
    start, then period; no run: nulls) and hashes of all runs and of the kept words."""
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("_best", F.reduce("runs", nothing, greater))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
