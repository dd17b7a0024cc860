"""Importance resampling towards a target distribution, features by CRC-32.

A feature is a run of one or two words; its bucket is the CRC-32 of its
bytes.  CRC-32 is linear: the checksum of a span is the exclusive or of one
contribution for each byte, which hangs on the byte and its distance from
the span's end alone, and of a constant for the span's length.  All spans of
a batch are therefore checked at once: contributions are looked up in a
position table and ``bitwise_xor.reduceat`` folds them over the spans.

Spans longer than the table are folded block by block: a block's checksum
is carried over the next block with a table of shifts and the two are
exclusive-ored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ranking import running_sums
from graphloom.llm.arrow_text import flat_text, lower_ascii, slices
from graphloom.llm.shared import cut_lineage

BUCKETS = 10_000
DEPTH = 64
#: Bytes worked on at once: arrays of this size stay in a core's cache.
SLICE = 1 << 16
MIN_WORDS = 20
PERCENT = 25
SEED = 7

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True
_WORD[0x80:] = True


def position_table(depth: int = DEPTH) -> np.ndarray:
    """``table[d, b]``: what byte ``b`` adds to the checksum with ``d`` bytes after it.

    Row 0 is the usual byte table without the constants, the next rows follow
    by feeding one zero byte each.
    """
    b = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        b = np.where(b & 1, (b >> 1) ^ np.uint32(0xEDB88320), b >> 1).astype(np.uint32)
    rows = [b]
    for _ in range(depth - 1):
        last = rows[-1]
        rows.append(b[last & 0xFF] ^ (last >> np.uint32(8)))
    return np.stack(rows)


TABLE = position_table()
#: The checksum of 0, 1, 2, ... zero bytes: what the length alone adds.
_LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(DEPTH + 1)], np.uint32)


def _shifted(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Plain states carried over as many zero bytes as the table is deep."""
    depth = len(table)
    out = np.zeros_like(state)
    for k in range(4):  # the state's bytes stand before the zeros like text bytes would
        out ^= table[depth - 1 - k][(state >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    short = _LENGTHS[np.minimum(lengths, DEPTH)]
    for k in np.flatnonzero(lengths > DEPTH):
        short[k] = zlib.crc32(bytes(int(lengths[k])))
    return short


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for spans in order that do not overlap."""
    depth, lengths = len(table), ends - starts
    if not lengths.all():
        out, some = np.zeros(len(lengths), np.uint32), np.flatnonzero(lengths)
        out[some] = crc32_spans(data, starts[some], ends[some], table) if len(some) else 0
        return out
    if not len(starts):
        return np.zeros(0, np.uint32)
    # a span's last block is a whole one, its first takes what is left: blocks are counted from the end
    blocks = -(-lengths // depth)
    longest, first = int(blocks.max()), np.cumsum(blocks) - blocks
    begin, stop = starts, ends
    if longest > 1:
        owner = np.repeat(np.arange(len(starts)), blocks)
        left = (first + blocks - 1)[owner] - np.arange(len(owner))  # blocks after this one
        stop = ends[owner] - left * depth
        begin = np.maximum(starts[owner], stop - depth)
    # one look-up for every byte from the first block to the last; what lies between blocks is folded too, and left
    base, reach = int(begin[0]), int(stop[-1])
    place = np.arange(0, (reach - base) * 256, 256) - data[base:reach]
    ahead = np.repeat((stop - 1 - base) * 256, np.append(begin[1:], reach) - begin)
    cuts = np.stack([begin - base, stop - base], axis=1).ravel()[:-1]
    parts = np.bitwise_xor.reduceat(table.ravel().take(ahead - place, mode="clip"), cuts)[::2]
    state = parts[first]
    for k in range(1, longest):
        some = np.flatnonzero(blocks > k)
        state[some] = _shifted(state[some], table) ^ parts[first[some] + k]
    return state ^ _length_constants(lengths)


def spaced_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words one space apart: (bytes, starts, ends, row of each word).

    ``bounds`` cut the bytes into rows; a word does not cross them.
    """
    low = lower_ascii(data)
    ink = _WORD[low]
    n = len(low)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(ink & (edge[:n] | ~np.concatenate(([False], ink[:-1]))))
    stops = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    size = stops - begins + 1
    place = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    word = np.repeat(np.arange(len(begins)), size - 1)
    within = np.flatnonzero(ink)
    out[place[word] + within - begins[word]] = low[within]
    return out, place, place + size - 1, np.searchsorted(bounds, begins, side="right") - 1


def feature_buckets(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the words of each row.

    Pairs that start at even words do not overlap, nor do those that start at
    odd words, so that every pass folds spans in order.
    """
    text, starts, ends, row = spaced_words(data, bounds)
    sums, rows = [crc32_spans(text, starts, ends)], [row]
    pair = np.flatnonzero(row[1:] == row[:-1])
    for odd in (0, 1):
        some = pair[pair % 2 == odd]
        sums.append(crc32_spans(text, starts[some], ends[some + 1]))
        rows.append(row[some])
    return (np.concatenate(sums) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows), np.bincount(row, minlength=len(bounds) - 1)


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of a text column per bucket.

    Each task adds up its texts and sends one row a bucket; the driver gets as
    many rows as there are buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, bounds = flat_text(batch.column(0))
            for lo, hi in slices(bounds, SLICE):
                found, _, _ = feature_buckets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], buckets)
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    read = texts.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    out = np.zeros(buckets, np.int64)
    for row in read.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both models, one added to every bucket, rounded down."""
    buckets = len(target)
    up = (target + 1).astype(float) * float(source.sum() + buckets)
    down = (source + 1).astype(float) * float(target.sum() + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the mean gain of every row's features, rounded down; none: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_text(batch.column(1))
            n = batch.num_rows
            n_words, counts, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lo, hi in slices(bounds, SLICE):
                found, rows, own = feature_buckets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], len(gain))
                n_words[lo:hi] = own
                counts[lo:hi] = np.bincount(rows, minlength=hi - lo)
                np.add.at(sums[lo:hi], rows, gain[found])
            mean = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, counts, mean))], names=["c0", "n_words", "n_features", "weight"])

    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("c0"), F.col(f"`{text_col}`").cast("string").alias("c1"))
    return read.mapInArrow(run, "c0 long, n_words long, n_features long, weight long").withColumnRenamed("c0", id_col)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the key's SHA-256; a null key draws like an empty one."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds ``score`` and ``rank``: the best ``percent`` of the rows with ``min_words``, numbered from 1; others null.

    Ties go to the smaller id (null first), equal ids as they come.  Ranks are
    partition offsets: no task sees all rows.
    """
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("fits", (F.col("n_words") >= min_words).cast("long")))
    want = percent * (scored.agg(F.sum("fits")).first()[0] or 0) // 100
    placed = running_sums(scored.where("fits = 1"), [F.desc("score"), F.col(id_col).asc_nulls_first()], {"rank": "fits"})
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank")))
    rest = scored.where("fits = 0").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("fits")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of ``docs``.

    Both models count all texts: of ``docs`` and of ``target``.  The rows drawn
    are those with a rank.  Null and empty texts have no features and weight 0
    and are never drawn; repeated rows count and are drawn each; with an empty
    target all gains follow the added counts; other columns are not read.
    """
    source = feature_counts(docs, text_col, buckets)
    wanted = feature_counts(target, target_col, buckets)
    return draw(weights(docs, gains(wanted, source), id_col, text_col), percent, min_words, id_col, seed)
