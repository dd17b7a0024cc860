"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern; every distinct piece of a
stretch of documents is encoded once, and the documents are put together
from the encoded pieces.  A piece that is a token is that token, as the
tokenizer's own encoder has it; every other one is folded by Spark
higher-order functions.  The three steps
run in one stage without a shuffle:

1. ``mapInArrow`` splits texts and emits each new piece as a row, whole
   tokens as their id, followed by the documents as lists of piece numbers;
2. a projection folds ranked merges over the bytes of each other piece with
   a literal rank map, and concatenates the binary tokens of the ids; bytes
   are held as a string of one character an id, so that a merge is a string
   function;
3. ``mapInArrow`` keeps the encoded pieces of the stretch and assembles
   each document's ids and decoded bytes.

A stretch ends, and its pieces are forgotten, once it holds
``MAX_PIECES`` pieces, so memory is bounded whatever a partition holds.
Input that is cut finer than ``TASK_BYTES`` is put together to tasks of that
size, two a core at least, for what partitions share is folded in each anew.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_text import flat_text, slices
from graphloom.llm.hash_store import parts_for

MAX_PIECES = 1_000_000
#: Text behind one task where the input is cut finer: stretches share pieces, and what they share is folded once.
TASK_BYTES = 80 << 20
CHUNK_BYTES = 2 << 20
HASH_SHIFT = 16
BUCKETS = 1 << 32 - HASH_SHIFT
#: Ids are written as characters from here on; the last one says "no such pair".
FIRST = 0x10000
NONE, MARK, EDGE = chr(0x10FFFF), "|", "."


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def sign(token_id: int) -> str:
    """The character that stands for an id in the fold's byte arrays."""
    return chr(FIRST + token_id)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: from two neighbouring ids to the id of
    both together, which is its rank.

    It is an array of small maps, dealt by a hash of the pair.  A map is a
    string of entries, the characters of first and second, a mark, that of
    both and a mark, so that no two ids stand together but a pair.  What
    follows a pair is a mark and its rank; where a pair is not there, the
    whole string is left, which starts with a mark and ``NONE``.
    """
    maps = [MARK + NONE + MARK] * BUCKETS
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            first, second = ranks.get(token[:cut]), ranks.get(token[cut:])
            if first is not None and second is not None:
                pair = sign(first) + sign(second)
                maps[zlib.crc32(pair.encode()) >> HASH_SHIFT] += pair + MARK + sign(rank) + MARK
    return F.split(F.lit(" ".join(maps)), " ")


def token_literal(ranks: dict[bytes, int]) -> Column:
    """The bytes of each id as one literal; an unused id is empty."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return F.from_json(F.lit(json.dumps([base64.b64encode(t).decode() for t in tokens])), "array<binary>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _locate(part: Column, whole: Column) -> Column:
    return F.call_function("locate", part, whole)


def encode_piece(start: Column, ranks: Column) -> Column:
    """array<int>: ids of one piece, given as the array of the ids of its
    bytes, written as a string of one character an id.

    The fold holds the ids so far and the rank of each neighbouring pair,
    with an edge on either side that is in no pair; a step merges the pair of
    lowest rank, the leftmost of equals, and looks up the two pairs it
    changes.  Without a mergeable pair a step changes nothing.  A single id
    stays as it is.
    """

    def fold(table: Column) -> Column:
        def rank(pair: Column) -> Column:
            own = F.get(table, F.shiftright(F.crc32(pair.cast("binary")), HASH_SHIFT).cast("int"))
            return F.substring(F.call_function("substring_index", own, pair, F.lit(-1)), 2, 1)

        n = F.length(start)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(start, i, F.lit(2))))
        state = F.struct(F.concat(F.lit(EDGE), start, F.lit(EDGE)).alias("p"), F.concat(F.lit(NONE), F.array_join(pairs, ""), F.lit(NONE)).alias("r"))

        def step(acc: Column, _: Column) -> Column:
            p, r = acc["p"], acc["r"]

            def at(k: Column) -> Column:
                low = F.substring(r, k, F.lit(1))
                done = F.struct(p.alias("p"), F.lit("").alias("r"))
                around = lambda q: F.concat(rank(F.substring(q, k - 1, F.lit(2))), rank(F.substring(q, k, F.lit(2))))
                merged = _let(F.overlay(p, low, k, F.lit(2)), lambda q: F.struct(q.alias("p"), F.overlay(r, around(q), k - 1, F.lit(3)).alias("r")))
                return F.when(low == NONE, done).otherwise(merged)

            return F.when(r == "", acc).otherwise(_let(_locate(F.array_min(F.split(r, "")), r), at))

        return F.aggregate(F.sequence(F.lit(2), n), state, step, lambda acc: F.call_function("replace", acc["p"], F.lit(EDGE), F.lit("")))

    whole = F.when(F.length(start) < 2, start).otherwise(_let(ranks, fold))
    return F.transform(F.split(whole, ""), lambda c: F.ascii(c) - FIRST)


def decode_ids(ids: Column, tokens: Column) -> Column:
    """binary: the tokens of ``ids``, concatenated."""
    return _let(tokens, lambda table: F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.element_at(table, i + 1))))


class _Dictionary:
    """Encoded pieces of a stretch as flat arrays, indexed by piece number."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.id_at = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def add(self, ids: pa.ListArray, raw: pa.BinaryArray) -> None:
        data, bounds = flat_text(raw)
        sizes = np.diff(np.asarray(ids.offsets))
        self.pending.append((np.asarray(ids.flatten()).astype("<u4"), sizes, data, np.diff(bounds)))

    def settle(self) -> None:
        if self.pending:
            ids, sizes, data, lengths = zip(*self.pending)
            self.pending = []
            self.ids, self.raw = np.concatenate([self.ids, *ids]), np.concatenate([self.raw, *data])
            self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(np.concatenate(sizes))])
            self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(np.concatenate(lengths))])

    @staticmethod
    def gather(flat: np.ndarray, at: np.ndarray, refs: np.ndarray) -> np.ndarray:
        sizes = at[refs + 1] - at[refs]
        return flat[np.repeat(at[refs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


_PIECES = "kind int, doc_id long, piece string, refs binary"


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded binary) for every row of ``docs``; with
    ``packed`` the ids are binary, little-endian words of 32 bits.

    ``pattern`` splits a text into pieces that are encoded separately; text
    between matches, if any, is dropped as the pattern says.  There are no
    special tokens.  A null or empty text has no ids and decodes to empty
    bytes.  Pieces of any length are folded whole, in time that grows with the
    square of their bytes: one of 32,000 letters takes about half a minute.
    """
    splitter = regex.compile(pattern)
    single = [sign(ranks[bytes([b])]) for b in range(256)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.string()), ("refs", pa.binary())])
        for batch in batches:
            _, bounds = flat_text(batch.column(1))
            for lo, hi in slices(bounds, CHUNK_BYTES):
                if len(known) >= MAX_PIECES:
                    known = {}
                    yield pa.RecordBatch.from_pylist([{"kind": 2}], schema=schema)
                before, refs = len(known), []
                number = known.setdefault
                for text in batch.column(1)[lo:hi].to_pylist():
                    refs.append(np.array([number(p, len(known)) for p in splitter.findall(text)] if text else [], dtype="<i4").tobytes())
                if len(known) > before:
                    fresh = [p.encode() for p in list(known)[before:]]
                    for k in range(0, len(fresh), 20_000):
                        part = [sign(ranks[x]) if x in ranks else "".join([single[c] for c in x]) for x in fresh[k : k + 20_000]]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(part, pa.string()), pa.nulls(n, pa.binary())], schema=schema)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), batch.column(0)[lo:hi], pa.nulls(n, pa.string()), pa.array(refs, pa.binary())], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _Dictionary()
        for batch in batches:
            kind = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(kind)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kind)]):
                if hi == lo:
                    continue
                own = batch.slice(lo, hi - lo)
                if kind[lo] == 2:
                    book.clear()
                elif kind[lo] == 0:
                    book.add(own.column(3), own.column(4))
                else:
                    book.settle()
                    for at in range(0, own.num_rows, 256):
                        refs = [np.frombuffer(r, "<i4").astype(np.int64) for r in own.column(2)[at : at + 256].to_pylist()]
                        ids = [book.gather(book.ids, book.id_at, r) for r in refs]
                        raw = [book.gather(book.raw, book.raw_at, r).tobytes() for r in refs]
                        if packed:
                            flat = pa.array([x.tobytes() for x in ids], pa.binary())
                        else:
                            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([own.column(1)[at : at + 256], flat, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.coalesce(parts_for(source, "text", max(8, 2 * docs.sparkSession.sparkContext.defaultParallelism), TASK_BYTES))
    pieces = source.mapInArrow(split, _PIECES).withColumn("ids", encode_piece(F.col("piece"), rank_literal(ranks)))
    decoded = pieces.select("kind", "doc_id", "refs", "ids", decode_ids(F.col("ids"), token_literal(ranks)).alias("raw"))
    kind = "binary" if packed else "array<int>"
    return decoded.mapInArrow(join, f"doc_id long, ids {kind}, decoded binary").withColumnRenamed("doc_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of packed ids."""
    size = (F.octet_length("ids") / 4).cast("long")
    return encoded.select(id_col, size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
