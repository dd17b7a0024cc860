"""Best-fit packing by a plan over the histogram of piece lengths.

The histogram has at most ``capacity`` entries, so best-fit decreasing runs
on counts on the driver, whatever the number of documents: all open
sequences with the same room are one class, and the pieces of one length
are placed class by class.  The plan is a list of runs of slots, each run
standing for slots of one length at consecutive ranks.  Pieces learn their
rank within their length and take their slots by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import cut_lineage

CAPACITY = 2048
#: A plan of this many runs (48 bytes each) is broadcast; a longer one is joined by length.
MAX_RUNS = 1_000_000


@dataclass(frozen=True)
class Run:
    """Slots of ``length``: ranks ``rank`` .. ``rank + bins * depth - 1`` fill
    sequences ``first`` .. ``first + bins - 1``, ``depth`` in each from
    ``offset`` on."""

    length: int
    rank: int
    bins: int
    depth: int
    first: int
    offset: int


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts.

    Longest first; each goes to the fullest open sequence it fits, which for
    equal pieces means filling a sequence as deep as it goes.  A class of
    open sequences is a list of ranges of sequence numbers.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    next_id = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        levels = sorted(r for r in room if r >= length)
        while left:
            level = levels.pop(0) if levels else None
            if level is None:
                each = capacity // length
                ranges = [(next_id, -(-left // each))]
                next_id += ranges[0][1]
                level = capacity
            else:
                ranges = room.pop(level)
            each = level // length
            for at, (first, bins) in enumerate(ranges):
                full, rest = divmod(left, each)
                use = min(bins, full)
                if use:
                    runs.append(Run(length, rank, use, each, first, capacity - level))
                    room.setdefault(level - each * length, []).append((first, use))
                    rank, left = rank + use * each, left - use * each
                if use < bins and 0 < left < each:
                    runs.append(Run(length, rank, 1, left, first + use, capacity - level))
                    room.setdefault(level - left * length, []).append((first + use, 1))
                    rank, left, use = rank + left, 0, use + 1
                if use < bins:
                    room.setdefault(level, []).append((first + use, bins - use))
                if not left:
                    if ranges[at + 1 :]:
                        room.setdefault(level, []).extend(ranges[at + 1 :])
                    break
    return runs


def piece_rows(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and one end
    id, cut into pieces of ``capacity`` from the end on.

    With ``ranks_path`` the same vocabulary is applied by its rank file,
    which encodes several times faster to the same ids; a text it refuses
    is encoded by the tokenizer file.  A null text is empty: one end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded: list = []

        def slow(text: str) -> list[int]:
            if not loaded:
                loaded.append(Tokenizer.from_file(tokenizer_path))
            return loaded[0].encode(text, add_special_tokens=False).ids

        encode = slow
        if ranks_path:
            import json

            import public_tokenizers
            import tiktoken

            from graphloom.llm.byte_bpe import read_ranks

            ranks = read_ranks(ranks_path)
            with open(tokenizer_path) as f:
                special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
            fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def encode(text: str) -> list[int]:
                try:
                    return fast.encode(text, allowed_special="all", disallowed_special=())
                except Exception:  # noqa: BLE001  the pattern engine gives up on some very long texts
                    return slow(text)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                key, piece, start, length, crc = [], [], [], [], []
                for k, text in zip(batch.column(0)[lo : lo + 1024].to_pylist(), batch.column(1)[lo : lo + 1024].to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    n = len(ids)
                    cuts = [0, *range((n % capacity) or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        key.append(k)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["key", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", id_col)


def take_slots(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    The rank within a length is counted in two levels: over the partitions
    that hold pieces of the length, then within a partition, so that no task
    holds a length and tasks grow in number with the pieces.  Repeated rows
    take slots of their own.  No pieces, no slots.
    """
    spark = pieces.sparkSession
    salted = cut_lineage(pieces.withColumn("_salt", F.spark_partition_id()))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_runs(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = groups.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = spark.createDataFrame([(r.length, r.rank, r.rank + r.bins * r.depth, r.depth, r.first, r.offset) for r in runs], "length long, lo long, hi long, depth long, first long, place long")
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_local", local).join(base, ["length", "_salt"]).withColumn("_rank", F.col("base") + F.col("_local") - 1)
    slot = F.col("_rank") - F.col("lo")
    # The plan has a few runs a length and class of room: bounded by the capacity, not by the documents.
    small = F.broadcast(plan) if len(runs) <= MAX_RUNS else plan
    placed = ranked.join(small, (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).drop(plan["length"])
    return placed.select(*[c for c in pieces.columns], (F.col("first") + F.floor(slot / F.col("depth"))).cast("long").alias("sequence_id"), (F.col("place") + slot % F.col("depth") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row a piece with its slot."""
    return take_slots(piece_rows(docs, tokenizer_path, ranks_path, capacity, 0, id_col, text_col), capacity, id_col)
