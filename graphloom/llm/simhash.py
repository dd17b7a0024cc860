"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint is cut into seven blocks.  Two fingerprints that
differ in at most four bits agree on at least three whole blocks, so every
close pair shares one of the 35 block triples; a triple holds 27 or more
bits, which keeps chance meetings rare up to billions of fingerprints.
Fingerprints are joined on (triple, value) and verified by Hamming
distance.  Only distinct fingerprints take part, so copies never multiply.

Looser similarities are met exactly by ``similar_texts``: two shingle sets
of Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles of
either in any common order, here rare ones first (counted on a sample, which
bears on the cost only).  Pairs that share one are verified on the whole
sets.  Sets stay in memory-mapped files of the shared folder, only prefix
shingles and row keys are shuffled.

Within one shared value the operator emits a spanning forest of the links
(at most one link per fingerprint), never all pairs.  A value shared by
more than ``HOT`` fingerprints is cut into blocks of ``HOT``; each pair of
blocks is verified as a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_text import flat_text, mix64, slices
from graphloom.llm.components import components
from graphloom.llm.hash_store import by_part, new_folder, read_arrays, write_arrays
from graphloom.llm.shared import cut_lineage, join_classes, spare

HOT = 4096

#: One byte of a hash spread over eight byte-wide counters.
_SPREAD = np.array([sum(1 << (8 * k) for k in range(8) if b >> k & 1) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, width: int, lower: bool = True) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words, repeats included."""
    tokens = (text.lower() if lower else text).split()
    if not tokens:
        return []
    if len(tokens) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), 42)]
    joined = b" ".join(tokens)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])]


def plain_words(text: bytes) -> bytes:
    """The words of a UTF-8 text in lower case, of all scripts, one space apart."""
    return " ".join(text.decode("utf-8", "surrogateescape").lower().split()).encode("utf-8", "surrogateescape")


def fold_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits per row; ``counts`` hashes belong to each row in turn."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    runs = -(-sizes // 255)
    run_row = np.repeat(np.arange(len(full)), runs)
    run_no = np.arange(len(run_row)) - np.repeat(np.cumsum(runs) - runs, runs)
    lanes = _SPREAD[np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8).T)]
    part = np.add.reduceat(lanes, firsts[run_row] + run_no * 255, axis=1)
    bits = np.ascontiguousarray(part).view(np.uint8).reshape(8, len(run_row), 8).astype(np.int64)
    per_row = np.add.reduceat(bits, np.cumsum(runs) - runs, axis=1)
    ones = (2 * per_row > sizes[None, :, None]).transpose(1, 0, 2).reshape(len(full), 64)
    out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): the SimHash of every whole text.

    A null text is empty; a text without words has fingerprint zero; with
    fewer words than ``width`` the whole sequence is its one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_text(batch.column(1))
            whole = data.tobytes()
            prints = np.zeros(batch.num_rows, np.uint64)
            for lo, hi in slices(bounds):
                each = [shingle_hashes(whole[bounds[i] : bounds[i + 1]], width) for i in range(lo, hi)]
                flat = np.array([h for row in each for h in row], dtype=np.uint64)
                prints[lo:hi] = fold_bits(flat, np.array([len(row) for row in each], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(run, f"{id_col} long, fp long")


def block_masks(bits: int = 64, distance: int = 4, shared: int = 3) -> list[int]:
    """Masks of every choice of ``shared`` out of ``distance + shared`` blocks."""
    n = distance + shared
    cuts = [bits * k // n for k in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, shared)]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning_links(count: int, near: Callable) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the close pairs among ``count``;
    ``near(rows, x)`` tells which rows are close to x."""
    left, found = np.arange(count), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = near(left, x)
            if close.any():
                hit = left[close]
                found += [(x, int(y)) for y in hit]
                queue += hit.tolist()
                left = left[~close]
    return found


def cross_links(n: int, m: int, near_a: Callable, near_b: Callable) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs between two blocks of ``n`` and
    ``m``: ``near_a`` takes rows of the first and one of the second."""
    rows, cols = np.arange(n), np.arange(m)
    found: list[tuple[int, int]] = []
    while len(rows) and len(cols):
        queue, rows = [(0, int(rows[0]))], rows[1:]
        while queue:
            side, x = queue.pop()
            near, left = (near_b, cols) if side == 0 else (near_a, rows)
            if not len(left):
                continue
            close = near(left, x)
            if close.any():
                hit = left[close]
                found += [(x, int(y)) if side == 0 else (int(y), x) for y in hit]
                queue += [(1 - side, int(y)) for y in hit]
                if side == 0:
                    cols = cols[~close]
                else:
                    rows = rows[~close]
    return found


_LINK = "a long, b long, value long, block int, members binary"
_LINK_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64()), ("block", pa.int32()), ("members", pa.binary())])


def _pairs_table(pairs: list[np.ndarray], hot: list[tuple[int, int, bytes]]) -> pa.Table:
    flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    n, h = len(flat), len(hot)
    return pa.table(
        [
            pa.array(np.concatenate([flat[:, 0], np.zeros(h, np.int64)])),
            pa.array(np.concatenate([flat[:, 1], np.zeros(h, np.int64)])),
            pa.array(np.array([0] * n + [x[0] for x in hot], np.int64)),
            pa.array(np.array([-1] * n + [x[1] for x in hot], np.int32)),
            pa.array([None] * n + [x[2] for x in hot], pa.binary()),
        ],
        schema=_LINK_ARROW,
    )


def _links(nodes: DataFrame, values_of: Callable, near_of: Callable, pairs_close: Callable, parts: int | None) -> DataFrame:
    """(a, b): links that connect exactly the nodes which chains of verified
    pairs connect, where a pair is tried if it shares a value.

    ``values_of(batch)`` gives node keys (int64) and values (uint64), row by
    row; ``near_of(a, b)`` gives ``near(rows of a, one of b)`` for two arrays
    of keys, ``pairs_close(a, b)`` compares them one by one.
    """
    spark = nodes.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal (value, key) to parts; one packed row per part and batch."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 13):
                rows, values = values_of(batch.slice(lo, 1 << 13))
                part = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                for p, idx in by_part(part):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.stack([values[idx], rows[idx].view(np.uint64)]).tobytes()], pa.binary())], names=["part", "packed"])

    def meet(table: pa.Table) -> pa.Table:
        both = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in table.column("packed")], axis=1)
        order = np.lexsort((both[1], both[0]))
        values, keys = both[0][order], both[1][order].view(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        sizes = np.diff(np.append(starts, len(values)))
        pairs: list[np.ndarray] = []
        two = starts[sizes == 2]
        tried = np.unique(np.stack([keys[two], keys[two + 1]], axis=1), axis=0)
        for lo in range(0, len(tried), 1 << 13):
            at = tried[lo : lo + (1 << 13)]
            pairs.append(at[pairs_close(at[:, 0], at[:, 1])])
        hot: list[tuple[int, int, bytes]] = []
        seen: set[bytes] = set()
        for s, m in zip(starts[sizes > 2], sizes[sizes > 2]):
            group = keys[s : s + m]
            same = group.tobytes()
            if same in seen:
                continue
            seen.add(same)
            for k in range(0, m, HOT):
                own = group[k : k + HOT]
                got = spanning_links(len(own), near_of(own, own))
                if got:
                    pairs.append(own[np.array(got)])
                if m > HOT:
                    hot.append((int(values[s].view(np.int64)), k // HOT, own.tobytes()))
        flat = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return _pairs_table([flat], hot)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                got = cross_links(len(a), len(b), near_of(a, b), near_of(b, a))
                if got:
                    at = np.array(got)
                    yield pa.RecordBatch.from_arrays([pa.array(a[at[:, 0]]), pa.array(b[at[:, 1]])], names=["a", "b"])

    met = cut_lineage(nodes.mapInArrow(spread, "part int, packed binary").groupBy("part").applyInArrow(meet, _LINK))
    blocks = met.where("block >= 0").select("value", "block", "members")
    # pairs of blocks are dealt by their numbers alone; each pair is verified where it lands
    numbers = blocks.select("value", "block")
    later = numbers.withColumnRenamed("block", "next")
    pairs = numbers.join(later, "value").where("block < next")
    sides = pairs.join(blocks, ["value", "block"]).join(blocks.toDF("value", "next", "others"), ["value", "next"])
    crossed = sides.repartition("value", "block", "next").select("members", "others").mapInArrow(verify, "a long, b long")
    return met.where("block < 0").select("a", "b").unionByName(crossed)


def links(prints: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """``prints(fp long)``, distinct -> (a, b) connecting all fingerprints that
    chains of pairs at ``distance`` or fewer bits connect."""
    masks = np.array(block_masks(distance=distance), dtype=np.uint64)

    def values_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = np.asarray(batch.column(0))
        with np.errstate(over="ignore"):
            return np.repeat(keys, len(masks)), mix64((keys.view(np.uint64)[:, None] & masks) ^ mix64(masks + np.uint64(1))).ravel()

    def near_of(a: np.ndarray, b: np.ndarray) -> Callable:
        return lambda rows, x: _apart(a[rows, None], b[x]) <= distance

    return _links(prints.select("fp"), values_of, near_of, lambda a, b: _apart(a[:, None], b[:, None]) <= distance, parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint can be reached by
    links of ``distance`` or fewer bits, the row's own included.  Rows with
    equal fingerprints are always together, word-less texts (fingerprint
    zero) too.  A row whose id is null keeps its row and takes part; ids are
    compared without nulls, so a class of null ids only has a null
    component.  Repeated ids are separate rows.  Other columns are ignored.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, width))
    firsts = marked.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("size"))
    firsts = cut_lineage(firsts)
    rooted = components(links(firsts.select("fp"), distance)).withColumnRenamed("node", "fp")
    linked = cut_lineage(firsts.join(rooted, "fp"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    found = join_classes(linked, lowest, ["root"], "_n").select("fp", "component_id", "size")
    alone = firsts.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"), "size")
    return join_classes(marked, found.unionByName(alone), ["fp"]).select(id_col, "fp", "component_id")


SKETCH_WORDS = 32
SAMPLE_TEXTS = 10_000
COMMON = 1 << 18


def sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles over ``SKETCH_WORDS * 64`` cells: two
    sketches never differ in more bits than their sets in shingles."""
    bits = SKETCH_WORDS * 64
    out = np.zeros((len(starts) - 1, SKETCH_WORDS), np.uint64)
    for lo in range(0, len(out), 512):
        n = min(512, len(out) - lo)
        own = flat[starts[lo] : starts[lo + n]]
        row = np.repeat(np.arange(n), np.diff(starts[lo : lo + n + 1]))
        odd = np.bincount(row * bits + (own & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
        out[lo : lo + n] = np.packbits(odd.reshape(n, bits).astype(bool), axis=1, bitorder="little").view(np.uint64)
    return out


class ShingleSets:
    """Sorted shingle sets in files; a key is file and row, 20 bits of row."""

    def __init__(self, folder: str, similarity: float) -> None:
        self.folder, self.similarity = folder, similarity

    def _file(self, number: int) -> list[np.ndarray]:
        return [np.asarray(x) for x in read_arrays(self.folder, f"sets-{number}", ["<i8", "<u8", "<u8"])]

    def sets(self, keys: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(keys)
        for f, idx in by_part(keys >> 20):
            starts, flat, _ = self._file(f)
            for i in idx:
                row = int(keys[i]) & 0xFFFFF
                out[i] = flat[starts[row] : starts[row + 1]]
        return out

    def heads(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and sketches."""
        sizes, prints = np.zeros(len(keys), np.int64), np.zeros((len(keys), SKETCH_WORDS), np.uint64)
        for f, idx in by_part(keys >> 20):
            starts, _, sketch = self._file(f)
            row = keys[idx] & 0xFFFFF
            sizes[idx] = starts[row + 1] - starts[row]
            prints[idx] = sketch.reshape(-1, SKETCH_WORDS)[row]
        return sizes, prints

    def limit(self, total: np.ndarray) -> np.ndarray:
        """Most shingles in which two sets of ``total`` together may differ."""
        return total * (1 - self.similarity) / (1 + self.similarity) + 1e-9

    def _verified(self, one: int, others: np.ndarray) -> np.ndarray:
        mine, out = self.sets(np.array([one]))[0], np.zeros(len(others), bool)
        for lo in range(0, len(others), 256):
            each = self.sets(others[lo : lo + 256])
            sizes = np.array([len(x) for x in each])
            flat = np.concatenate(each)
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            out[lo : lo + 256] = len(mine) + sizes - 2 * both <= self.limit(len(mine) + sizes)
        return out

    def near_of(self, a: np.ndarray, b: np.ndarray) -> Callable:
        (size_a, print_a), (size_b, print_b) = self.heads(a), self.heads(b)

        def near(rows: np.ndarray, x: int) -> np.ndarray:
            apart = np.maximum(_apart(print_a[rows], print_b[x]), np.abs(size_a[rows] - size_b[x]))
            out = apart <= self.limit(size_a[rows] + size_b[x])
            if out.any():
                out[out] = self._verified(int(b[x]), a[rows[out]])
            return out

        return near

    def pairs_close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (size_a, print_a), (size_b, print_b) = self.heads(a), self.heads(b)
        out = np.maximum(_apart(print_a, print_b), np.abs(size_a - size_b)) <= self.limit(size_a + size_b)
        for i in np.flatnonzero(out):
            out[i] = self._verified(int(a[i]), b[i : i + 1])[0]
        return out


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, group, first_id) of every row: groups of texts linked by chains of
    pairs whose shingle sets have a Jaccard similarity of ``similarity`` or
    more.  All such pairs are found, and no other ones are linked.  Words end at
    white space and are compared in lower case, both as Unicode has them.

    ``first_id`` is the smallest id of the group.  Texts without words are
    one group, equal texts always share one; null ids are as in
    ``near_duplicates``.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_folder(spark, "shingles")
    kept = ShingleSets(folder, similarity)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().taskAttemptId() << 20
        for batch in batches:
            data, bounds = flat_text(batch.column(1))
            whole = data.tobytes()
            nodes, checks, places = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, -1, np.int64)
            for lo, hi in slices(bounds):
                each = [np.unique(np.array(shingle_hashes(plain_words(whole[bounds[i] : bounds[i + 1]]), width, False), np.uint64)) for i in range(lo, hi)]
                sizes = np.array([len(x) for x in each], np.int64)
                starts, flat = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(each)
                write_arrays(folder, f"sets-{number}", [starts.astype("<i8"), flat, sketches(flat, starts).ravel()])
                nodes[lo:hi] = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in each], np.uint64).view(np.int64)
                checks[lo:hi] = np.array([xxhash.xxh64_intdigest(x.tobytes(), 8) for x in each], np.uint64).view(np.int64)
                places[lo:hi] = np.where(sizes > 0, (number << 20) + np.arange(hi - lo), -1)
                number += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(checks), pa.array(places)], names=["id", "node", "check", "place"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # texts of one shingle set are one node, known by 128 bits of its hashes
    marked = cut_lineage(source.mapInArrow(store, "id long, node long, check long, place long"))
    nodes = cut_lineage(marked.groupBy("node", "check").agg(F.min("id").alias("first_id"), F.min("place").alias("place"), F.count(F.lit(1)).alias("size")))
    filled = nodes.where("place >= 0").select("place")
    share = int(min(1.0, SAMPLE_TEXTS / max(filled.count(), 1)) * (1 << 20))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in kept.sets(np.asarray(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["h"])

    sample = filled.where(F.pmod(F.xxhash64("place"), F.lit(1 << 20)) < share).mapInArrow(shingles, "h long")
    rows = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    common = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(common)
    common, times = common[order], np.array([r.n for r in rows], np.int64)[order]

    def values_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = np.asarray(batch.column(0))
        out_keys, out_values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo in range(0, len(keys), 1024):
            each = kept.sets(keys[lo : lo + 1024])
            sizes = np.array([len(x) for x in each])
            flat, row = np.concatenate(each), np.repeat(np.arange(len(each)), sizes)
            often = np.zeros(len(flat), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                often = np.where(common[at] == flat, times[at], 0)
            by = np.lexsort((flat, often, row))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            take = rank < first[row]
            out_keys.append(keys[lo : lo + 1024][row[take]])
            out_values.append(flat[by][take])
        return np.concatenate(out_keys), np.concatenate(out_values)

    placed = filled.repartitionByRange(parts, "place").sortWithinPartitions("place")
    rooted = components(_links(placed, values_of, kept.near_of, kept.pairs_close, None)).toDF("place", "root")
    linked = cut_lineage(nodes.join(rooted, "place"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("low"), F.count(F.lit(1)).alias("_n"))
    found = join_classes(linked, lowest, ["root"], "_n").select("node", "check", F.col("root").alias("group"), F.col("low").alias("first_id"), "size")
    # the places of texts with words are distinct and not negative, so that they name groups
    alone = nodes.join(linked.select("node", "check"), ["node", "check"], "left_anti").select("node", "check", F.col("place").alias("group"), "first_id", "size")
    named = join_classes(marked.select("id", "node", "check"), found.unionByName(alone), ["node", "check"])
    return named.select(F.col("id").alias(id_col), "group", "first_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of
    ``similar_texts`` the row with the smallest id stays (a null id last, then
    by a hash of id and text).  Rows that agree in id and text are one
    document and stay once, whatever their other columns hold."""
    own, other = spare(docs.columns, "row_key"), spare(docs.columns, "row_check")
    keyed = docs.withColumns({own: F.xxhash64(id_col, text_col), other: F.xxhash64(text_col, F.lit(1), id_col)})
    slim = keyed.select(F.col(own).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    grouped = similar_texts(slim, "key", "text", width, similarity).select("key", "group").distinct()
    named = slim.select("key", "id").distinct().join(grouped, "key")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key")))
    kept = cut_lineage(named.groupBy("group").agg(first.alias("first")).select(F.col("first.key").alias(own)))
    return keyed.join(kept, own, "left_semi").dropDuplicates([own, other]).select(docs.columns)
