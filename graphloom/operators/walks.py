"""Random walks, context windows and pair counts.

A step is an exact inverse-CDF draw by join: the draw ``u`` of a walker
falls into the half-open weight interval of one edge.  Running weights are
summed in two levels, within chunks of consecutive node numbers and over the
chunks of a row, so that no task sorts a hub's edges.  The cumulative table
is cut into buckets of about ``BUCKET`` edges, and walkers join on (node,
bucket), so that a hub is spread over many join keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import cantor, u01
from graphloom.functions.session import cut_lineage
from graphloom.functions.store import Rows, keep_rows
from graphloom.operators.graph import nodes_of, summed, transition

BUCKET = 64
CHUNK_BITS = 12
CUT_EVERY = 5


def cumulative(edges: DataFrame, keys: tuple[str, ...] = ("src",), value: str = "dst") -> DataFrame:
    """Adds ``lo``, ``hi``, ``tot``: the weight interval of each edge in its row.

    Each ``lo`` is the ``hi`` before it and ``tot`` is the last ``hi``, so
    that the intervals cover a row without a gap whatever weights round to.
    """
    plain = edges.where("w > 0").select(*keys, value, "w", F.shiftright(F.col(value), CHUNK_BITS).alias("_c"))
    local = Window.partitionBy(*keys, "_c").orderBy(value)
    upto = lambda last: F.sum("w").over(local.rowsBetween(Window.unboundedPreceding, last))
    inside = plain.select("*", F.coalesce(upto(-1), F.lit(0.0)).alias("_before"), upto(0).alias("_in"))
    chunks = inside.groupBy(*keys, "_c").agg(F.max("_in").alias("_all"))
    ahead = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    based = chunks.withColumn("_base", F.coalesce(F.sum("_all").over(ahead), F.lit(0.0)))
    based = based.select(*keys, "_c", "_base", F.max(F.col("_base") + F.col("_all")).over(Window.partitionBy(*keys)).alias("tot"))
    at = lambda c: F.col("_base") + F.col(c)
    return inside.join(based, [*keys, "_c"]).select(*keys, value, "w", at("_before").alias("lo"), at("_in").alias("hi"), "tot")


def cdf_table(edges: DataFrame) -> DataFrame:
    """W1: (src, dst, cum): cumulative transition probability of each row."""
    return cumulative(edges).select("src", "dst", (F.col("hi") / F.col("tot")).alias("cum"))


def _bucketed(edges: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Each interval once per bucket of its row that it touches."""
    cdf = cumulative(edges, keys, value)
    count = edges.where("w > 0").groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("buckets"))
    sized = cdf.join(count, list(keys))
    at = lambda c: F.least(F.floor(F.col(c) / F.col("tot") * F.col("buckets")), F.col("buckets") - 1)
    return sized.withColumn("bucket", F.explode(F.sequence(at("lo"), at("hi"))))


def draw(asks: DataFrame, edges: DataFrame, u: Column, keys: tuple[str, ...] = ("src",), value: str = "dst", how: str = "inner") -> DataFrame:
    """Adds ``value`` drawn by weight from the edges of each row's ``keys``.

    ``u`` is the row's uniform draw.  With ``how='left'`` rows without edges
    keep a null.
    """
    table = _bucketed(edges, keys, value)
    size = table.groupBy(*keys).agg(F.max("buckets").alias("_b"), F.max("tot").alias("_tot"))
    asked = asks.withColumn("_u", u).join(size, list(keys), "left" if how == "left" else "inner")
    asked = asked.withColumn("_k", F.least(F.floor(F.col("_u") * F.col("_b")), F.col("_b") - 1))
    right = table.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bucket").alias("_bucket"), "lo", "hi", F.col(value).alias("_value"))
    same = F.col("_k") == F.col("_bucket")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    hit = same & (F.col("_u") * F.col("_tot") >= F.col("lo")) & (F.col("_u") * F.col("_tot") < F.col("hi"))
    return asked.join(right, hit, how).select(*asks.columns, F.col("_value").alias(value))


def draw_from_one(asks: DataFrame, options: DataFrame, u: Column) -> DataFrame:
    """Adds ``dst`` drawn by weight from one distribution ``options(dst, w)``.

    Running weights are summed inside chunks of consecutive nodes and over
    the chunks; draws join on buckets of the whole range, so that no key
    stands for all nodes.
    """
    chunk = F.shiftright(F.col("dst"), CHUNK_BITS)
    inside = cut_lineage(options.where("w > 0").select(chunk.alias("src"), "dst", "w"))
    table = cumulative(inside, ("src",), "dst")
    chunks = table.groupBy("src").agg(F.max("tot").alias("w")).select(F.lit(0).cast("long").alias("root"), F.col("src").alias("chunk"), "w")
    # the chunks' own running sum: one row for each 4,096 nodes
    spans = cumulative(chunks, ("root",), "chunk").select("chunk", F.col("lo").alias("_lo"), F.col("tot").alias("_tot"))
    total = spans.agg(F.max("_tot").alias("_all"))
    asked = asks.withColumn("_u", u).join(F.broadcast(total)).withColumn("_x", F.col("_u") * F.col("_all"))
    full = table.join(spans, table["src"] == spans["chunk"]).select("dst", (F.col("_lo") + F.col("lo")).alias("lo"), (F.col("_lo") + F.col("hi")).alias("hi"), "_tot")
    count = F.greatest(F.lit(1), F.ceil(F.lit(inside.count() / BUCKET))).cast("long")
    at = lambda c: F.least(F.floor(F.col(c) / F.col("_tot") * count), count - 1)
    right = full.withColumn("_bucket", F.explode(F.sequence(at("lo"), at("hi"))))
    asked = asked.withColumn("_k", F.least(F.floor(F.col("_x") / F.col("_all") * count), count - 1))
    hit = (F.col("_k") == F.col("_bucket")) & (F.col("_x") >= F.col("lo")) & (F.col("_x") < F.col("hi"))
    return asked.join(right, hit).select(*asks.columns, "dst")


def start_walks(nodes: DataFrame, per_node: int) -> DataFrame:
    """(walk_id, start): walk_id = node * per_node + k."""
    return nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k")).select((F.col("id") * per_node + F.col("k")).alias("walk_id"), F.col("id").alias("start"))


def _as_steps(paths: DataFrame) -> DataFrame:
    return paths.select("walk_id", F.posexplode("path").alias("step", "node")).select("walk_id", F.col("step").cast("long").alias("step"), "node")


def walk(
    edges: DataFrame,
    starts: DataFrame,
    length: int,
    seed: int = 0,
    restart: float = 0.0,
    teleport: int | None = None,
    restart_at_sink: bool = False,
) -> DataFrame:
    """First-order walks: (walk_id, step, node), steps 0..length-1.

    With probability ``restart`` a step goes back to the start, or, with
    ``teleport`` = N, to a uniform node 0..N-1.  A walk ends at a node
    without out-edges, unless ``restart_at_sink`` sends it back.

    The bucketed table is built once; each of its rows carries the size of
    the row it leads to, so that a step is a single join.  A walker carries
    its path, so that no step is computed twice.
    """
    table = _bucketed(summed(edges), ("src",), "dst")
    table = cut_lineage(table)
    size = cut_lineage(table.groupBy("src").agg(F.max("buckets").alias("b"), F.max("tot").alias("tot")))
    options = table.select(F.col("src").alias("_src"), F.col("bucket").alias("_bucket"), "lo", "hi", "dst")
    options = cut_lineage(options.join(size.toDF("dst", "_nb", "_ntot"), "dst", "left"))
    now = starts.select("walk_id", "start").join(size.toDF("start", "home_b", "home_tot"), "start", "left")
    now = now.select("walk_id", "start", "home_b", "home_tot", F.col("start").alias("node"), F.col("home_b").alias("b"), F.col("home_tot").alias("tot"), F.array("start").alias("path"))
    key = F.col("walk_id")
    for t in range(1, length):
        asked = now.withColumn("_x", u01("walk", key, t, seed)).withColumn("_k", F.least(F.floor(F.col("_x") * F.col("b")), F.col("b") - 1))
        hit = (F.col("node") == F.col("_src")) & (F.col("_k") == F.col("_bucket")) & (F.col("_x") * F.col("tot") >= F.col("lo")) & (F.col("_x") * F.col("tot") < F.col("hi"))
        moved = asked.join(options, hit, "left")
        home = F.col("start") if teleport is None else F.floor(u01("teleport", key, t, seed) * teleport).cast("long")
        back = F.lit(False)
        if restart:
            back = back | ((u01("restart", key, t, seed) <= restart) & (F.col("dst").isNotNull() | F.lit(restart_at_sink)))
        if restart_at_sink:
            back = back | F.col("dst").isNull()
        moved = moved.withColumn("_back", back)
        pick = lambda there, here: F.when(F.col("_back"), there).otherwise(here)
        now = moved.select(
            "walk_id", "start", "home_b", "home_tot", pick(home, F.col("dst")).alias("node"), pick(F.col("home_b"), F.col("_nb")).alias("b"), pick(F.col("home_tot"), F.col("_ntot")).alias("tot"), "path"
        ).withColumn("path", F.when(F.col("node").isNotNull(), F.concat("path", F.array("node"))).otherwise(F.col("path")))
        if teleport is not None and (restart or restart_at_sink):
            now = now.drop("b", "tot").join(size.toDF("node", "b", "tot"), "node", "left")
        if t % CUT_EVERY == 0:
            now = cut_lineage(now)
    return _as_steps(now)


#: Walks that a task takes on at once.
WALKS = 8192
NOWHERE = np.iinfo(np.int64).min


def _draws(use: str, walks: list, steps: list, tries: list, seed: int) -> np.ndarray:
    """``u01`` of (use, walk, step, try, seed) outside Spark."""
    return np.array([int(hashlib.md5(f"{use}|{w}|{t}|{k}|{seed}".encode()).hexdigest()[:13], 16) for w, t, k in zip(walks, steps, tries)], np.int64) / float(1 << 52)


def _search(rows: Rows, nodes: np.ndarray, draws: np.ndarray | None = None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """In ``rows`` of running weights, (whether a node has edges, where its draw
    leads, ``NOWHERE`` past the last); or, of ``wanted``, whether it has an edge there."""
    met, value = np.zeros(len(nodes), bool), np.full(len(nodes), NOWHERE, np.int64)
    for (_, starts, dst, upto, _), at, own in rows.found(nodes):
        lo, end = starts[at], starts[at + 1]
        by, key = (upto, draws[own] * upto[end - 1]) if wanted is None else (dst, wanted[own])
        high = end.copy()
        while len(some := np.flatnonzero(lo < high)):
            mid = (lo[some] + high[some]) >> 1
            less = by[mid] <= key[some] if wanted is None else by[mid] < key[some]
            lo[some[less]] = mid[less] + 1
            high[some[~less]] = mid[~less]
        inside = lo < end
        if wanted is None:
            met[own] = True
            value[own[inside]] = dst[lo[inside]]
        else:
            met[own[inside]] = dst[lo[inside]] == key[inside]
    return met, value


def biased_walk(edges: DataFrame, starts: DataFrame, length: int, p: float, q: float, seed: int = 0, weighted: bool = True) -> DataFrame:
    """Second-order (node2vec) walks by rejection: (walk_id, step, node).

    A step proposes a first-order neighbour, by weight or, not ``weighted``,
    by its position in the row, and accepts it at bias / largest bias: 1/p for
    going back, 1 for a neighbour of the node before, 1/q elsewhere.  Only
    proposals are looked up, so no table of second-order options exists.

    Running weights are written once, as rows in files of the shared folder.
    A task takes some walks from their starts to their ends and looks rows up
    there, so that no step deals anything out.  Walks do not wait for each
    other.  A draw hangs on the walk, its step and the number of the try.  A walk ends at a node without out-edges;
    for p = q = 1 this is the first-order walk.
    """
    if p == q == 1:
        return walk(edges if weighted else edges.withColumn("w", F.lit(1.0)), starts, length, seed)
    edges = summed(edges).where("w > 0")
    rows = keep_rows(cumulative(edges if weighted else edges.withColumn("w", F.lit(1.0))).select("src", "dst", F.col("hi").alias("w")))
    back, near, far = 1.0 / p, 1.0, 1.0 / q
    top = max(back, near, far)

    def paths(names: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        path = np.zeros((len(start), length), np.int64)
        path[:, 0] = start
        step, tried, going = np.ones(len(start), np.int64), np.zeros(len(start), np.int64), np.arange(len(start) if length > 1 else 0)
        while len(going):
            said = names[going].tolist(), step[going].tolist(), tried[going].tolist(), seed
            has, to = _search(rows, path[going, step[going] - 1], draws=_draws("walk", *said))
            u = _draws("accept", *said) * top
            prev = path[going, np.maximum(step[going] - 2, 0)]
            bias = np.where(step[going] == 1, top, np.where(to == prev, back, min(near, far)))
            open_ = np.flatnonzero((step[going] > 1) & (to != prev) & (u >= min(near, far)) & (u < max(near, far)))
            bias[open_] = np.where(_search(rows, prev[open_], wanted=to[open_])[0], near, far)
            taken = has & (to != NOWHERE) & (u < bias)
            at = going[taken]
            path[at, step[at]] = to[taken]
            step[at] += 1
            tried[going] = np.where(taken, 0, tried[going] + 1)
            going = going[has & (step[going] < length)]
        inside = np.arange(length)[None, :] < step[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, step)), pa.array(np.nonzero(inside)[1]), pa.array(path[inside])], names=["walk_id", "step", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, WALKS):
                part = batch.slice(lo, WALKS)
                yield paths(part.column(0).to_numpy(), part.column(1).to_numpy())

    known = starts.where("walk_id is not null and start is not null").select(F.col("walk_id").cast("long").alias("walk_id"), F.col("start").cast("long").alias("start"))
    return known.repartition(4 * int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "walk_id").mapInArrow(run, "walk_id long, step long, node long")


def windows(walks: DataFrame, size: int, side: str = "double", trim: bool = False) -> DataFrame:
    """(walk_id, step, center, context) pairs at offsets up to ``size``.

    ``side`` is right, left or double; windows are cut at the ends.  ``trim``
    uses only centers with a whole right window.
    """
    return offset_windows(walks, size, side, trim).drop("offset")


def offset_windows(walks: DataFrame, size: int, side: str = "double", trim: bool = False) -> DataFrame:
    """``windows`` with the context's ``offset`` from its center.  One sort per
    walk: the neighbours come from lead and lag in the same window."""
    order = Window.partitionBy("walk_id").orderBy("step")
    reach = list(range(1, size + 1))
    at = lambda k: F.struct(F.lit(k).alias("offset"), (F.lead("node", k) if k > 0 else F.lag("node", -k)).over(order).alias("context"))
    take = [at(k) for k in (reach if side in ("right", "double") else [])] + [at(-k) for k in (reach if side in ("left", "double") else [])]
    wide = walks.select("walk_id", "step", F.col("node").alias("center"), F.array(*take).alias("near"), F.lead("node", size).over(order).alias("last"))
    if trim:
        wide = wide.where(F.col("last").isNotNull())
    return wide.select("walk_id", "step", "center", F.inline("near")).where(F.col("context").isNotNull()).select("walk_id", "step", "center", "context", "offset")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(center, context, freq)."""
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("freq"))


def pair_keys(counts: DataFrame) -> DataFrame:
    """Pair counts under one integer key."""
    return counts.select(cantor(F.col("center"), F.col("context")).alias("key"), "freq")


def context_transition(counts: DataFrame) -> DataFrame:
    """Empirical P(context | center) as an edge table."""
    return transition(counts.select(F.col("center").alias("src"), F.col("context").alias("dst"), F.col("freq").cast("double").alias("w")))


def center_share(counts: DataFrame) -> DataFrame:
    """(center, share) of all pairs."""
    per = counts.groupBy("center").agg(F.sum("freq").alias("n"))
    total = per.agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(total)).select("center", (F.col("n") / F.col("all")).alias("share"))


def transition_of(matrix: DataFrame, asked: DataFrame) -> DataFrame:
    """Point look-up: ``asked(src, dst)`` with ``w``, 0 where there is no entry."""
    return asked.join(matrix, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"))


def sentences(walks: DataFrame) -> DataFrame:
    """(walk_id, words): each walk as strings in order, missing nodes left out."""
    steps = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("step", F.col("node").cast("string").alias("word")))))
    return walks.groupBy("walk_id").agg(F.transform(steps, lambda s: s["word"]).alias("words"))


def batch_pairs(counts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` draws of a center by its share and a context by the center's row."""
    spark = counts.sparkSession
    centers = counts.groupBy("center").agg(F.sum("freq").cast("double").alias("w")).select(F.col("center").alias("dst"), "w")
    ids = spark.range(n).select(F.col("id").alias("draw"))
    first = draw_from_one(ids, centers, u01("batch-center", F.col("draw"), seed)).select("draw", F.col("dst").alias("src"))
    rows = counts.select(F.col("center").alias("src"), F.col("context").alias("dst"), F.col("freq").cast("double").alias("w"))
    return draw(first, rows, u01("batch-context", F.col("draw"), seed)).select("draw", F.col("src").alias("center"), F.col("dst").alias("context"))


WalkSampler = Callable[[DataFrame], DataFrame]


def walk_sampler(length: int = 40, per_node: int = 10, p: float = 1.0, q: float = 1.0, restart: float = 0.0, seed: int = 0) -> WalkSampler:
    """A function edges -> walks from every node."""

    def run(edges: DataFrame) -> DataFrame:
        starts = start_walks(nodes_of(edges), per_node)
        return biased_walk(edges, starts, length, p, q, seed) if (p, q) != (1, 1) else walk(edges, starts, length, seed, restart)

    return run
