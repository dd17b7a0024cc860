"""Near-duplicate embeddings by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and a fast Hadamard
transform and takes the nearest vertex of the cross-polytope, that is the
coordinate of largest size with its sign.  ``hashes`` of them make a bucket
of one table.  A vector is kept under its own bucket in each table and asks
at the buckets it was nearest to as well (multiprobe: the vertices next in
line, cheapest combinations first).  Every pair that meets is verified.

A group of copies would meet in as many pairs as the square of its size.
So exact copies are one class first, and classes are gathered into balls: a
class joins the first class it meets in a bucket, in an order drawn by hash,
if the angle to it is at most half the angle that links.  Any two members
of a ball are linked then, without being compared.  Buckets hold balls, and
a pair of balls is decided at once by the angle of their centres and their
radii where the triangle inequality decides it; members are compared only
where it does not.  Counts are exact for all pairs that are found.

What stays quadratic: a group whose members are linked but stand further
apart than half the linking angle are balls of their own, and each pair of
them that meets is a candidate row.  The joins that make and verify these
are split by adaptive execution; nothing is gathered in one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.arrow_text import mix64
from graphloom.llm.components import components
from graphloom.llm.exact_topk import usable
from graphloom.llm.shared import cut_lineage, join_classes

THRESHOLD = 0.9
#: Vertices of one hash that are tried, the nearest first.
VERTICES = 4
#: Angles closer than this to a bound are not decided by it.
SLACK = 1e-7
SLICE = 2048


def plan(n: int, width: int) -> tuple[int, int, int]:
    """(hashes, tables, probes): as many hashes as give every vector a bucket of
    its own, more probes and tables the finer the buckets are.

    At 64 dimensions a pair at cosine 0.9 is missed about once in 2,000 with
    two, three or four hashes; closer pairs are missed less often.
    """
    vertices = 2 * width
    hashes = 1
    while vertices**hashes < n and hashes < 8:
        hashes += 1
    return hashes, 8 if hashes <= 3 else 4 * hashes - 4, min(VERTICES << (hashes - 1), VERTICES**hashes, min(VERTICES, width) ** hashes)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, width a power of two, not scaled."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def vertices(x: np.ndarray, seed: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``few`` nearest vertices of every turned row, nearest first, and what
    each is worse by: squared differences of the coordinates' sizes."""
    signs = np.random.default_rng(seed)
    width = x.shape[1]
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], width)) / math.sqrt(width)
    size = np.abs(x)
    best = np.argpartition(-size, min(few, width) - 1, axis=1)[:, : min(few, width)]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
    values = np.take_along_axis(size, best, 1)
    return 2 * best + (np.take_along_axis(x, best, 1) < 0), (values[:, :1] - values) ** 2


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket numbers of every row in one table: its own first, then the next likely ones."""
    few = min(VERTICES, x.shape[1]) if probes > 1 else 1
    combos = np.array(list(itertools.product(range(few), repeat=hashes)))
    code = np.full((len(x), len(combos)), table, np.uint64)
    cost = np.zeros((len(x), len(combos)))
    for k in range(hashes):
        found, worse = vertices(x, 1000 * table + k, few)
        with np.errstate(over="ignore"):
            code = code * np.uint64(2 * x.shape[1] + 1) + found[:, combos[:, k]].astype(np.uint64)
        cost += worse[:, combos[:, k]]
    cheap = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    with np.errstate(over="ignore"):
        return mix64(np.take_along_axis(code, cheap, 1) + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles; short ones get zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    values = np.asarray(column.flatten().cast(pa.float64()))
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _classes(good: DataFrame, width: int) -> DataFrame:
    """(node, h1, h2, low, size, u): one row for each different vector, known by
    128 bits of hash; ``low`` is its smallest id."""
    grouped = good.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], _lists(units(rows_of(batch.column(4), width)))], names=["h1", "h2", "low", "size", "u"])

    made = grouped.mapInArrow(run, "h1 long, h2 long, low long, size long, u array<double>")
    return cut_lineage(made.select(F.monotonically_increasing_id().alias("node"), "*"))


def _entries(vectors: DataFrame, name: str, width: int, hashes: int, tables: int, probes: int) -> DataFrame:
    """(name, key, own): every bucket of every row; ``own`` marks those it is kept under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                x = rows_of(some.column(1), width)
                ids = np.asarray(some.column(0))
                for table in range(tables):
                    keys = buckets(x, table, hashes, probes)
                    wide = keys.shape[1]
                    own = np.zeros(keys.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, wide)), pa.array(keys.ravel()), pa.array(own.ravel())], names=[name, "key", "own"])

    return vectors.select(name, "u").mapInArrow(run, f"{name} long, key long, own boolean")


def _with_cosine(pairs: DataFrame, left: str = "u", right: str = "w") -> DataFrame:
    """The cosine of two columns of unit vectors, in their place."""
    kept = [c for c in pairs.columns if c not in (left, right)]
    schema = T.StructType([*(pairs.schema[c] for c in kept), T.StructField("cos", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.num_columns - k) for k in (2, 1))
            width = len(a[0]) if batch.num_rows else 1
            cos = np.einsum("ij,ij->i", rows_of(a, width), rows_of(b, width))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(cos)], names=[*kept, "cos"])

    return pairs.select(*kept, left, right).mapInArrow(run, schema)


def _balls(classes: DataFrame, width: int, hashes: int, tables: int, half: float) -> DataFrame:
    """(node, low, size, u, ball, cos): each class with the centre of its ball and the cosine to it."""
    own = _entries(classes, "node", width, hashes, tables, 1).select("node", "key")
    lead = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("draw"), "node")).alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = lead.where("n > 1").select("key", F.col("lead.node").alias("ball"), "n")
    met = cut_lineage(join_classes(own, lead, ["key"], "n").where("node <> ball").select("node", "ball").distinct())
    centres = met.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).join(classes.select(F.col("node").alias("ball"), F.col("u").alias("w")), "ball")
    near = _with_cosine(join_classes(met.join(classes.select("node", "u"), "node"), centres, ["ball"], "n")).where(F.col("cos") >= half)
    first = near.groupBy("node").agg(F.min(F.struct(F.xxhash64("ball").alias("draw"), "ball", "cos")).alias("to"))
    joined = classes.join(first, "node", "left")
    return cut_lineage(joined.select("node", "low", "size", "u", F.coalesce("to.ball", "node").alias("ball"), F.coalesce("to.cos", F.lit(1.0)).alias("cos")))


def _verdict(angle: float, cos: str, *radii: str):
    """1: every pair linked, 0: none, null: members have to be compared.  Without radii the cosine decides."""
    reach = sum((F.col(r) for r in radii), F.lit(0.0))
    apart = F.acos(F.least(F.greatest(F.col(cos), F.lit(-1.0)), F.lit(1.0)))
    by_bound = F.when(apart + reach <= angle - SLACK, 1).when(apart - reach >= angle + SLACK, 0)
    return F.when(reach == 0, (F.col(cos) >= math.cos(angle)).cast("int")).otherwise(by_bound)


def _ball_links(members: DataFrame, balls: DataFrame, pairs: DataFrame, angle: float, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pairs of balls add up to: (ball, n) to each member of a ball,
    (node, n) to single classes, and (a, b) links between balls."""
    left = balls.select(F.col("ball").alias("a"), F.col("u"), F.col("radius").alias("ra"), F.col("total").alias("na"))
    right = balls.select(F.col("ball").alias("b"), F.col("u").alias("w"), F.col("radius").alias("rb"), F.col("total").alias("nb"))
    exact = lambda verdict: F.when((F.col("ra") == 0) & (F.col("rb") == 0), (F.col("cos") >= threshold).cast("int")).otherwise(verdict)
    seen = cut_lineage(_with_cosine(pairs.join(left, "a").join(right, "b")).withColumn("linked", exact(_verdict(angle, "cos", "ra", "rb"))).where("linked is null or linked = 1"))
    whole = seen.where("linked = 1")
    to_ball = whole.select(F.col("a").alias("ball"), F.col("nb").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("na").alias("n")))

    # members of the first ball against the centre of the second
    open_pairs = seen.where("linked is null").select("a", "b", "rb", "nb")
    inside = members.select(F.col("ball").alias("a"), "node", "size", "u")
    against = _with_cosine(open_pairs.join(inside, "a").join(right.select("b", "w"), "b"))
    exact = lambda verdict: F.when(F.col("rb") == 0, (F.col("cos") >= threshold).cast("int")).otherwise(verdict)
    seen_in = cut_lineage(against.withColumn("linked", exact(_verdict(angle, "cos", "rb"))).where("linked is null or linked = 1"))
    half = seen_in.where("linked = 1")
    to_ball = to_ball.unionByName(half.select(F.col("b").alias("ball"), F.col("size").alias("n")))
    to_node = half.select("node", F.col("nb").alias("n"))

    # members against members
    rest = seen_in.where("linked is null").select("a", "b", "node", "size")
    others = members.select(F.col("ball").alias("b"), F.col("node").alias("other"), F.col("size").alias("more"), F.col("u").alias("w"))
    faced = rest.join(others, "b").join(members.select("node", "u"), "node")
    linked = cut_lineage(_with_cosine(faced).where(F.col("cos") >= threshold))
    to_node = to_node.unionByName(linked.select("node", F.col("more").alias("n"))).unionByName(linked.select(F.col("other").alias("node"), F.col("size").alias("n")))
    links = whole.select("a", "b").unionByName(half.select("a", "b").distinct()).unionByName(linked.select("a", "b").distinct())
    total = lambda rows, key: rows.groupBy(key).agg(F.sum("n").alias("n"))
    return total(to_ball, "ball"), total(to_node, "node"), links


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in doubles, is
    ``threshold`` or more and they were found; ``n_links`` counts a row's
    linked rows and ``component_id`` is the smallest id that links reach.
    Vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null id, link with nothing; a null id has a
    null component and is not kept.  A shorter vector counts as filled up
    with zeros.  Repeated rows are linked with each other; rows that share an
    id are rows of their own.  An empty table gives an empty table.  Different
    vectors are told apart by 128 bits of hash.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    v = F.col(f"`{vector_col}`")
    fine = F.col(f"`{id_col}`").isNotNull() & usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), fine.alias("fine"), F.when(fine, v).alias("v"))
    bad = rows.where("not fine").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    good = rows.where("fine").select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    longest = good.agg(F.max(F.size("v"))).first()[0]
    if not longest:
        return bad
    width = 1 << max(0, longest - 1).bit_length()
    classes = _classes(good, width)
    hashes, tables, probes = plan(classes.count(), width)
    angle = math.acos(threshold)
    members = _balls(classes, width, hashes, tables, math.cos(angle / 2 - SLACK))
    shape = members.groupBy("ball").agg(F.sum("size").alias("total"), F.min("low").alias("least"), F.min("cos").alias("cos"))
    radius = F.when(F.col("cos") >= 1.0, F.lit(0.0)).otherwise(F.acos("cos") + SLACK)
    balls = cut_lineage(shape.join(classes.select(F.col("node").alias("ball"), "u"), "ball").select("ball", "total", "least", radius.alias("radius"), "u"))

    held = cut_lineage(_entries(members, "ball", width, hashes, tables, probes).groupBy("key", "ball").agg(F.max("own").alias("own")))
    asking, kept = held.select("key", F.col("ball").alias("a")), held.where("own").select("key", F.col("ball").alias("b"))
    pairs = asking.join(kept, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    to_ball, to_node, links = _ball_links(members, balls, pairs, angle, threshold)

    roots = balls.join(components(links).withColumnRenamed("node", "ball"), "ball", "left").select("ball", "total", "least", F.coalesce("root", "ball").alias("root"))
    lowest = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_balls"))
    of_ball = join_classes(roots.select("ball", "total", "root"), lowest, ["root"], "n_balls").join(to_ball, "ball", "left")
    of_ball = of_ball.select("ball", "component_id", (F.col("total") - 1 + F.coalesce("n", F.lit(0))).alias("base"))
    sized = members.groupBy("ball").agg(F.count(F.lit(1)).alias("n_members"))
    found = join_classes(members.select("node", "ball"), of_ball.join(sized, "ball"), ["ball"], "n_members").join(to_node, "node", "left")
    found = found.select("node", "component_id", (F.col("base") + F.coalesce("n", F.lit(0))).alias("n_links"))
    by_class = classes.select("node", "h1", "h2", "size").join(found, "node").drop("node")
    out = join_classes(good.select("id", "h1", "h2"), by_class, ["h1", "h2"], "size")
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(bad)
