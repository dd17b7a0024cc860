"""Noise samplers, negative edges and pair sampling.

A sampler is a function ``(edges, centers(draw, center)) -> (draw, center,
context)``; any such callable can stand in for the ones here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ranking import SMALL_LIMIT, among_first, first_rows
from graphloom.functions.scalar import u01
from graphloom.functions.session import cut_lineage, drop, keep
from graphloom.operators import blocks
from graphloom.operators.graph import degrees, dense_codes, nodes_of
from graphloom.operators.walks import draw, draw_from_one

NodeSampler = Callable[[DataFrame, DataFrame], DataFrame]


def _one_row(centers: DataFrame, table: DataFrame, use: str, seed: int) -> DataFrame:
    """Draw every context from one distribution ``table(dst, w)``."""
    return draw_from_one(centers.select("draw", "center"), table, u01(use, F.col("draw"), seed)).select("draw", "center", F.col("dst").alias("context"))


def configuration_noise(seed: int = 0) -> NodeSampler:
    """Contexts in proportion to in-weight."""

    def sample(edges: DataFrame, centers: DataFrame) -> DataFrame:
        return _one_row(centers, edges.groupBy("dst").agg(F.sum("w").alias("w")), "noise-config", seed)

    return sample


def uniform_noise(seed: int = 0) -> NodeSampler:
    """Contexts uniform over the nodes."""

    def sample(edges: DataFrame, centers: DataFrame) -> DataFrame:
        return _one_row(centers, nodes_of(edges).select(F.col("id").alias("dst"), F.lit(1.0).alias("w")), "noise-uniform", seed)

    return sample


def context_probability(edges: DataFrame, groups: DataFrame, window: int = 10, degree_corrected: bool = True) -> DataFrame:
    """(grp, dst, w): closed form of the block sampler's P(node | center's group)."""
    step = blocks.block_steps(edges, groups, window)
    mass = degrees(edges).select(F.col("id").alias("dst"), F.col("in_w").alias("m")) if degree_corrected else groups.select(F.col("id").alias("dst"), F.lit(1.0).alias("m"))
    own = mass.join(groups.select(F.col("id").alias("dst"), F.col("grp").alias("g2")), "dst")
    share = own.where("m > 0").select("dst", "g2", (F.col("m") / F.greatest(F.sum("m").over(Window.partitionBy("g2")), F.lit(1e-12))).alias("share"))
    return step.select(F.col("src").alias("grp"), F.col("dst").alias("g2"), F.col("w").alias("step")).join(share, "g2").select("grp", "dst", (F.col("step") * F.col("share")).alias("w"))


def block_noise(groups: DataFrame, window: int = 10, degree_corrected: bool = True, seed: int = 0) -> NodeSampler:
    """A block by the window's block transitions, then a node of the block by
    in-weight or uniformly: two small draws instead of one wide one."""

    def sample(edges: DataFrame, centers: DataFrame) -> DataFrame:
        step = blocks.block_steps(edges, groups, window)
        asked = centers.join(groups.select(F.col("id").alias("center"), F.col("grp").alias("src")), "center").select("draw", "center", "src")
        first = draw(asked, step, u01("noise-block", F.col("draw"), seed)).select("draw", "center", F.col("dst").alias("src"))
        mass = degrees(edges).select("id", F.col("in_w").alias("w")) if degree_corrected else groups.select("id", F.lit(1.0).alias("w"))
        inside = mass.join(groups, "id").select(F.col("grp").alias("src"), F.col("id").alias("dst"), "w")
        return draw(first, inside, u01("noise-node", F.col("draw"), seed)).select("draw", "center", F.col("dst").alias("context"))

    return sample


def joint_centers(edges: DataFrame, n: int, seed: int = 0, floor: float = 1e-26) -> DataFrame:
    """(draw, center): ``n`` centers by in-weight."""
    ids = edges.sparkSession.range(n).select(F.col("id").alias("draw"), F.lit(None).cast("long").alias("center"))
    mass = degrees(edges).select(F.col("id").alias("dst"), F.greatest("in_w", F.lit(floor)).alias("w"))
    return _one_row(ids, mass, "joint-center", seed).select("draw", F.col("context").alias("center"))


def embedding_noise(vectors: DataFrame, k: int = 10, seed: int = 0) -> NodeSampler:
    """Contexts among the k nearest by inner product, by softmax of the scores."""

    def sample(edges: DataFrame, centers: DataFrame) -> DataFrame:
        from graphloom.operators.evaluate import nearest

        near = nearest(vectors, k)
        options = near.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.exp(F.col("score") - F.max("score").over(Window.partitionBy("id"))).alias("w"))
        asked = centers.select("draw", "center", F.col("center").alias("src"))
        return draw(asked, options, u01("noise-embedding", F.col("draw"), seed)).select("draw", "center", F.col("dst").alias("context"))

    return sample


def categorical(rows: DataFrame, matrix: DataFrame, seed: int = 0) -> DataFrame:
    """(draw, src, dst): one stored entry of each asked row, by weight."""
    return draw(rows.select("draw", "src"), matrix, u01("categorical", F.col("draw"), seed))


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst", "w")


def negative_edges(edges: DataFrame, nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(src, dst), src < dst: ``n`` distinct non-edges without loops.

    Candidate k draws both ends from hashes.  As many candidates as the
    density makes likely to suffice are drawn at once, twice as many if they
    did not; the first ``n`` by candidate number stay.  With fewer than ``n``
    non-edges all of them are returned.  ``nodes(id)`` is numbered 0..N-1.
    """
    spark = edges.sparkSession
    taken = keep(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    size = nodes.count()
    free = size * (size - 1) // 2 - taken.where("src <> dst").count()
    if n >= free:  # all that there are
        ids = spark.range(size)
        every = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id"), F.lit(size - 1))).alias("dst")).where("src < dst") if size else spark.createDataFrame([], "src long, dst long")
        return every.join(taken, ["src", "dst"], "left_anti")
    # each candidate is one of size^2 / 2 pairs; the last of n free ones of ``free`` comes after about this many
    tries = 64 + int(1.2 * size * size / 2 * math.log(free / (free - n)) + 4 * math.sqrt(n))
    while True:
        k = spark.range(tries).withColumnRenamed("id", "k")
        a = F.floor(u01("neg-a", F.col("k"), seed) * size).cast("long")
        b = F.floor(u01("neg-b", F.col("k"), seed) * size).cast("long")
        pairs = k.select("k", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src < dst")
        first = pairs.groupBy("src", "dst").agg(F.min("k").alias("k")).join(taken, ["src", "dst"], "left_anti")
        first = keep(first)
        if first.count() >= n:
            return (first_rows(first, n, F.col("k")) if n <= SMALL_LIMIT else first.where(among_first(first, n, "k"))).select("src", "dst")
        drop(first)
        tries *= 2


def community_pairs(groups: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, a, b, y): uniform pairs of nodes 0..N-1, y = 1 within a group."""
    size = groups.count()
    draws = groups.sparkSession.range(n).withColumnRenamed("id", "draw")
    end = lambda use: F.floor(u01(use, F.col("draw"), seed) * size).cast("long")
    pairs = draws.select("draw", end("pair-a").alias("a"), end("pair-b").alias("b"))
    ga, gb = groups.toDF("a", "ga"), groups.toDF("b", "gb")
    return pairs.join(ga, "a").join(gb, "b").select("draw", "a", "b", (F.col("ga") == F.col("gb")).cast("int").alias("y"))


def balanced_pairs(groups: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, a, b, y): for each draw a uniform node a with a uniform member of
    its group, itself included (y = 1), and a uniform node with one of
    another group (y = 0).  Draws of a graph with one group have no y = 0.

    Nodes are numbered by (group, id), so that a group is a range of numbers
    and every partner is one draw and one look-up.
    """
    pairs = groups.where("id is not null and grp is not null").select(F.struct("grp", "id").alias("_node"))
    codes = dense_codes(pairs, "_node").select(F.col("_node.id").alias("id"), F.col("_node.grp").alias("grp"), "code")
    ranges = codes.groupBy("grp").agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(codes.join(ranges, "grp"))
    size = placed.count()
    draws = groups.sparkSession.range(n).withColumnRenamed("id", "draw").select("draw", F.explode(F.array(F.lit(1), F.lit(0))).alias("y"))
    u = lambda use: u01(use, F.col("draw"), F.col("y"), seed)
    own = draws.withColumn("code", F.floor(u("balanced-a") * size).cast("long")).join(placed, "code").withColumnRenamed("id", "a")
    inside = F.col("first") + F.floor(u("balanced-b") * F.col("n"))
    rest = F.floor(u("balanced-b") * (size - F.col("n")))
    outside = F.when(F.col("n") < size, F.when(rest < F.col("first"), rest).otherwise(rest + F.col("n")))
    asked = own.select("draw", "a", "y", F.when(F.col("y") == 1, inside).otherwise(outside).cast("long").alias("code"))
    return asked.join(placed.select("code", F.col("id").alias("b")), "code").select("draw", "a", "b", "y")


def sample_rows(df: DataFrame, n: int, *key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: the smallest hash draws of their keys."""
    keyed = df.withColumn("_u", u01("sample", *(F.col(k) for k in key), seed))
    return first_rows(keyed, n, F.col("_u"), *(F.col(k) for k in key)).select(*df.columns)


def permuted(df: DataFrame, *key: str, seed: int = 0) -> DataFrame:
    """(…, position draw): a random order as a sortable column."""
    return df.withColumn("position", u01("permute", *(F.col(k) for k in key), seed))


def triplets(pairs: DataFrame, edges: DataFrame, noise: NodeSampler, joint: bool = False, seed: int = 0) -> DataFrame:
    """(draw, center, context, noise[, noise_center]): every pair of
    ``offset_windows`` with one noise context; ``joint`` draws the noise
    center too.  A pair is known by its walk, step and offset."""
    numbered = pairs.select(F.concat_ws(":", "walk_id", "step", "offset").alias("draw"), "center", "context")
    numbered = cut_lineage(numbered)
    if not joint:
        drawn = noise(edges, numbered.select("draw", "center")).select("draw", F.col("context").alias("noise"))
        return numbered.join(drawn, "draw")
    mass = degrees(edges).select(F.col("id").alias("dst"), F.greatest("in_w", F.lit(1e-26)).alias("w"))
    centers = _one_row(numbered.select("draw", "center"), mass, "joint-center", seed).select("draw", F.col("context").alias("center"))
    drawn = noise(edges, centers).select("draw", F.col("center").alias("noise_center"), F.col("context").alias("noise"))
    return numbered.join(drawn, "draw")
