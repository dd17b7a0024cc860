"""Benchmark graphs with planted communities: power-law degrees and sizes.

Each node has a degree from a truncated power law, each community a size from
another; ``1 - mu`` of a node's edges end in its community.  Ends of edges are
dealt in random order and neighbours in it are joined, within communities and
between them; ends that made a loop or a repeated edge are dealt again with
those of as many good edges, in rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ranking import running_sums
from graphloom.functions.scalar import u01
from graphloom.functions.session import cut_lineage
from graphloom.operators.graph import swapped


def power_law(u: Column, low: float, high: float, exponent: float) -> Column:
    """A number in [low, high) with density x^-exponent, from a uniform draw."""
    if exponent == 1:
        return low * F.pow(F.lit(high / low), u)
    a, b = low ** (1 - exponent), high ** (1 - exponent)
    return F.pow(a + u * (b - a), F.lit(1 / (1 - exponent)))


def mean_of(low: float, high: float, exponent: float) -> float:
    """The mean of ``power_law``."""

    def mass(e: float) -> float:
        return math.log(high / low) if e == -1 else (high ** (e + 1) - low ** (e + 1)) / (e + 1)

    return mass(1 - exponent) / mass(-exponent)


def lowest_for(mean: float, high: float, exponent: float) -> float:
    """The lower end that gives ``power_law`` this mean; ``ValueError`` if none does."""
    low, top = 1e-3, float(high)
    if not mean_of(low, high, exponent) <= mean < high:
        raise ValueError("no power law up to the largest degree has this mean")
    for _ in range(200):
        mid = (low + top) / 2
        low, top = (mid, top) if mean_of(mid, high, exponent) < mean else (low, mid)
    return low


def drawn_degrees(nodes: DataFrame, mean: float, largest: int, exponent: float, seed: int = 0) -> DataFrame:
    """(id, degree): rounded power-law degrees, one at least."""
    x = power_law(u01("degree", F.col("id"), seed), lowest_for(mean, largest, exponent), largest, exponent)
    return nodes.select("id", F.greatest(F.lit(1), F.floor(x + 0.5)).cast("long").alias("degree"))


def drawn_communities(nodes: DataFrame, smallest: int, largest: int, exponent: float, seed: int = 0) -> DataFrame:
    """(id, grp, size): nodes in random order fill communities of power-law sizes
    one after the other; a rest smaller than ``smallest`` joins the last one."""
    total = nodes.count()
    one = F.lit(1).cast("long").alias("one")
    order = running_sums(nodes.select("id", u01("place", F.col("id"), seed).alias("u"), one), [F.col("u"), F.col("id")], {"rank": "one"}).select("id", (F.col("rank") - 1).alias("place"))
    size = F.floor(power_law(u01("size", F.col("id"), seed), smallest, largest + 1, exponent)).cast("long")
    offered = nodes.sparkSession.range(max(1, -(-total // smallest))).select(F.col("id").alias("grp"), F.least(size, F.lit(largest)).alias("n"))
    ends = running_sums(offered, [F.col("grp")], {"stop": "n"}).withColumn("first", F.col("stop") - F.col("n"))
    used = ends.where(F.col("first") < F.lit(total) - (smallest - 1) * (F.col("first") > 0).cast("int"))
    last = used.agg(F.max("grp").alias("last"))
    spans = used.join(F.broadcast(last)).select("grp", "first", F.when(F.col("grp") == F.col("last"), F.lit(total)).otherwise(F.col("stop")).alias("stop"))
    spans = cut_lineage(spans.withColumn("size", F.col("stop") - F.col("first")))
    # a node's place in the order falls into one span: both meet on stretches of places
    stretch = max(1, largest)
    cut = spans.withColumn("k", F.explode(F.sequence(F.floor(F.col("first") / stretch), F.floor((F.col("stop") - 1) / stretch))))
    asked = order.withColumn("k", F.floor(F.col("place") / stretch))
    return asked.join(cut, "k").where("place >= first and place < stop").select("id", "grp", "size")


def _dealt(stubs: DataFrame, by: tuple[str, ...], number: int, use: str, seed: int) -> DataFrame:
    """(*by, src, dst, ga, gb): ends in a random order, joined two by two within ``by``; an odd one stays alone."""
    keyed = stubs.withColumn("_u", u01(use, F.col("id"), F.col("k"), number, seed)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(keyed, [F.col("_u"), F.col("id"), F.col("k")], {"_rank": "_one"}, by)
    pairs = ranked.groupBy(*by, F.floor((F.col("_rank") - 1) / 2).alias("_pair")).agg(F.collect_list(F.struct("id", "grp", "k")).alias("ends"))
    return pairs.where(F.size("ends") == 2).select(*by, *(F.col("ends")[i][c].alias(n) for i, c, n in ((0, "id", "src"), (0, "k", "ka"), (0, "grp", "ga"), (1, "id", "dst"), (1, "k", "kb"), (1, "grp", "gb"))))


def joined(stubs: DataFrame, inside: bool, seed: int = 0, rounds: int = 12) -> DataFrame:
    """(src, dst), src < dst, from ends ``stubs(id, grp, k)``: random partners of
    one community (``inside``) or of different ones, without loops and repeats.

    Ends that found no partner after ``rounds`` rounds are left out: few where
    degrees are small against communities, more where communities are nearly full.
    """
    use, by = ("stub-in", ("grp",)) if inside else ("stub-out", ())
    good, loose = None, cut_lineage(stubs)
    for number in range(rounds):
        met = _dealt(loose, by, number, use, seed).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "ka", "ga", "dst", "kb", "gb")
        allowed = (F.col("src") != F.col("dst")) & ((F.col("ga") == F.col("gb")) if inside else (F.col("ga") != F.col("gb")))
        offer = met.where(allowed).withColumn("old", F.lit(0))
        every = offer if good is None else good.withColumn("old", F.lit(-1)).unionByName(offer)
        first = every.groupBy("a", "b").agg(F.min(F.struct("old", "src", "ka", "ga", "dst", "kb", "gb")).alias("e")).select("a", "b", *(F.col(f"e.{c}") for c in ("src", "ka", "ga", "dst", "kb", "gb")))
        good = cut_lineage(first)
        held = good.select(F.col("src").alias("id"), F.col("ka").alias("k")).unionByName(good.select(F.col("dst").alias("id"), F.col("kb").alias("k")))
        bad = cut_lineage(stubs.join(held, ["id", "k"], "left_anti"))
        n = bad.count()
        if n <= 1 or number == rounds - 1:
            return good.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        # as many good edges are given up, so that the rest can find partners
        kept = good.count()
        give = F.pmod(F.xxhash64("a", "b", F.lit(number)), F.lit(1 << 20)) < F.lit(int(min(1.0, n / max(kept, 1)) * (1 << 20)))
        freed = good.where(give)
        ends = freed.select(F.col("src").alias("id"), F.col("ga").alias("grp"), F.col("ka").alias("k")).unionByName(freed.select(F.col("dst").alias("id"), F.col("gb").alias("grp"), F.col("kb").alias("k")))
        good, loose = good.where(~give), cut_lineage(bad.select("id", "grp", "k").unionByName(ends))
    return good.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def benchmark_graph(nodes: DataFrame, mean: float, largest: int, mu: float, sizes: tuple[int, int], degree_exponent: float = 2.0, size_exponent: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, groups): a graph over ``nodes(id)``, both directions with weight 1,
    and its communities (id, grp).

    About ``mu`` of a node's edges leave its community.  A node with more
    inner edges than its community has other nodes has the rest outside.
    """
    if not 0 <= mu <= 1:
        raise ValueError("mu is a share")
    own = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    spread = cut_lineage(drawn_degrees(own, mean, largest, degree_exponent, seed).join(drawn_communities(own, *sizes, size_exponent, seed), "id"))
    exact = F.col("degree") * (1 - mu)
    inner = F.floor(exact + u01("inner", F.col("id"), seed)).cast("long")  # rounded up by chance, so that the mean is kept
    marked = spread.withColumn("inner", F.least(inner, F.col("size") - 1))
    ends = lambda count: marked.where(count > 0).select("id", "grp", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("k"))
    pairs = joined(ends(F.col("inner")), True, seed).unionByName(joined(ends(F.col("degree") - F.col("inner")), False, seed))
    edges = pairs.withColumn("w", F.lit(1.0))
    return edges.unionByName(swapped(edges)), spread.select("id", "grp")
