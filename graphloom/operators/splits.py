"""Train and test splits of a graph's edges for link prediction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ranking import among_first
from graphloom.functions.scalar import u01
from graphloom.functions.session import cut_lineage, drop, keep, spread_join
from graphloom.operators.graph import components, dense_codes, nodes_of, spanning_tree, symmetrised, without_loops
from graphloom.operators.samplers import negative_edges


@dataclass(frozen=True)
class Split:
    train: DataFrame  # (src, dst, w), both directions
    test: DataFrame  # (src, dst), src < dst
    negative: DataFrame  # (src, dst), src < dst


def held_out_edges(edges: DataFrame, fraction: float = 0.5, seed: int = 0, tree: str = "weight") -> DataFrame:
    """(src, dst), src < dst: ``fraction`` of the edges, none of them in the
    minimum spanning forest, so that no component falls apart.

    Raises ``ValueError`` if too few edges lie outside the forest.  This is
    the set-based form of removing edges one by one while the graph stays
    connected: each removed edge leaves a spanning tree untouched.  ``tree``
    says which forest is kept: that of the weights, or a ``random`` one, by
    which any edge on a cycle can be held out.
    """
    if tree not in ("weight", "random"):
        raise ValueError(f"unknown tree {tree!r}")
    return _outside_forest(keep(without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))), fraction, seed, tree)


def _outside_forest(plain: DataFrame, fraction: float, seed: int, tree: str) -> DataFrame:
    """``held_out_edges`` of edges that stand once each, src < dst."""
    weighed = plain if tree == "weight" else plain.withColumn("w", u01("tree", F.col("src"), F.col("dst"), seed))
    kept = cut_lineage(spanning_tree(weighed).select("src", "dst"))
    free = keep(plain.select("src", "dst").join(kept, ["src", "dst"], "left_anti"))
    want = int(plain.count() * fraction)
    if free.count() < want:
        raise ValueError("fewer edges outside the spanning forest than asked for")
    keyed = free.withColumn("_u", u01("split", F.col("src"), F.col("dst"), seed))
    return keyed.where(among_first(keyed, want, "_u", "src", "dst")).select("src", "dst")


def held_out_edges_by_search(edges: DataFrame, fraction: float = 0.5, seed: int = 0) -> DataFrame:
    """(src, dst), src < dst: ``fraction`` of the edges, so that no component falls apart.

    A round takes as many random edges as are still wanted, none with an end
    of degree one, and looks for a way between the ends of each over the edges
    that the round leaves in place: all are searched at once, by components,
    so that no edge carries a front of nodes of its own.  Edges with a way go,
    all at once, for none of the ways uses another; the rest go back.  A round
    that finds none takes edges outside a spanning forest, which can always
    go.  Raises ``ValueError`` if too few can.
    """
    left = keep(without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    taken, want, number = None, int(left.count() * fraction), 0
    while want > 0:
        ends = left.select(F.col("src").alias("id")).unionAll(left.select(F.col("dst").alias("id")))
        single = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("id")
        single = cut_lineage(single)
        drawn = left.withColumn("_u", u01("search-split", F.col("src"), F.col("dst"), number, seed))
        spare = []
        if single.take(1):  # without, all may be tried, and a draw alone tells who is
            able = left.join(single.toDF("src"), "src", "left_anti").join(single.toDF("dst"), "dst", "left_anti").select("src", "dst")
            able = keep(able.withColumn("_u", u01("search-split", F.col("src"), F.col("dst"), number, seed)))
            tried = keep(able.where(among_first(able, want, "_u", "src", "dst")).select("src", "dst"))
            rest = keep(left.join(tried, ["src", "dst"], "left_anti"))
            spare = [able, rest]
        else:
            first = among_first(drawn, want, "_u", "src", "dst")
            tried = keep(drawn.where(first).select("src", "dst"))
            rest = drawn.where(~first).select("src", "dst")
        label = cut_lineage(components(rest))
        once = keep(spread_join(tried, label.toDF("src", "a"), "src"))
        gone = keep(spread_join(once, label.toDF("dst", "b"), "dst").where("a = b").select("src", "dst"))
        found = gone.count()
        drop(tried, once, *spare)
        if not found:
            drop(gone)
            forest = spanning_tree(left.withColumn("w", u01("search-tree", F.col("src"), F.col("dst"), seed))).select("src", "dst")
            free = left.join(forest, ["src", "dst"], "left_anti").withColumn("_u", u01("search-free", F.col("src"), F.col("dst"), seed))
            free = keep(free)
            gone = keep(free.where(among_first(free, want, "_u", "src", "dst")).select("src", "dst"))
            drop(free)
            found = gone.count()
            if not found:
                raise ValueError("fewer edges can go than asked for")
        taken, want, number = gone if taken is None else taken.unionByName(gone), want - found, number + 1
        before = left
        if want > 0:
            left = keep(before.join(gone, ["src", "dst"], "left_anti"))
        drop(before)
    return left.limit(0) if taken is None else taken


def split(edges: DataFrame, fraction: float = 0.5, seed: int = 0) -> Split:
    """Train graph, held-out edges and as many non-edges."""
    plain = keep(without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("w", F.lit(1.0)))
    test = keep(_outside_forest(plain, fraction, seed, "weight"))
    train = symmetrised(plain.join(test, ["src", "dst"], "left_anti"))
    codes = cut_lineage(dense_codes(nodes_of(plain), "id"))
    coded = plain.join(codes.toDF("src", "a"), "src").join(codes.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    none = negative_edges(coded, codes.select(F.col("code").alias("id")), test.count(), seed)
    back = none.join(codes.toDF("x", "src"), "src").join(codes.toDF("y", "dst"), "dst")
    return Split(train, test, back.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")))


def labelled(parts: Split) -> DataFrame:
    """(src, dst, edge_type): +1 for held-out edges, -1 for non-edges."""
    return parts.test.withColumn("edge_type", F.lit(1)).unionByName(parts.negative.withColumn("edge_type", F.lit(-1)))
