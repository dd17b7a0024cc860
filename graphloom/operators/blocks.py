"""Block models and the residual matrix.

Tables over blocks are K x K and over nodes N x K; they are kept as rows
``(src, dst, w)`` like every matrix here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import safe_log
from graphloom.functions.session import cut_lineage
from graphloom.operators import linalg
from graphloom.operators.graph import degrees, dense_codes, nodes_of, transition


def block_matrix(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst, w) between groups: the summed weight."""
    a, b = groups.toDF("src", "ga"), groups.toDF("dst", "gb")
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("ga").alias("src"), F.col("gb").alias("dst")).agg(F.sum("w").alias("w"))


def block_parameters(edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(block weights, in-weight of each block (grp, din), block transitions
    with row sums below 1 raised to 1)."""
    weights = cut_lineage(block_matrix(edges, groups))
    din = weights.groupBy(F.col("dst").alias("grp")).agg(F.sum("w").alias("din"))
    return weights, din, transition(weights, 1.0)


def block_steps(edges: DataFrame, groups: DataFrame, window: int) -> DataFrame:
    """(1/T) sum_{t=1..T} of powers of the block transitions."""
    steps = cut_lineage(block_parameters(edges, groups)[2])
    return linalg.scaled(linalg.power_sum(steps, window), 1.0 / window)


def find_blocks(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(id, grp): SCORE: spherical k-means of the right singular vectors.

    With k of N - 1 or more each node is its own block.  A node without a
    vector, such as one that no edge leads to, is in block 0.
    """
    nodes = nodes_of(edges)
    n = nodes.count()
    if k >= n - 1:
        return dense_codes(nodes, "id", "grp")
    _, _, right = linalg.svd(edges, min(k, n - 1), seed=seed)
    found = linalg.spherical_kmeans(cut_lineage(right), k, 1 if n / k < 10 else 10, seed)
    return nodes.join(found, "id", "left").select("id", F.coalesce("grp", F.lit(0).cast("long")).alias("grp"))


def residual_matrix(edges: DataFrame, groups: DataFrame, null_groups: DataFrame, window: int, unreachable: str = "one") -> DataFrame:
    """(src, dst, w): positive residuals of walk transitions over a null model.

    With T = window, P the transitions, Psbm those of ``groups`` and Psbm0
    those of ``null_groups``: the node-to-block table is
    B = P U (Psbm + .. + Psbm^(T-1)) and the null table
    N0 = Psbm0 + .. + Psbm0^T.  A pair has h = ln(B[i, g_j] / Din[g_j]) -
    ln(N0[g0_i, g0_j] / Din0[g0_j]); entries that are zero count as ln 1.
    An edge adds ln(P_ij Din[g_j] + B[i, g_j] d_j) - ln d_j - ln B[i, g_j].
    Positive values stay.  ``unreachable='exclude'`` leaves out pairs whose
    B entry is zero instead of counting it as one.

    The result is the product of ``residual_terms``; it has N x N entries if
    dense, which only small graphs should ask for.
    """
    terms = residual_terms(edges, groups, null_groups, window, unreachable)
    return linalg.chain_sum(terms).where("w > 1e-12")  # what differs from zero by rounding only goes


def residual_parts(edges: DataFrame, groups: DataFrame, null_groups: DataFrame, window: int) -> dict[str, DataFrame]:
    """The tables of ``residual_matrix``."""
    p = cut_lineage(transition(edges))
    _, din, psbm = block_parameters(edges, groups)
    _, din0, psbm0 = block_parameters(edges, null_groups)
    near = linalg.matmul(p, groups.select(F.col("id").alias("src"), F.col("grp").alias("dst"), F.lit(1.0).alias("w")))
    node_block = linalg.matmul(near, linalg.power_sum(cut_lineage(psbm), window - 1)) if window > 1 else p.limit(0)
    null = linalg.power_sum(cut_lineage(psbm0), window).where("w <> 0").join(din0.toDF("dst", "din0"), "dst")
    null = null.select("src", "dst", safe_log(F.col("w") / F.greatest("din0", F.lit(1e-32))).alias("w"))
    d = degrees(edges).select("id", F.col("in_w").alias("d"))
    nodes = groups.join(null_groups.toDF("id", "g0"), "id").join(d, "id", "left").select("id", "grp", "g0", F.coalesce("d", F.lit(0.0)).alias("d"))
    return {"transition": p, "din": din, "node_block": cut_lineage(node_block.where("w <> 0")), "null": cut_lineage(null), "nodes": cut_lineage(nodes)}


def residual_terms(edges: DataFrame, groups: DataFrame, null_groups: DataFrame, window: int, unreachable: str = "one") -> list[list[DataFrame]]:
    """The same matrix as a sum of products, for ``linalg.svd``.

    A pair that no walk reaches has max(0, -ln N0) of its null groups: null
    group of the source times null group x block pair times block pair of the
    target.  Added to it are, for the block pairs a node reaches, what they
    differ from that, and a sparse correction on the edges.  No table has a
    row for each node and block; null groups meet block pairs only.
    """
    parts = residual_parts(edges, groups, null_groups, window)
    pairs = parts["nodes"].select(F.struct("grp", "g0").alias("pair"))
    codes = cut_lineage(dense_codes(pairs, "pair").select(F.col("pair.grp").alias("gj"), F.col("pair.g0").alias("g0j"), "code").join(parts["din"].toDF("gj", "din"), "gj", "left"))
    nodes = cut_lineage(parts["nodes"].join(codes.select(F.col("gj").alias("grp"), F.col("g0j").alias("g0"), "code"), ["grp", "g0"]))
    ln0 = parts["null"].toDF("g0i", "g0j", "ln0")
    positive = lambda c: F.greatest(F.lit(0.0), c)
    far = lambda c: -F.coalesce(F.col(c), F.lit(0.0))
    own = nodes.select("id", F.col("g0").alias("g0i"))
    reached = parts["node_block"].toDF("id", "gj", "b").join(own, "id").join(codes, "gj").join(ln0, ["g0i", "g0j"], "left")
    near = safe_log(F.col("b") / F.greatest("din", F.lit(1e-32))) + far("ln0")
    base = positive(far("ln0")) if unreachable == "one" else F.lit(0.0)
    reached = cut_lineage(reached.select(F.col("id").alias("src"), "code", "b", near.alias("h"), (positive(near) - base).alias("w")))
    member = cut_lineage(nodes.select(F.col("code").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")))
    terms = [[reached.where("w <> 0").select("src", F.col("code").alias("dst"), "w"), member]]
    if unreachable == "one":
        start = nodes.select(F.col("id").alias("src"), F.col("g0").alias("dst"), F.lit(1.0).alias("w"))
        table = ln0.join(codes.select("g0j", "code"), "g0j").select(F.col("g0i").alias("src"), F.col("code").alias("dst"), positive(far("ln0")).alias("w")).where("w > 0")
        terms.append([cut_lineage(start), cut_lineage(table), member])
    ends = nodes.select(F.col("id").alias("dst"), "code", "d")
    on_edges = parts["transition"].toDF("src", "dst", "p").join(ends, "dst").join(codes, "code").join(nodes.select(F.col("id").alias("src"), F.col("g0").alias("g0i")), "src")
    on_edges = on_edges.join(ln0, ["g0i", "g0j"], "left").join(reached.select("src", "code", "b", "h"), ["src", "code"], "left" if unreachable == "one" else "inner")
    b, h = F.coalesce("b", F.lit(0.0)), F.coalesce(F.col("h"), far("ln0"))
    gain = safe_log(F.col("p") * F.col("din") + b * F.col("d")) - safe_log(F.col("d")) - safe_log(b)
    sparse = cut_lineage(on_edges.select("src", "dst", (positive(h + gain) - positive(h)).alias("w")).where("w <> 0"))
    identity = sparse.select(F.col("dst").alias("src"), "dst", F.lit(1.0).alias("w")).distinct()
    return [*terms, [sparse, identity]]


def log_transition(edges: DataFrame, window: int, restart: float = 0.0, floor: float = 1e-6) -> DataFrame:
    """Log of the exact window-averaged transition on its stored entries."""
    walked = linalg.walk_sum(cut_lineage(transition(edges)), restart, window)
    return walked.select("src", "dst", safe_log(F.col("w"), floor).alias("w"))


def log_transition_blocks(edges: DataFrame, groups: DataFrame, window: int, exact_steps: int = 1, restart: float = 0.0, floor: float = 1e-6) -> DataFrame:
    """The same by blocks: the first ``exact_steps`` steps exact, later ones by
    block transitions and the in-weight share of the target in its block."""
    weights = [(1 - restart) ** i for i in range(window)]
    weights = [w / sum(weights) for w in weights]
    p = cut_lineage(transition(edges))
    _, din, psbm = block_parameters(edges, groups)
    psbm = cut_lineage(psbm)
    short = linalg.walk_sum(p, restart, min(exact_steps, window), 0, weights)
    if window <= exact_steps:
        return short.select("src", "dst", safe_log(F.col("w"), floor).alias("w"))
    near = linalg.matmul(p, groups.select(F.col("id").alias("src"), F.col("grp").alias("dst"), F.lit(1.0).alias("w")))
    later = linalg.walk_sum(psbm, restart, window - 1, exact_steps - 1, weights[1:])
    node_block = linalg.matmul(near, later)
    share = degrees(edges).join(groups, "id").join(din, "grp").select(F.col("grp").alias("src"), F.col("id").alias("dst"), (F.col("in_w") / F.greatest("din", F.lit(1e-32))).alias("w"))
    walked = linalg.plus(short, linalg.matmul(node_block, share.where("w > 0")))
    return walked.select("src", "dst", safe_log(F.col("w"), floor).alias("w"))


def approximation_blocks(n: int, beta: float = 0.66) -> int:
    """The number of blocks used to approximate a graph of ``n`` nodes."""
    return math.ceil(n**beta)


def approximation_quality(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """One row (n, pearson) over entries stored in both, log values near 0 left out."""
    both = exact.join(approx.withColumnRenamed("w", "v"), ["src", "dst"]).where("abs(w) > 1e-8 and abs(v) > 1e-8")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("w", "v").alias("pearson"))


def pair_codes(groups: DataFrame, null_groups: DataFrame) -> DataFrame:
    """(id, code): each (group, null group) combination numbered in order."""
    both = groups.join(null_groups.toDF("id", "g0"), "id").withColumn("pair", F.struct("grp", "g0"))
    ranked = both.select("grp", "g0").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("grp", "g0")) - 1)  # one row a combination
    return both.join(F.broadcast(ranked), ["grp", "g0"]).select("id", F.col("code").cast("long").alias("code"))
