"""Graph construction and cleaning.

A graph is ``edges(src long, dst long, w double)``; ``nodes(id)`` lists the
nodes where isolated ones matter and ``groups(id, grp)`` labels them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.ranking import first_rows, running_sums
from graphloom.functions.scalar import safe_inverse, u01
from graphloom.functions.session import cut_lineage, drop, keep, spread_join

EDGE = ("src", "dst", "w")


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "w") -> DataFrame:
    """Check and normalise an edge table; a missing weight column means 1.

    Raises ``ValueError`` on missing columns instead of guessing.
    """
    missing = {src, dst} - set(df.columns)
    if missing:
        raise ValueError(f"edge table lacks {sorted(missing)}")
    w = F.col(weight).cast("double") if weight in df.columns else F.lit(1.0)
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("w"))


def edges_of(spark: SparkSession, graph: object) -> DataFrame:
    """An edge table from any of: an edge table, a dense square array, a sparse
    matrix in coordinates (with ``row``, ``col``, ``data``, or made so by
    ``tocoo``), a graph object whose ``edges(data=True)`` gives (a, b, attributes),
    or pairs and triples.  A graph that is not directed gets both directions, a
    loop once.  ``ValueError`` for anything else.
    """
    import numpy as np

    if isinstance(graph, DataFrame):
        return as_edges(graph)
    if hasattr(graph, "tocoo"):
        graph = graph.tocoo()
    if all(hasattr(graph, c) for c in ("row", "col", "data")):
        columns = (graph.row, graph.col, graph.data)
    elif isinstance(graph, np.ndarray):
        if graph.ndim != 2 or graph.shape[0] != graph.shape[1]:
            raise ValueError("an array of weights has to be square")
        at = np.nonzero(graph)
        columns = (*at, graph[at])
    elif callable(getattr(graph, "edges", None)):
        rows = [(a, b, (said or {}).get("weight", 1.0)) for a, b, said in graph.edges(data=True)]
        if not getattr(graph, "is_directed", lambda: True)():
            rows += [(b, a, w) for a, b, w in rows if a != b]
        columns = tuple(zip(*rows)) if rows else ((), (), ())
    elif isinstance(graph, list | tuple) and all(isinstance(e, list | tuple) and len(e) in (2, 3) for e in graph):
        columns = tuple(zip(*((e[0], e[1], e[2] if len(e) == 3 else 1.0) for e in graph))) if graph else ((), (), ())
    else:
        raise ValueError(f"no graph: {type(graph).__name__}")
    import pyarrow as pa

    table = pa.table([pa.array(np.asarray(columns[0], np.int64)), pa.array(np.asarray(columns[1], np.int64)), pa.array(np.asarray(columns[2], float))], names=["src", "dst", "w"])
    return spark.createDataFrame(table)


def summed(edges: DataFrame) -> DataFrame:
    """One row an edge: weights of repeated edges add up."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def dense_codes(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, code): distinct non-null values numbered 0.. in their order.

    Values are range-partitioned and numbered by partition offsets, so the
    sort is distributed; only one count per partition meets in one place.
    """
    values = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(values, [F.col(key)], {"_rank": "_one"}).select(key, (F.col("_rank") - 1).alias(code))


def reindexed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ids 0..N-1, table id -> code)."""
    codes = dense_codes(nodes_of(edges), "id")
    a, b = codes.toDF("src", "s"), codes.toDF("dst", "d")
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w"), codes


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrised(edges: DataFrame) -> DataFrame:
    """A + A'."""
    return summed(edges.unionByName(swapped(edges)))


def upper_triangle(edges: DataFrame, diagonal: bool = False) -> DataFrame:
    return edges.where("src <= dst" if diagonal else "src < dst")


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def without_zeros(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0")


def weak_reciprocal(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """A + share * A'."""
    return summed(edges.unionByName(swapped(edges).withColumn("w", F.col("w") * share)))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_w, in_w) in one aggregation over both ends."""
    ends = edges.select(F.col("src").alias("id"), F.col("w").alias("o"), F.lit(0.0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0.0).alias("o"), F.col("w").alias("i"))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("out_w"), F.sum("i").alias("in_w"))


def mean_degree(edges: DataFrame) -> DataFrame:
    """One row: total weight over the number of nodes."""
    return degrees(edges).agg((F.sum("out_w") / F.count(F.lit(1))).alias("mean_degree"))


def directed_mix(edges: DataFrame, back: float) -> DataFrame:
    """(1 - eta) A + eta A' with eta = out b / (in (1 - b) + out b) per row
    node; a node without out-weight has eta 1, without in-weight 0."""
    eta = F.when(F.col("out_w") == 0, 1.0).when(F.col("in_w") == 0, 0.0).otherwise(F.col("out_w") * back / (F.col("in_w") * (1 - back) + F.col("out_w") * back))
    rate = degrees(edges).select(F.col("id").alias("src"), eta.alias("eta"))
    ahead = edges.join(rate, "src").select("src", "dst", (F.col("w") * (1 - F.col("eta"))).alias("w"))
    behind = swapped(edges).join(rate, "src").select("src", "dst", (F.col("w") * F.col("eta")).alias("w"))
    return summed(ahead.unionByName(behind))


def transition(edges: DataFrame, floor: float = 1e-32) -> DataFrame:
    """Rows divided by their sums; a node without out-edges stays without."""
    total = edges.groupBy("src").agg(F.sum("w").alias("_tot"))  # partial sums: a hub is summed before it is shuffled
    return edges.join(total, "src").select("src", "dst", (F.col("w") / F.greatest("_tot", F.lit(floor))).alias("w"))


def normalised_adjacency(edges: DataFrame, floor: float = 1e-12) -> DataFrame:
    """D^-1/2 A D^-1/2 with out-degrees, those below ``floor`` raised to it."""
    deg = edges.groupBy("src").agg(F.sum("w").alias("d"))
    scale = F.sqrt(safe_inverse(F.coalesce("d", F.lit(0.0)), floor))
    left = deg.select("src", scale.alias("a"))
    right = deg.select(F.col("src").alias("dst"), scale.alias("b"))
    away = F.sqrt(safe_inverse(F.lit(0.0), floor))
    joined = edges.join(left, "src").join(right, "dst", "left")
    return joined.select("src", "dst", (F.col("w") * F.col("a") * F.coalesce("b", away)).alias("w"))


def fairwalk_weights(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Each neighbour group of a node shares weight 1 equally; the weights of
    the input are dropped.  The default group is the out-degree class."""
    if groups is None:
        groups = edges.groupBy("src").agg(F.count(F.lit(1)).alias("grp")).select(F.col("src").alias("id"), "grp")
    labelled = edges.join(groups.select(F.col("id").alias("dst"), "grp"), "dst", "left").withColumn("grp", F.struct("grp"))  # null is a group too
    peers = labelled.groupBy("src", "grp").agg(F.count(F.lit(1)).alias("n"))
    return labelled.join(peers, ["src", "grp"]).select("src", "dst", (1.0 / F.col("n")).alias("w"))


def membership_matrix(groups: DataFrame) -> DataFrame:
    """(src = id, dst = group code, w = 1) without repeats."""
    return groups.where("id is not null and grp is not null").select(F.col("id").alias("src"), F.col("grp").alias("dst")).distinct().withColumn("w", F.lit(1.0))


def line_graph(edges: DataFrame, p: float = 1.0, q: float = 1.0, starts: bool = True) -> DataFrame:
    """(prev, cur, nxt, w): second-order steps as edges between edges.

    Going back weighs w / p, to a neighbour of ``prev`` w, elsewhere w / q.
    ``starts`` adds (i, i) -> (i, j) with the edge's own weight.
    """
    first = edges.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = edges.select(F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w")
    near = edges.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("near"))
    paths = first.join(second, "cur").join(near, ["prev", "nxt"], "left")
    bias = F.when(F.col("nxt") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
    out = paths.select("prev", "cur", "nxt", (F.col("w") * bias).alias("w"))
    if starts:
        out = out.unionByName(edges.select(F.col("src").alias("prev"), F.col("src").alias("cur"), F.col("dst").alias("nxt"), "w"))
    return out


def _starred(links: DataFrame) -> DataFrame:
    """(id, label): the components of ``links(a, b)``, a > b, without repeats.

    Rounds of large-star and small-star until nothing changes: logarithmic
    in practice, linear data a round, lineage cut each round.  A node's
    smallest neighbour is found by partial sums; nodes with a task's share of
    the links, few in number, get it by broadcast, so that the root of a giant
    component is no single key.
    """
    links, before = cut_lineage(links), None
    parts = 4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def star(pairs: DataFrame, share: int) -> DataFrame:
        low = pairs.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        hubs = F.broadcast(low.where(F.col("n") > share).drop("n"))  # two for each part at most
        rest = pairs.join(hubs.select("x"), "x", "left_anti").join(low.where(F.col("n") <= share).drop("n"), "x")
        return pairs.join(hubs, "x").unionByName(rest)

    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if state == before or not state[0]:
            break
        before, share = state, max(1, state[0] // parts)
        both = links.toDF("x", "y").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        large = cut_lineage(star(both, share).where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct())
        down = star(large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), share)
        small = down.select(F.col("y").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("x").alias("a"), F.col("m").alias("b")))
        links = cut_lineage(small.where("a <> b").distinct())
    return links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "id")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, label): weakly connected components, labelled by smallest id.

    Each node's smallest and largest neighbour are joined first, by stars over
    two links a node; then only the edges between what these leave apart, few
    or none, are joined in the same way.  The edges are read, but neither
    written nor dealt out again in rounds.  ``edges`` are read twice: give a
    table that is cheap to read.
    """
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("y")))
    near = cut_lineage(ends.groupBy("id").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("n")))
    pairs = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    below = _starred(pairs(near, "id", "low").unionByName(pairs(near, "id", "high")).distinct())  # roots are not in it
    label = cut_lineage(near.where("id is not null").select("id").join(below, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    parts = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (near.agg(F.sum("n")).first()[0] or 0) // parts)
    hubs = cut_lineage(near.where(F.col("n") > share).select("id").join(label, "id"))  # one for each part at most
    apart = edges.where("src <> dst").select("src", "dst")
    for end in ("src", "dst"):
        apart = _named(apart, label, hubs, end)
    apart = cut_lineage(pairs(apart, "src", "dst").distinct())
    if apart.take(1):
        joined = cut_lineage(_starred(apart)).toDF("label", "root")
        label = cut_lineage(label.join(joined, "label", "left").select("id", F.coalesce("root", "label").alias("label")))
    known = near.select("id") if nodes is None else nodes.select("id").union(near.select("id")).distinct()
    return known.join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _named(edges: DataFrame, label: DataFrame, hubs: DataFrame, end: str) -> DataFrame:
    """``edges(src, dst)`` with the component in place of the node at one end;
    that of ``hubs`` is joined by broadcast."""
    to = lambda df, names: df.join(names.toDF(end, "_l"), end).withColumn(end, F.col("_l")).select("src", "dst")
    if not hubs.take(1):
        return to(edges, label)
    hot = F.broadcast(hubs)
    return to(edges, hot).unionByName(to(edges.join(hot.select(F.col("id").alias(end)), end, "left_anti"), label))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges inside the component with most nodes (smaller label on ties)."""
    label = cut_lineage(components(edges))
    best = label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1).select("label")
    inside = cut_lineage(label.join(F.broadcast(best), "label").select("id"))
    if inside.count() == label.count():
        return edges.where("src is not null and dst is not null")
    return edges.where("dst is not null").join(inside.toDF("src"), "src", "left_semi")  # both ends of an edge have one label


def connectivity(edges: DataFrame) -> DataFrame:
    """One row: nodes, components, connected."""
    label = components(edges)
    out = label.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("label").alias("n_components"))
    return out.withColumn("connected", F.col("n_components") == 1)


def spanning_tree(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of the undirected graph: Boruvka rounds.

    The total order (w, smaller id, larger id) makes it unique.  Every round
    each component picks its lightest way out, so that the picks form trees
    that end in a pair; pointer jumping finds their roots, and a round at
    least halves the components.
    """
    plain = without_loops(edges).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    left = keep(plain.groupBy("src", "dst").agg(F.min("w").alias("w")).select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    tree = None
    while left.take(1):
        ends = left.select(F.col("a").alias("node"), F.struct("w", "src", "dst", F.col("b").alias("parent")).alias("e")).unionByName(left.select(F.col("b").alias("node"), F.struct("w", "src", "dst", F.col("a").alias("parent")).alias("e")))
        picks = cut_lineage(ends.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.*"))
        tree = picks.select("src", "dst", "w") if tree is None else tree.unionByName(picks.select("src", "dst", "w"))
        roots = _jumped(picks.select("node", "parent"))
        once = keep(spread_join(left, roots.toDF("a", "la"), "a").drop("a"))
        drop(left)
        left = keep(spread_join(once, roots.toDF("b", "lb"), "b").select("src", "dst", "w", F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b"))
        drop(once)
    empty = plain.limit(0)
    return (empty if tree is None else tree).select("src", "dst", "w").distinct()


def _jumped(parent: DataFrame) -> DataFrame:
    """(node, root) from picks (node, parent), where every tree of picks ends in
    two nodes that picked each other; the smaller one is the root."""
    back = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
    up = parent.join(back, "parent", "left")
    parent = cut_lineage(up.select("node", F.when((F.col("up") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent")))
    while True:
        back = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        twice = cut_lineage(parent.join(back, "parent").select("node", "parent", "up"))
        if not twice.where("parent <> up").take(1):
            return parent.withColumnRenamed("parent", "root")
        parent = twice.select("node", F.col("up").alias("parent"))


def two_block_graph(spark: SparkSession, n: int, p_in: float, p_out: float, seed: int = 0) -> DataFrame:
    """Undirected random graph of two equal blocks, both directions, weight 1.

    The numbers of edges within and between the blocks are binomial; the
    edges are as many distinct random pairs of the kind, first come by
    candidate number, so that the work follows the edges, not the pairs.
    """
    half = n // 2
    kinds = (("within", half * (half - 1), p_in), ("between", half * half, p_out))
    out = None
    for kind, total, p in kinds:
        want = _binomial(total, p, f"blocks-{kind}", seed)
        tries = 64 + int(2.5 * _tries(want, total))
        k = spark.range(tries).withColumnRenamed("id", "k")
        a = F.floor(u01(f"blocks-{kind}-a", F.col("k"), seed) * 2 * half).cast("long")
        b = F.floor(u01(f"blocks-{kind}-b", F.col("k"), seed) * 2 * half).cast("long")
        pairs = k.select("k", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst")
        same = F.floor(F.col("src") / half) == F.floor(F.col("dst") / half)
        fresh = pairs.where(same if kind == "within" else ~same).groupBy("src", "dst").agg(F.min("k").alias("k"))
        edges = first_rows(fresh, want, F.col("k")).select("src", "dst", F.lit(1.0).alias("w"))
        out = edges if out is None else out.unionByName(edges)
    return out.unionByName(swapped(out))


def _tries(want: int, total: int) -> float:
    """Candidates expected until ``want`` of ``total`` pairs of one kind were
    drawn; about half of all candidates are of a kind."""
    import math

    rest = max(total - want, 1)
    return 2.0 * total * (math.log(total / rest) if rest < total else 0.0) + 8 * math.sqrt(max(want, 1)) + want


def _binomial(total: int, p: float, use: str, seed: int) -> int:
    """A binomial number from a generator seeded by the use and the seed."""
    import zlib

    import numpy as np

    return int(np.random.default_rng([seed, zlib.crc32(use.encode())]).binomial(total, p))


def block_shuffled(edges: DataFrame, groups: DataFrame, seed: int = 0) -> DataFrame:
    """A degree-corrected randomisation: within each pair of groups the edge
    targets are dealt anew by seeded ranks.  The result is binary: repeated
    edges become one, loops go, and weights are 1, so that degrees are kept up
    to these.  Stubs are ranked in salted sub-blocks."""
    g = groups.select("id", "grp")
    laid = edges.join(g.toDF("src", "gs"), "src").join(g.toDF("dst", "gd"), "dst")
    salt = F.floor(u01("stub-salt", F.col("src"), F.col("dst"), seed) * 64)
    keyed = laid.withColumn("salt", salt)
    block = Window.partitionBy("gs", "gd", "salt")
    a = keyed.withColumn("r", F.row_number().over(block.orderBy(u01("stub-src", F.col("src"), F.col("dst"), seed), "src", "dst"))).select("gs", "gd", "salt", "r", "src")
    b = keyed.withColumn("r", F.row_number().over(block.orderBy(u01("stub-dst", F.col("src"), F.col("dst"), seed), "dst", "src"))).select("gs", "gd", "salt", "r", "dst")
    return a.join(b, ["gs", "gd", "salt", "r"]).where("src <> dst").select("src", "dst").distinct().withColumn("w", F.lit(1.0))
