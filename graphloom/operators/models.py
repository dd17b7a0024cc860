"""Node embedding models: a name gives ``(edges, dim) -> (id, vec, out)``.

``vec`` is a node's vector as a center and ``out`` its vector as a context.
Spectral models run as distributed sketches.  Skip-gram and GloVe train over
partitions (``blockwise``); the graph networks train in one Arrow task, and
the graph operators around them stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import safe_log, u01
from graphloom.functions.session import cut_lineage
from graphloom.operators import blocks, blockwise, linalg
from graphloom.operators.graph import degrees, fairwalk_weights, nodes_of, normalised_adjacency, summed
from graphloom.operators.samplers import NodeSampler, configuration_noise, triplets
from graphloom.operators.walks import biased_walk, offset_windows, pair_counts, start_walks

VECTORS = "id long, vec array<double>"
#: Walks that one partition of MLlib's Word2Vec trains on; partitions are averaged.
WALKS_A_PART = 200_000


def _as_rows(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "vec"])


def two_factors(left: DataFrame, s: np.ndarray, right: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, vec, out): U S^alpha and V S^(1 - alpha), whose products give the matrix back.

    A node without a row, or without a column, has zeros there."""
    vec, out = linalg.rotated(left, np.diag(s**alpha)), linalg.rotated(right, np.diag(s ** (1 - alpha))).toDF("id", "out")
    zero = F.array_repeat(F.lit(0.0), len(s))
    return vec.join(out, "id", "full").select("id", F.coalesce("vec", zero).alias("vec"), F.coalesce("out", zero).alias("out"))


def same_both_ways(vectors: DataFrame) -> DataFrame:
    """(id, vec, out) of a model whose contexts are its centers."""
    return vectors.select("id", "vec", F.col("vec").alias("out"))


def residual_factorisation(groups: DataFrame | None = None, window: int = 10, block_count: int = 1000, alpha: float = 0.5, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Truncated residual matrix, factorised without being assembled: U S^alpha and V S^(1 - alpha)."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        edges = cut_lineage(summed(edges))
        own = nodes_of(edges)
        null = groups if groups is not None else own.withColumn("grp", F.lit(0).cast("long"))
        found = blocks.find_blocks(edges, block_count, seed) if window > 1 else own.withColumn("grp", F.col("id"))
        return two_factors(*linalg.svd(blocks.residual_terms(edges, cut_lineage(found), null, window), dim, seed=seed), alpha)

    return run


def laplacian_eigenmap(seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Left singular vectors u of the normalised adjacency without the first;
    centers are u over the root of the degree, contexts u."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        left, _, _ = linalg.svd(cut_lineage(normalised_adjacency(edges)), dim + 1, seed=seed)
        deg = degrees(edges).select("id", F.greatest("out_w", F.lit(1e-12)).alias("d"))
        rest = F.slice("vec", 2, dim)
        return left.join(deg, "id").select("id", F.transform(rest, lambda x: x / F.sqrt("d")).alias("vec"), rest.alias("out"))

    return run


def netmf_matrix(edges: DataFrame, window: int) -> DataFrame:
    """ln max(vol / T * (P + .. + P^T) D^-1, 1) on its positive entries."""
    from graphloom.operators.graph import transition

    total = edges.agg(F.sum("w")).first()[0]
    walked = linalg.walk_sum(cut_lineage(transition(edges)), 0.0, window)
    deg = degrees(edges).select(F.col("id").alias("dst"), F.greatest("out_w", F.lit(1.0)).alias("d"))
    return walked.join(deg, "dst").select("src", "dst", safe_log(F.col("w") * float(total) / F.col("d"), 1.0).alias("w")).where("w > 0")


def netmf(window: int = 4, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Factorised NetMF matrix for small windows: U S^1/2 and V S^1/2."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        return two_factors(*linalg.svd(cut_lineage(netmf_matrix(edges, window)), dim, seed=seed))

    return run


def netmf_spectral_matrix(edges: DataFrame, window: int = 10, rank: int = 256, negatives: float = 1.0, seed: int = 0) -> DataFrame:
    """NetMF for large windows from ``rank`` eigenpairs of the normalised
    adjacency: ln max(M, 1) on its positive entries, the diagonal among them,
    of M = vol / b * X X' with X filtered by the mean of powers 1..T-1.

    All pairs of nodes are scored, block by block; for small graphs.
    """
    from graphloom.operators.evaluate import all_scores

    total = edges.agg(F.sum("w")).first()[0]
    left, s, right = linalg.svd(cut_lineage(normalised_adjacency(edges, 1.0)), rank, seed=seed)
    sign = np.sign(np.diag(linalg_cross(left, right, rank)))
    lam = s * np.where(sign == 0, 1, sign)
    keep = np.maximum(sum(lam**t for t in range(1, window)) / window, 0.0)
    deg = degrees(edges).select("id", F.greatest("out_w", F.lit(1.0)).alias("d"))
    x = linalg.rotated(left, np.diag(np.sqrt(keep))).join(deg, "id").select("id", F.transform("vec", lambda v: v / F.sqrt("d")).alias("vec"))
    scores = all_scores(cut_lineage(x))
    return scores.select(F.col("id").alias("src"), F.col("other").alias("dst"), safe_log(F.col("score") * float(total / negatives), 1.0).alias("w")).where("w > 0")


def netmf_spectral(window: int = 10, rank: int = 256, negatives: float = 1.0, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """``netmf_spectral_matrix`` factorised: U S^1/2 and V S^1/2."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        return two_factors(*linalg.svd(cut_lineage(netmf_spectral_matrix(edges, window, rank, negatives, seed)), dim, seed=seed))

    return run


def linalg_cross(a: DataFrame, b: DataFrame, width: int) -> np.ndarray:
    """Sum over shared ids of the products of equal components."""
    joined = a.join(b.withColumnRenamed("vec", "v2"), "id")
    row = joined.agg(*(F.sum(F.col("vec")[k] * F.col("v2")[k]).alias(f"_{k}") for k in range(width))).first()
    return np.diag([row[k] or 0.0 for k in range(width)])


def log_degree(dim_free: bool = True) -> Callable[[DataFrame, int], DataFrame]:
    """Zero vectors; the score comes from offsets ln max(degree, 1) alone."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        return same_both_ways(nodes_of(edges).select("id", F.array_repeat(F.lit(0.0), dim).alias("vec")))

    return run


def _walk_pairs(edges: DataFrame, per_node: int, length: int, window: int, p: float, q: float, seed: int, side: str = "double") -> DataFrame:
    walks = cut_lineage(biased_walk(edges, start_walks(nodes_of(edges), per_node), length, p, q, seed))
    return offset_windows(walks, window, side)


def _chance(pairs: DataFrame, window: int, seed: int) -> DataFrame:
    """Windows shrunk as word2vec does: a center reaches 1..``window`` steps, drawn evenly."""
    reach = 1 + F.floor(u01("reach", F.col("walk_id"), F.col("step"), seed) * window)
    return pairs.where(F.abs("offset") <= reach)


def _noise_weights(pairs: DataFrame, power: float) -> DataFrame:
    """(id, weight): what contexts are drawn by: their count to ``power``."""
    return pairs.groupBy(F.col("context").alias("id")).agg(F.pow(F.sum("freq").cast("double"), F.lit(power)).alias("weight"))


def skip_gram(per_node: int = 5, length: int = 40, window: int = 10, p: float = 1.0, q: float = 1.0, negatives: int = 5, power: float = 0.75, epochs: int = 1, rate: float = 0.05, batch: int = 256, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Node2Vec: skip-gram with negative sampling over blocks of nodes.

    Every pair of a shrunk window is one positive; negatives are drawn by
    count^``power`` among the contexts of the block met.  Repeated pairs are
    one row with a count.
    """

    def run(edges: DataFrame, dim: int) -> DataFrame:
        walks = cut_lineage(biased_walk(edges, start_walks(nodes_of(edges), per_node), length, p, q, seed))
        counts = cut_lineage(pair_counts(_chance(offset_windows(walks, window), window, seed)))
        nodes = nodes_of(edges)
        tables = blockwise.start_tables(nodes, dim, seed, _noise_weights(counts, power), zero_contexts=True)
        many = blockwise.blocks_for(nodes.count(), counts.count())
        rows = counts.select(F.col("center").alias("a"), F.col("context").alias("b"), F.lit(1.0).alias("y"), F.col("freq").alias("n"))
        return blockwise.two_sided(blockwise.train(cut_lineage(tables), rows, many, rate=rate, batch=batch, negatives=negatives, epochs=epochs, seed=seed), dim)

    return run


def contexts_of(vectors: DataFrame, counts: DataFrame, dim: int, negatives: int = 5, power: float = 0.75, rate: float = 0.05, seed: int = 0) -> DataFrame:
    """(id, vec, out): context vectors by negative sampling against centers that stay as they are."""
    nodes = vectors.select("id")
    tables = blockwise.start_tables(nodes, dim, seed, _noise_weights(counts, power), zero_contexts=True).where("side = 1")
    zero = F.array_repeat(F.lit(0.0), dim)
    fixed = vectors.select(F.lit(0).alias("side"), "id", F.lit(0.0).alias("weight"), "vec", zero.alias("m"), zero.alias("v"), F.lit(0).cast("long").alias("t"))
    rows = counts.select(F.col("center").alias("a"), F.col("context").alias("b"), F.lit(1.0).alias("y"), F.col("freq").alias("n"))
    many = blockwise.blocks_for(nodes.count(), counts.count())
    return blockwise.two_sided(blockwise.train(cut_lineage(fixed.unionByName(tables)), rows, many, rate=rate, batch=256, negatives=negatives, frozen=True, seed=seed), dim)


class TripletBuffers:
    """Triplets (center, context, noise) of buffers of walks.

    Nodes stand in one fixed random order.  A buffer holds one walk from each
    node of the next stretch of ``buffer`` nodes and all its window pairs with
    their noise; after the last node the first one follows.  The set has
    nodes x walks x length samples, the last buffer is cut there.  Walks have
    numbers of their own in every buffer, and with them all draws.
    """

    def __init__(self, edges: DataFrame, noise: NodeSampler, per_node: int = 5, length: int = 40, window: int = 10, p: float = 1.0, q: float = 1.0, side: str = "double", buffer: int = 100_000, joint: bool = False, seed: int = 0) -> None:
        from graphloom.functions.ranking import running_sums

        self.edges, self.noise, self.joint, self.seed = edges, noise, joint, seed
        self.length, self.window, self.p, self.q, self.side, self.buffer = length, window, p, q, side, buffer
        drawn = nodes_of(edges).select("id", u01("node-order", F.col("id"), seed).alias("u"), F.lit(1).cast("long").alias("one"))
        self.order = cut_lineage(running_sums(drawn, [F.col("u"), F.col("id")], {"place": "one"}).select("id", (F.col("place") - 1).alias("place")))
        self.nodes = self.order.count()
        self.samples = self.nodes * per_node * length

    def __len__(self) -> int:
        return self.samples

    def __iter__(self) -> Iterator[DataFrame]:
        left, first, number = self.samples, 0, 0
        while left > 0 and self.nodes:
            last = min(first + self.buffer, self.nodes)
            starts = self.order.where((F.col("place") >= first) & (F.col("place") < last)).select((F.col("place") + number * self.nodes).alias("walk_id"), F.col("id").alias("start"))
            walks = cut_lineage(biased_walk(self.edges, starts, self.length, self.p, self.q, self.seed))
            rows = cut_lineage(triplets(offset_windows(walks, self.window, self.side), self.edges, self.noise, self.joint, self.seed))
            found = rows.count()
            if not found:
                return  # no node has a way out
            if found > left:
                from graphloom.functions.ranking import first_rows

                rows = cut_lineage(first_rows(rows, left, F.xxhash64("draw"), F.col("draw")))
            yield rows
            left, first, number = left - found, last % self.nodes, number + 1


def residual_sgd(noise: NodeSampler | None = None, per_node: int = 5, length: int = 40, window: int = 10, p: float = 1.0, q: float = 1.0, batch: int = 256, least: int = 200, rate: float = 0.003, clip: float = 1.0, buffer: int = 100_000, joint: bool = False, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Skip-gram against a noise model: ls(o.i) + ls(-n.i), by Adam on batches with clipped gradients.

    Samples come from refilled buffers; walks are added until there are
    ``least`` batches.  A triplet is a row with y = 1 and one with y = 0, each
    trained in the block pair of its own ends; with ``joint`` the noise has a
    center of its own.  A batch is ``batch`` triplets, so twice the rows.
    """

    def run(edges: DataFrame, dim: int) -> DataFrame:
        edges = cut_lineage(summed(edges))
        nodes = nodes_of(edges).count()
        walks = int(np.ceil(per_node * max(1.0, batch * least / max(1, nodes * per_node * length))))
        samples = TripletBuffers(edges, noise or configuration_noise(seed), walks, length, window, p, q, "double", buffer, joint, seed)
        state = cut_lineage(blockwise.start_tables(nodes_of(edges), dim, seed))
        for number, rows in enumerate(samples):
            center = F.col("noise_center") if joint else F.col("center")
            good = rows.select(F.col("center").alias("a"), F.col("context").alias("b"), F.lit(1.0).alias("y"), F.lit(1.0).alias("n"))
            bad = rows.select(center.alias("a"), F.col("noise").alias("b"), F.lit(0.0).alias("y"), F.lit(1.0).alias("n"))
            many = blockwise.blocks_for(nodes, 2 * rows.count())
            state = blockwise.train(state, good.unionByName(bad), many, steps="adam", rate=rate, batch=2 * batch, a_sample=2, clip=clip, seed=seed * 1_000_003 + number)
        return blockwise.two_sided(state, dim)

    return run


def word_vectors(per_node: int = 5, length: int = 40, window: int = 10, p: float = 1.0, q: float = 1.0, fair: bool = False, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """DeepWalk (p = q = 1) and Fairwalk: hierarchical softmax by MLlib's Word2Vec,
    and contexts by negative sampling against its vectors."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        from pyspark.ml.feature import Word2Vec
        from pyspark.ml.functions import vector_to_array

        from graphloom.operators.walks import sentences

        graph = fairwalk_weights(edges) if fair else edges
        walks = cut_lineage(biased_walk(graph, start_walks(nodes_of(graph), per_node), length, p, q, seed))
        texts = cut_lineage(sentences(walks))
        parts = max(1, texts.count() // WALKS_A_PART)
        model = Word2Vec(vectorSize=dim, minCount=0, windowSize=window, maxIter=1, numPartitions=parts, seed=seed, inputCol="words", outputCol="v").fit(texts)
        vectors = model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("vec"))
        counts = cut_lineage(pair_counts(_chance(offset_windows(walks, window), window, seed)))
        return contexts_of(cut_lineage(vectors), counts, dim, seed=seed)

    return run


def glove(per_node: int = 5, length: int = 40, window: int = 10, rate: float = 0.05, epochs: int = 25, top: float = 100.0, power: float = 0.75, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Weighted least squares on log co-occurrence counts with AdaGrad, over
    blocks of nodes; a node's word vector serves as its context too."""

    def run(edges: DataFrame, dim: int) -> DataFrame:
        counts = cut_lineage(pair_counts(_walk_pairs(edges, per_node, length, window, 1.0, 1.0, seed)))
        nodes = nodes_of(edges)
        weight = F.least(F.lit(1.0), F.pow(F.col("freq") / top, F.lit(power)))
        rows = counts.select(F.col("center").alias("a"), F.col("context").alias("b"), F.log("freq").alias("y"), weight.alias("n"))
        many = blockwise.blocks_for(nodes.count(), counts.count())
        tables = cut_lineage(blockwise.start_tables(nodes, dim, seed, extra=1))
        state = blockwise.train(tables, rows, many, "squares", rate=rate, epochs=epochs, seed=seed)
        return same_both_ways(blockwise.two_sided(state, dim))

    return run


def default_features(edges: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec): singular vectors of the degree-scaled adjacency and the
    degree, every column divided by its length."""
    left, _, _ = linalg.svd(cut_lineage(normalised_adjacency(edges, 1.0)), dim - 1, seed=seed)
    deg = degrees(edges).select("id", F.col("out_w").alias("d"))
    full = cut_lineage(left.join(deg, "id").select("id", F.concat("vec", F.array("d")).alias("vec")))
    lengths = np.sqrt(np.maximum(np.diag(linalg.gram(full, dim)), 1e-24))
    return linalg.rotated(full, np.diag(1 / lengths))


def propagate(edges: DataFrame, features: DataFrame, dim: int, loops: bool = True) -> DataFrame:
    """One graph convolution without weights: D^-1/2 (A + I) D^-1/2 X."""
    graph = edges.select("src", "dst", "w")
    if loops:
        graph = summed(graph.unionByName(nodes_of(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))))
    return linalg.times_thin(normalised_adjacency(graph), features, dim)


def graph_network(kind: str = "gcn", seed: int = 0, **options: float) -> Callable[[DataFrame, int], DataFrame]:
    """Graph convolution (gcn), trained attention of eight heads (gat) or
    sampled neighbourhoods (sage) over default features; see ``networks``.

    Neighbourhoods, with each node's own loop, and features are prepared in
    Spark; one Arrow task trains.
    """

    def run(edges: DataFrame, dim: int) -> DataFrame:
        from graphloom.operators import networks

        x = default_features(edges, dim, seed)
        loops = nodes_of(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
        norm = normalised_adjacency(summed(edges.select("src", "dst", "w").unionByName(loops)))
        rows = norm.select("src", "dst", "w", F.lit(None).cast("array<double>").alias("vec")).unionByName(x.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w"), "vec"))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            if not table.num_rows:
                return
            edge = table.filter(pa.compute.is_valid(table.column("dst")))
            node = table.filter(pa.compute.is_null(table.column("dst")))
            ids = np.asarray(node.column("src").combine_chunks())
            order = np.argsort(ids)
            ids, feats = ids[order], np.array(node.column("vec").to_pylist())[order]
            i, j = (np.searchsorted(ids, np.asarray(edge.column(k).combine_chunks())) for k in ("src", "dst"))
            w = np.asarray(edge.column("w").combine_chunks())
            by = np.lexsort((j, i))
            i, j, w = i[by], j[by], w[by]
            z = networks.sampled_neighbours(feats, i, j, dim, seed=seed, **options) if kind == "sage" else networks.reconstruct(kind, feats, i, j, w, dim, seed=seed, **options)
            yield _as_rows(ids, z)

        return same_both_ways(rows.repartition(1).mapInArrow(train, VECTORS))

    return run


def registry(groups: DataFrame | None = None, seed: int = 0) -> dict[str, Callable[[DataFrame, int], DataFrame]]:
    """Every model by name."""
    from graphloom.operators.samplers import block_noise, uniform_noise

    out = {
        "deepwalk": word_vectors(seed=seed),
        "node2vec": skip_gram(seed=seed),
        "node2vec-pq": skip_gram(p=0.5, q=2.0, seed=seed),
        "fairwalk": word_vectors(fair=True, seed=seed),
        "glove": glove(seed=seed),
        "leigenmap": laplacian_eigenmap(seed),
        "netmf": netmf(4, seed),
        "netmf-spectral": netmf_spectral(seed=seed),
        "lndeg": log_degree(),
        "residual": residual_factorisation(seed=seed),
        "residual-sgd": residual_sgd(noise=configuration_noise(seed), seed=seed),
        "residual-sgd-joint": residual_sgd(noise=configuration_noise(seed), joint=True, seed=seed),
        "residual-sgd-uniform": residual_sgd(noise=uniform_noise(seed), seed=seed),
        "gcn": graph_network("gcn", seed=seed),
        "gat": graph_network("gat", seed=seed),
        "graphsage": graph_network("sage", seed=seed),
    }
    if groups is not None:
        out["residual-groups"] = residual_factorisation(groups, seed=seed)
        out["residual-sgd-groups"] = residual_sgd(noise=block_noise(groups, seed=seed), seed=seed)
    return out


def bias_fit(edges: DataFrame, vectors: DataFrame, rounds: int = 1000, every: int = 20, tolerance: float = 1e-2, rate: float = 0.001) -> DataFrame:
    """(id, a, b): additive biases of a graph under fixed vectors.

    With the row and column sums of the weights, each less the inner product
    of the node's vector with the sum of all vectors, a ascends along
    row - sum(b) a and b along col - sum(a) b by Adam from zero, until a test
    every ``every`` rounds finds a mean change below ``tolerance`` of the
    mean size.  Nodes are the rows of ``vectors``; a node without edges has
    sums of zero.  Sums are aggregated in Spark; the ascent needs both global
    sums in each round and runs in one task over 24 bytes a node.
    """
    width = vectors.select(F.size("vec")).first()
    size = width[0] if width else 0
    totals = vectors.agg(*(F.sum(F.col("vec")[k]).alias(f"_{k}") for k in range(size))) if size else None
    deg = degrees(edges).withColumnRenamed("out_w", "r").withColumnRenamed("in_w", "c")
    shift = sum((F.col("vec")[k] * F.col(f"_{k}") for k in range(1, size)), F.col("vec")[0] * F.col("_0")) if size else F.lit(0.0)
    base = vectors.join(F.broadcast(totals)) if size else vectors  # one row of sums
    known = base.select("id", shift.alias("s")).join(deg, "id", "left").select("id", *((F.coalesce(F.col(c), F.lit(0.0)) - F.col("s")).alias(c) for c in "rc"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        ids, row, col = (np.asarray(table.column(k).combine_chunks()) for k in ("id", "r", "c"))
        a, b = np.zeros(len(ids)), np.zeros(len(ids))
        up, down = linalg.Adam(rate), linalg.Adam(rate)
        for t in range(rounds):
            to_a, to_b = up.ascend(a, row - b.sum() * a), down.ascend(b, col - a.sum() * b)
            if t % every == 0:
                moved = np.mean(np.abs(a - to_a) + np.abs(b - to_b)) / max(np.mean(np.abs(a) + np.abs(b)), 2e-8)
                if moved < tolerance:
                    break
            a, b = to_a, to_b
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a), pa.array(b)], names=["id", "a", "b"])

    return known.repartition(1).sortWithinPartitions("id").mapInArrow(train, "id long, a double, b double")


def uniform_start(nodes: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec): components uniform in +-0.5/dim from hash draws."""
    return nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (u01("init", F.col("id"), k, seed) - 0.5) / dim).alias("vec"))


def sampling_loss(rows: DataFrame, vectors: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row (loss): mean of -(ls(o.i) + ls(-n.i)) over triplets."""
    from graphloom.functions.scalar import dot, log_sigmoid

    i, o, n = vectors.toDF("center", "vi"), contexts.toDF("context", "vo"), contexts.toDF("noise", "vn")
    joined = rows.join(i, "center").join(o, "context").join(n, "noise")
    return joined.agg(F.avg(-(log_sigmoid(dot(F.col("vi"), F.col("vo"))) + log_sigmoid(-dot(F.col("vi"), F.col("vn"))))).alias("loss"))
