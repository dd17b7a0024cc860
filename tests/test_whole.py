"""Queries over whole tables, held against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage
from graphloom.operators import blocks, blockwise, graph, linalg, models, walks
from graphloom.operators.samplers import configuration_noise
from graphloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), [int(r.label) for r in rows]


def run(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


def test_neighbours_of_every_vector(spark, vectors):
    ids, x, labels = vectors
    assert len(ids) > 300
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    best = {ids[k]: [ids[j] for j in np.lexsort((ids, -np.round(scores[k], 12)))[:10]] for k in range(len(ids))}
    got = {}
    for r in sorted(run(spark, "nearest_neighbours_all"), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.other)
    assert got == best
    group = dict(zip(ids, labels))
    votes = {k: min((-sum(group[o] == g for o in near), g) for g in {group[o] for o in near})[1] for k, near in best.items()}
    assert {r.id: (r.y, r.z) for r in run(spark, "knn_vote_all")} == {k: (group[k], z) for k, z in votes.items()}


def test_top_pairs_of_every_vector(spark, vectors):
    ids, x, _ = vectors
    a, b = np.triu_indices(len(ids), 1)
    scores = (x @ x.T)[a, b]
    top = np.lexsort((b, a, -np.round(scores, 12)))[:500]
    want = {(ids[a[k]], ids[b[k]]) for k in top}
    assert {(r.src, r.dst) for r in run(spark, "top_pairs_all")} == want
    assert {(r.src, r.dst) for r in run(spark, "reconstructed_graph_all")} == want | {(j, i) for i, j in want}


def test_personas_of_every_vector(spark, vectors):
    ids, x, _ = vectors
    scores = x @ x.T
    at = {k: [j for j, i in enumerate(ids) if i % 25 == k] for k in range(25)}
    for agg, of in (("max", np.max), ("min", np.min), ("avg", np.mean)):
        for r in run(spark, f"persona_score_{agg}_all"):
            assert abs(r.score - of(scores[np.ix_(at[r.src], at[r.dst])])) < 2e-6


def test_components_of_every_co_purchase(spark):
    edges = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    orders = {}
    for r in edges:
        orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    pairs = {(a, b) for parts in orders.values() for a in parts for b in parts if a < b}
    assert sum(b - a > 20 for a, b in pairs) > len(pairs) / 2
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    label = {x: find(x) for x in root}
    assert {r.id: r.label for r in run(spark, "components_all")} == label
    got = run(spark, "connectivity_all")[0]
    assert (got.n_nodes, got.n_components) == (len(label), len(set(label.values())))
    top = min(set(label.values()), key=lambda k: (-sum(v == k for v in label.values()), k))
    whole = {p for p in pairs if label[p[0]] == top}
    assert {(r.src, r.dst) for r in run(spark, "largest_component_all")} == whole
    split = run(spark, "train_test_split")
    test = {(r.src, r.dst) for r in split if r.edge_type == 1}
    assert len(test) == int(0.3 * len(whole)) and test <= whole
    assert not {(r.src, r.dst) for r in split if r.edge_type == -1} & whole


MODELS = ["deepwalk", "node2vec", "fairwalk", "glove", "residual_sgd", "residual_sgd_joint", "residual_sgd_groups", "netmf"]


@pytest.mark.parametrize("name", MODELS)
def test_models_with_whole_walks(spark, name):
    """The registered queries, with walks and windows of their real length."""
    rows = run(spark, f"embedding_{name}")
    assert len({r.id for r in rows}) == len(rows) == 25
    for side in ("vec", "out"):
        x = np.array([r[side] for r in rows])
        assert x.shape == (25, 8) and np.isfinite(x).all() and np.abs(x).max() > 0


def test_walk_frequencies_follow_the_biases(spark):
    """Second steps of many walks from one place, against the weights of the line graph."""
    rows = [(0, 1, 2.0), (0, 2, 1.0), (1, 0, 1.0), (1, 2, 3.0), (1, 3, 2.0), (2, 0, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    starts = spark.range(6000).select(F.col("id").alias("walk_id"), F.lit(0).cast("long").alias("start"))
    for weighted in (True, False):
        w = {(a, b): c if weighted else 1.0 for a, b, c in rows}
        steps = walks.biased_walk(edges, starts, 3, 0.5, 2.0, 1, weighted).groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("p")).collect()
        seen = [tuple(x.node for x in r.p) for r in steps]
        assert len(seen) == 6000 and all(len(p) == 3 for p in seen)
        for cur in (1, 2):
            bias = {d: c * (2.0 if d == 0 else 1.0 if (0, d) in w else 0.5) for (a, d), c in w.items() if a == cur}
            at = [p[2] for p in seen if p[1] == cur]
            for d, b in bias.items():
                share = b / sum(bias.values())
                assert abs(at.count(d) / len(at) - share) < 4.5 * (share * (1 - share) / len(at)) ** 0.5
    # a walk ends at a node without a way out
    dead = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double")
    assert [(r.step, r.node) for r in walks.biased_walk(dead, starts.limit(1), 9, 0.5, 2.0).orderBy("step").collect()] == [(0, 0), (1, 1)]


def test_buffers_cover_the_nodes_in_turn(spark):
    edges = cut_lineage(graph.symmetrised(graph.two_block_graph(spark, 30, 0.5, 0.2, 3)))
    samples = models.TripletBuffers(edges, configuration_noise(1), per_node=3, length=6, window=1, buffer=12, seed=4)
    order = {r.place: r.id for r in samples.order.collect()}
    assert sorted(order) == list(range(30)) and sorted(order.values()) == sorted(r.id for r in graph.nodes_of(edges).collect())
    assert len(samples) == 30 * 3 * 6
    buffers = [b.collect() for b in samples]
    assert sum(map(len, buffers)) == len(samples)
    stretches = [range(0, 12), range(12, 24), range(24, 30)] * 9  # wrap around after the last node
    for rows, places in zip(buffers, stretches):
        assert {int(r.draw.split(":")[0]) % 30 for r in rows} <= set(places)
    assert len(buffers) > 3 and {int(r.draw.split(":")[0]) % 30 for b in buffers[:3] for r in b} == set(range(30))
    assert len({tuple(sorted((r.center, r.context) for r in b)) for b in (buffers[0], buffers[3])}) == 2  # new walks on the second pass


def test_training_over_blocks(spark):
    """Blocks of any number lower the loss; frozen centers stay; GloVe's squares fit."""
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b), 1.0, 1.0) for a, b in rng.integers(0, 20, (400, 2)) if a % 2 == b % 2] + [(int(a), int(b), 0.0, 1.0) for a, b in rng.integers(0, 20, (400, 2)) if a % 2 != b % 2]
    rows = spark.createDataFrame(pairs, "a long, b long, y double, n double")
    start = cut_lineage(blockwise.start_tables(spark.range(20), 4, 0))

    def loss(state):
        v = {r.id: (np.array(r.vec), np.array(r.out)) for r in blockwise.two_sided(state, 4).collect()}
        return -sum(np.log(blockwise.sigmoid((1 if y else -1) * (v[a][0] @ v[b][1]))) for a, b, y, _ in pairs) / len(pairs)

    for steps, count in (("adagrad", 2), ("adam", 5)):
        done = blockwise.train(start, rows, count, steps=steps, rate=0.1, batch=32, clip=1.0, epochs=4)
        assert loss(done) < 0.6 * loss(start) and done.count() == 40
    still = blockwise.train(start, rows, 3, frozen=True, epochs=1)
    assert {r.id: r.vec for r in still.where("side = 0").collect()} == {r.id: r.vec for r in start.where("side = 0").collect()}
    again = [sorted(map(tuple, blockwise.train(start.repartition(k), rows.repartition(k), 3, negatives=2).select("side", "id", F.transform("vec", lambda x: F.round(x, 9))).collect())) for k in (1, 5)]
    assert again[0] == again[1]  # whatever the partitions


def test_wide_thin_products(spark):
    """Sketches wider than a row of columns are summed as arrays, hubs in partial sums."""
    rng = np.random.default_rng(2)
    entries = {(int(i), int(j)): float(w) for i, j, w in zip(rng.integers(0, 30, 400), rng.integers(0, 50, 400), rng.random(400))} | {(0, j): 1.0 for j in range(50)}
    a, thin = np.zeros((30, 50)), rng.standard_normal((50, 150))
    for (i, j), w in entries.items():
        a[i, j] = w
    rows = spark.createDataFrame([(i, j, w) for (i, j), w in entries.items()], "src long, dst long, w double").repartition(5)
    table_ = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(thin)], "id long, vec array<double>")
    got = {r.id: np.array(r.vec) for r in linalg.times_thin(rows, table_, 150).collect()}
    assert set(got) == {i for i, _ in entries} and all(np.allclose(x, (a @ thin)[i]) for i, x in got.items())
    left, s, right = linalg.svd([[rows], [linalg.scaled(rows, 0.5)]], 20, oversample=120)
    assert np.allclose(s, np.linalg.svd(1.5 * a, compute_uv=False)[:20])


def test_sums_of_powers_agree(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, 9, 30), rng.integers(0, 9, 30), rng.random(30))], "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    rows = cut_lineage(rows)
    for make in (lambda small: linalg.power_sum(rows, 3, small), lambda small: linalg.walk_sum(rows, 0.2, 4, 1, small=small)):
        dense, joined = ({(r.src, r.dst): r.w for r in make(small).collect()} for small in (1024, 0))
        assert dense.keys() == joined.keys() and all(abs(dense[k] - joined[k]) < 1e-9 for k in dense)


def test_score_blocks_of_a_planted_graph(spark):
    edges = cut_lineage(graph.two_block_graph(spark, 60, 0.6, 0.02, 3)).unionByName(spark.createDataFrame([(99, 3, 1.0)], "src long, dst long, w double"))
    found = {r.id: r.grp for r in blocks.find_blocks(edges, 2).collect()}
    assert len(found) == 61 and found[99] == 0  # no edge leads to it
    assert len({found[i] for i in range(30)}) == 1 and {found[i] for i in range(30, 60)} == {1 - found[0]}
