"""Operators on small graphs: golden values, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import blocks, evaluate, graph, linalg, models, samplers, splits, walks
from graphloom.sources import files


@pytest.fixture(scope="module")
def triangles(spark):
    """Two triangles joined by one edge, both directions."""
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    rows = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    return spark.createDataFrame(rows, "src long, dst long, w double").cache()


@pytest.fixture(scope="module")
def halves(spark):
    return spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, grp long").cache()


@pytest.fixture(scope="module")
def singles(spark):
    return spark.createDataFrame([(i, i) for i in range(6)], "id long, grp long").cache()


@pytest.mark.parametrize("window, count, total", [(1, 36, 482.551305), (2, 30, 84.155677), (3, 14, 3.741161), (5, 18, 2.779342)])
def test_residual_golden(triangles, halves, singles, window, count, total):
    m = blocks.residual_matrix(triangles, singles, halves, window)
    n, s = m.agg(F.count(F.lit(1)), F.sum("w")).first()
    assert n == count and abs(s - total) < 1e-5


@pytest.mark.parametrize("window, total", [(1, 497.657196), (2, 5.430102), (3, 4.512098), (5, 3.291033)])
def test_residual_golden_blocks(triangles, halves, window, total):
    s = blocks.residual_matrix(triangles, halves, halves, window).agg(F.sum("w")).first()[0]
    assert abs(s - total) < 1e-5


def test_residual_singular_values(triangles, halves, singles):
    _, s, _ = linalg.svd(blocks.residual_terms(triangles, singles, halves, 3), 6, oversample=0, rounds=2)
    assert np.allclose(s, [0.739578, 0.695185, 0.402049, 0.379706, 0.379706, 0.31297], atol=1e-4)


def test_block_probability_golden(triangles, halves):
    rows = samplers.context_probability(triangles, halves, 10).where("grp = 0").orderBy("dst").collect()
    assert np.allclose([r.w for r in rows], [0.177337, 0.177337, 0.266005, 0.162566, 0.108378, 0.108378], atol=1e-6)


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 9))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(9)], "src long, dst long, w double")
    left, s, right = linalg.svd(df, 4, oversample=5, rounds=2)
    assert np.allclose(s, np.linalg.svd(a)[1][:4], atol=1e-6)
    u = np.array([r.vec for r in left.orderBy("id").collect()])
    v = np.array([r.vec for r in right.orderBy("id").collect()])
    best = np.linalg.svd(a)
    assert np.allclose(u * s @ v.T, best[0][:, :4] * best[1][:4] @ best[2][:4], atol=1e-5)


def test_walks_follow_edges_and_stop_at_sinks(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (1, 0, 1.0)], "src long, dst long, w double")
    starts = spark.createDataFrame([(k, k % 3) for k in range(60)], "walk_id long, start long")
    rows = walks.walk(edges, starts, 6, 5).collect()
    at = {(r.walk_id, r.step): r.node for r in rows}
    allowed = {(0, 1), (1, 2), (1, 0)}
    assert all((at[w, s - 1], n) in allowed for (w, s), n in at.items() if s)
    assert not any(at.get((w, s - 1)) == 2 for w, s in at if s)
    back = walks.walk(edges, starts, 6, 5, restart_at_sink=True)
    assert back.count() == 360


def test_draws_follow_weights(spark):
    edges = spark.createDataFrame([(0, j, float(j)) for j in range(1, 201)], "src long, dst long, w double")
    got = samplers.categorical(spark.range(40000).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("src")), edges, 1)
    mean = got.agg(F.avg("dst")).first()[0]
    assert got.count() == 40000 and abs(mean - 401 / 3) < 2


def test_split_keeps_components_and_negatives_are_free(triangles):
    parts = splits.split(triangles, 0.25, 3)
    assert parts.test.count() == 1
    assert graph.connectivity(parts.train).first().connected
    edges = {(r.src, r.dst) for r in triangles.collect()}
    none = [(r.src, r.dst) for r in parts.negative.collect()]
    assert len(none) == 1 and not set(none) & edges and all(a < b for a, b in none)
    with pytest.raises(ValueError):
        splits.held_out_edges(triangles, 0.9)


def test_spanning_tree_of_components(spark):
    rows = [(0, 1, 3.0), (1, 2, 1.0), (0, 2, 2.0), (7, 8, 1.0)]
    tree = graph.spanning_tree(spark.createDataFrame(rows, "src long, dst long, w double"))
    assert sorted((r.src, r.dst) for r in tree.collect()) == [(0, 2), (1, 2), (7, 8)]


def test_auc_cases(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, float("nan")), (0, None)], "y int, score double")
    assert evaluate.auc(df).first().auc == 0.5
    assert evaluate.auc(spark.createDataFrame([(1, 0.5)], "y int, score double")).first().auc is None


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert graph.components(none).count() == 0
    assert graph.spanning_tree(none).count() == 0
    assert graph.degrees(none).count() == 0
    assert graph.dense_codes(graph.nodes_of(none), "id").count() == 0


def test_bad_edges(spark):
    with pytest.raises(ValueError):
        graph.as_edges(spark.range(3))
    e = graph.as_edges(spark.createDataFrame([(1, 2)], "src int, dst int"))
    assert e.first().w == 1.0


@pytest.mark.parametrize("name", ["residual", "leigenmap", "netmf", "lndeg", "gcn", "gat", "graphsage"])
def test_model_shapes(triangles, name):
    dim = 3
    rows = models.registry()[name](triangles, dim).collect()
    assert sorted(r.id for r in rows) == list(range(6))
    assert all(len(r.vec) == dim and all(math.isfinite(x) for x in r.vec) for r in rows)


def test_skip_gram_separates_blocks(spark):
    edges = graph.two_block_graph(spark, 40, 0.5, 0.03, 1).cache()
    vec = {r.id: np.array(r.vec) for r in models.skip_gram(4, 10, 3, seed=1)(edges, 8).collect()}
    same = np.mean([vec[a] @ vec[b] for a in vec for b in vec if a < b and (a < 20) == (b < 20)])
    other = np.mean([vec[a] @ vec[b] for a in vec for b in vec if a < b and (a < 20) != (b < 20)])
    assert same > other


def test_files(spark, tmp_path, triangles, halves):
    (tmp_path / "e.csv").write_text("0,1\n1,2\n")
    assert files.read_edge_csv(spark, str(tmp_path / "e.csv")).count() == 2
    (tmp_path / "e.tsv").write_text("# note\n1\t2\n2\t3\n")
    assert sorted((r.src, r.dst) for r in files.read_one_based(spark, str(tmp_path / "e.tsv")).collect()) == [(0, 1), (1, 2)]
    (tmp_path / "g.gml").write_text('graph [\n node [ id 0 label "a" value "n" ]\n node [ id 1 label "b" value "c" ]\n edge [ source 0 target 1 ]\n]\n')
    nodes, edges = files.read_gml(spark, str(tmp_path / "g.gml"))
    assert [(r.id, r.label, r.value) for r in nodes.orderBy("id").collect()] == [(0, "a", "n"), (1, "b", "c")]
    assert [(r.src, r.dst) for r in edges.collect()] == [(0, 1)]
    files.write_split(splits.split(triangles, 0.25, 3), str(tmp_path / "split"))
    assert (tmp_path / "split" / "network").exists()
    files.write_embedding(halves, str(tmp_path / "emb"), dim=3, model_name="x")
    assert spark.read.parquet(str(tmp_path / "emb")).columns == ["id", "grp", "dim", "model_name"]
    files.append_result(spark.createDataFrame([("a", 0.5)], "name string, auc double"), str(tmp_path / "res"))
    files.append_result(spark.createDataFrame([("b", 0.6)], "name string, auc double"), str(tmp_path / "res"))
    assert spark.read.csv(str(tmp_path / "res"), sep="\t").count() == 2


def test_any_graph_becomes_an_edge_table(spark):
    class Coordinates:
        row, col, data = np.array([0, 1]), np.array([1, 2]), np.array([2.0, 3.0])

    class Rows:
        def tocoo(self):
            return Coordinates()

    class Drawn:
        def __init__(self, directed):
            self.directed = directed

        def is_directed(self):
            return self.directed

        def edges(self, data):
            return [(0, 1, {"weight": 2.0}), (1, 2, {"weight": 3.0}), (2, 2, {})]

    want = {(0, 1, 2.0), (1, 2, 3.0)}
    rows = lambda g: {tuple(r) for r in graph.edges_of(spark, g).collect()}
    assert rows(Coordinates()) == rows(Rows()) == rows(np.array([[0, 2.0, 0], [0, 0, 3.0], [0, 0, 0]])) == rows([(0, 1, 2.0), (1, 2, 3.0)]) == want
    assert rows(spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0)], "src long, dst long, w double")) == want
    assert rows(Drawn(True)) == want | {(2, 2, 1.0)} and rows(Drawn(False)) == want | {(1, 0, 2.0), (2, 1, 3.0), (2, 2, 1.0)}
    assert rows([(3, 4)]) == {(3, 4, 1.0)} and rows([]) == set()
    for wrong in ("net.txt", np.zeros((2, 3)), {1: 2}):
        with pytest.raises(ValueError):
            graph.edges_of(spark, wrong)
