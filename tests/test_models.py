"""Models tell the groups of a planted graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage
from graphloom.operators import evaluate, graph, models
from graphloom.operators.samplers import configuration_noise


@pytest.fixture(scope="module")
def planted(spark):
    edges = cut_lineage(graph.two_block_graph(spark, 60, 0.5, 0.05, 3))
    groups = graph.nodes_of(edges).select("id", F.floor(F.col("id") / 30).cast("long").alias("grp"))
    return edges, cut_lineage(groups)


MODELS = {
    "leigenmap": lambda g: models.laplacian_eigenmap(),
    "netmf": lambda g: models.netmf(3),
    "residual": lambda g: models.residual_factorisation(window=3),
    "deepwalk": lambda g: models.word_vectors(length=12, window=5),
    "glove": lambda g: models.glove(length=12, window=5),
    "node2vec": lambda g: models.skip_gram(length=12, window=5, epochs=5),
    "residual-sgd": lambda g: models.residual_sgd(length=12, window=5, noise=configuration_noise()),
    "gcn": lambda g: models.graph_network("gcn"),
    "gat": lambda g: models.graph_network("gat"),
    "sage": lambda g: models.graph_network("sage", epochs=60),
}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_planted_groups(planted, name):
    edges, groups = planted
    dim = 2 if name == "leigenmap" else 32  # its columns are of one length: later ones outweigh the one that tells the groups
    rows = MODELS[name](groups)(edges, dim).collect()
    rows.sort(key=lambda r: r.id)
    ids = np.array([r.id for r in rows])
    for side in ("vec", "out"):
        x = np.array([r[side] for r in rows])
        assert x.shape == (groups.count(), dim) and np.isfinite(x).all()
        x = x - x.mean(0)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        up = np.triu_indices(len(ids), 1)
        s, y = (x @ x.T)[up], np.equal.outer(ids // 30, ids // 30)[up]
        assert (s[y][:, None] > s[~y][None]).mean() > 0.75


def test_log_degree_and_ranks(spark, planted):
    edges, _ = planted
    assert all(v == 0 for r in models.log_degree()(edges, 4).collect() for v in r.vec)
    scored = spark.createDataFrame([(float(k % 50), k % 3 == 0) for k in range(500)], "score double, hit boolean").select("score", F.col("hit").cast("int").alias("y"))
    assert evaluate.auc(scored).first()[0] == evaluate.auc(scored.withColumn("g", F.lit(1)), ("g",)).first()["auc"]
