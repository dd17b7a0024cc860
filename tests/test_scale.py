"""Steps that fell short on larger tables or in the last digits, on small ones."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import evaluate, linalg
from graphloom.plans import catalog


def test_directions_far_below_the_longest_stay(spark):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 4)))
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = (q * [1, 1e-3, 1e-6, 1e-9]) @ turn
    thin = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    rows = linalg.orthonormal(thin, 4).orderBy("id").collect()
    z = np.array([r.vec for r in rows])
    assert np.allclose(z.T @ z, np.eye(4), atol=1e-9)
    assert np.allclose(z @ (z.T @ q), q, atol=1e-5)


def test_a_matrix_without_mass_has_no_directions(spark):
    thin = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0])], "id long, vec array<double>")
    assert [r.vec for r in linalg.orthonormal(thin, 2).collect()] == [[0.0, 0.0]] * 2


def test_products_are_rounded_as_the_matrix_is(spark):
    factors = spark.createDataFrame([(1, [0.06949739918252784], [1.0])], "id long, vec array<double>, out array<double>")
    pairs = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert catalog._products(pairs, factors, 3, 5).first().w == 0.07
    assert catalog._products(pairs, factors, 3).first().w == 0.069


def _pairs_in_order(x, y):
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += x[:, k, None] * y[None, :, k]
    return out


def _vectors(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def test_near_ties_are_settled_by_sums_in_order(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 16)), 5, axis=0) + rng.choice([0, 1e-15, 1e-12], size=(150, 1))
    x[140:] = 0
    x[120:123] *= 1e20
    want = _pairs_in_order(x, x)
    np.fill_diagonal(want, -np.inf)
    got = {}
    for r in evaluate.nearest(_vectors(spark, x), 4).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.score))
    for i in range(len(x)):
        best = np.lexsort((np.arange(len(x)), -want[i]))[:4]
        assert got[i] == [(j, want[i, j]) for j in best]
    pairs = sorted((-want[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))[:40]
    assert [(-r.score, r.src, r.dst) for r in sorted(evaluate.top_pairs(_vectors(spark, x), 40).collect(), key=lambda r: (-r.score, r.src, r.dst))] == pairs


def test_only_few_scores_are_looked_at():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(64, 5003)).astype(np.float32)
    row, col = evaluate._candidates(scores, 10, 1e-6)
    assert len(row) < 64 * 200
    for i in range(64):
        assert set(np.argsort(-scores[i])[:10]) <= set(col[row == i])


def test_personas_meet_in_blocks_not_in_rows(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", 16)  # a node's personas lie in several blocks
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    node = np.arange(90) % 3 + (np.arange(90) > 80)
    data = [(i, x[i].tolist()) for i in range(88)] + [(88, None), (89, [1.0] * 7 + [None])]
    vectors = spark.createDataFrame(data, "id long, vec array<double>")
    personas = spark.createDataFrame([(int(n), i) for i, n in enumerate(node)] + [(7, 88), (8, 1000)], "id long, persona long")
    pairs = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 3), (0, 1), (7, 0), (8, 0), (0, 9)], "src long, dst long")
    for name in ("max", "min", "avg"):
        want = {(r.src, r.dst): r.score for r in evaluate.persona_scores(pairs.distinct(), personas, vectors, getattr(F, name)("s")).collect()}
        found = evaluate.persona_scores(pairs, personas, vectors, name)
        assert "CartesianProduct" not in found._jdf.queryExecution().toString()
        got = {(r.src, r.dst): r.score for r in found.collect()}
        assert got.keys() == want.keys() and want[7, 0] is None
        for key, value in want.items():
            assert value == got[key] if name != "avg" or value is None else abs(value - got[key]) < 1e-12


def _moments_of(m):
    rows = m.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.sum(F.col("w") * F.col("w")).alias("squares")).collect()
    return {r.src: tuple(r)[1:] for r in rows}


def test_moments_of_power_sums_without_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BLOCK_IDS", 8)
    monkeypatch.setattr(linalg, "CELLS", 40)
    rng = np.random.default_rng(4)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2))} | {(1_000_003, 2), (5, 1_000_003), (-3, 5)})
    a = spark.createDataFrame([(i, j, float(rng.integers(1, 5)) * (-1) ** (i % 2)) for i, j in cells], "src long, dst long, w double")
    for upto in (1, 2, 3):
        got = {r.src: (r.n, r.total, r.squares) for r in linalg.power_sum_moments(a, upto).select("src", "n", "total", "squares").collect()}
        assert got == _moments_of(linalg.power_sum(a, upto, small=0))
        want = _moments_of(linalg.walk_sum(a, 0.2, upto, small=0))
        found = {r.src: (r.n, r.total, r.squares) for r in linalg.walk_sum_moments(a, 0.2, upto).select("src", "n", "total", "squares").collect()}
        assert found.keys() == want.keys()
        assert all(np.allclose(found[k], want[k], atol=1e-9) for k in want)
