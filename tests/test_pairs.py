"""The average precision of all pairs, without a row for each."""

import numpy as np

from graphloom.operators import evaluate


def test_precision_of_all_pairs_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(30, 6)), 3, axis=0)  # many ties
    x[60:] += rng.normal(size=(30, 6)) * 0.3
    grp = [None if i % 17 == 0 else f"g{i % 4}" for i in range(90)]
    vectors = spark.createDataFrame([(i, r.tolist(), g) for i, (r, g) in enumerate(zip(x, grp))] + [(None, [0.0] * 6, "g1"), (900, None, "g1")], "id long, vec array<double>, grp string")
    scores = np.zeros((90, 90))
    for k in range(6):
        scores += x[:, k, None] * x[None, :, k]
    hit = np.array([[a is not None and a == b for b in grp] for a in grp])
    want = sum(hit[scores == s].sum() * hit[scores >= s].sum() / (scores >= s).sum() for s in np.unique(scores[hit])) / hit.sum()
    monkeypatch.setattr(evaluate, "all_scores", None)
    for block, held in ((4096, 1 << 25), (16, 300)):
        monkeypatch.setattr(evaluate, "PAIR_BLOCK", block)
        monkeypatch.setattr(evaluate, "PAIRS_HELD", held)
        assert abs(evaluate.pair_precision(vectors).first().average_precision - want) < 1e-12
