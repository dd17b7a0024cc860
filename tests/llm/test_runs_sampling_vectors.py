"""Periodic runs, target sampling and near-duplicate vectors against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cross_polytope, periodic, queries, target_sampling
from texts import corpus, prose

# ---------------------------------------------------------------- periodic runs


def lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def all_runs(w, least=6, exponent=4):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and not any(all(w[t] == w[t + p] for t in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    rng = random.Random(0)
    for _ in range(400):
        s = [rng.randint(0, 2) for _ in range(rng.randint(0, 16))]
        assert periodic.lyndon_array(s) == lyndon(s)
        assert periodic.lyndon_array(s, True) == lyndon([-c for c in s])


def test_runs():
    rng = random.Random(1)
    for _ in range(400):
        w = [b"%d" % rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.7:
            root = w[: rng.randint(1, 6)]
            w = w[: rng.randint(0, 20)] + root * rng.randint(2, 8) + w[: rng.randint(0, 9)] + root * 4
        for least, exponent in ((6, 4), (3, 3), (1, 5)):
            assert periodic.find_runs(w, least, exponent) == all_runs(w, least, exponent)
    assert periodic.find_runs([b"a"] * 6) == [(0, 6, 1)] and periodic.find_runs([b"a"] * 5) == []
    with pytest.raises(ValueError):
        periodic.find_runs([b"a"] * 9, 6, 2)


@pytest.mark.parametrize("words", [[b"a"] * 60_000, [b"%d" % (i % 37) for i in range(60_000)], [b"%d" % (i * i % 211) for i in range(60_000)]])
def test_long_periodic_texts(words):
    assert [(0, 60_000, q) for q in (1, 37, 211) if words[:-q] == words[q:]][:1] == periodic.find_runs(words)


def planted_words(doc, words):
    h, n, out = zlib.crc32(str(doc).encode()), len(words), list(words)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        out = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [r for r in corpus() if r[0] != 403 and r[0] != 404]
    made += [(1000 + i, prose(rng, rng.randint(1, 90))) for i in range(150)] + [(2000, "ab " * 300), (2001, "la la la  la\tla\nla de dum"), (2001, "la la la  la\tla\nla de dum")]
    return made


def table(spark, rows):
    clash = "doc_id long, text string, runs string, n_words string, collapsed string, weight string, score string, rank string, fits string, best string"
    return spark.createDataFrame([(i, t, *"abcdefgh") for i, t in rows], clash).repartition(4)


def test_op12(spark, rows, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda s, d, name: table(spark, rows))
    want = collections.Counter()
    for doc, text in rows:
        w = planted_words(doc, (text or "").encode().split())
        runs = all_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest()] += 1
    got = queries.op12_periodic_runs(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want and sum(k[1] > 0 for k in want) > 10
    assert queries.op12_periodic_runs(spark, "").limit(0).count() == 0
    plain = {r.doc_id: r for r in periodic.collapse(table(spark, [(2001, "la la la  la\tla\nla de dum")])).collect()}[2001]
    assert [tuple(r) for r in plain.runs] == [(0, 6, 1)] and plain.collapsed == "la de dum" and plain.n_words == 8


# ---------------------------------------------------------------- target sampling


def test_spans_have_their_crc():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.unique(np.concatenate([rng.integers(0, 5000, 60), [0, 0, 5000]]))
    starts, ends = cuts[:-1], np.maximum(cuts[:-1], cuts[1:] - rng.integers(0, 3, len(cuts) - 1))
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    for depth in (4, 16, 64):
        table_ = target_sampling.position_table(depth)
        assert target_sampling.crc32_spans(data, starts, ends, table_).tolist() == want
    assert target_sampling.crc32_spans(data, np.array([0]), np.array([5000])).tolist() == [zlib.crc32(data.tobytes())]
    assert target_sampling.crc32_spans(data, np.array([], int), np.array([], int)).tolist() == []
    # what a byte adds hangs on the byte and its distance from the end
    flip = lambda k, b: zlib.crc32(bytes(k) + bytes([b])) ^ zlib.crc32(bytes(k + 1))
    assert all(target_sampling.TABLE[0, b] == flip(3, b) for b in range(256))


def sampled(rows, target, percent=25):
    def grams(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return len(w), [zlib.crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]

    found = [(doc, *grams(t)) for doc, t in rows]
    s, t = collections.Counter(b for _, _, g in found for b in g), collections.Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc, n, g in found:
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, able[: percent * len(able) // 100]


def test_op13(spark, rows, monkeypatch):
    target = [prose(random.Random(k), 60) for k in range(5)] + [None, ""]
    long = [(3000, "x" * 700 + " " + "Ünïcode" * 90 + " end"), (3001, "A-b_C9 " * 30)]
    docs = table(spark, [*rows, *long])
    monkeypatch.setattr(queries, "table", lambda s, d, name: docs if name == "documents" else spark.createDataFrame([(x,) for x in target], "text string"))
    got = queries.op13_target_sampling(spark, "").collect()
    every, best = sampled([*rows, *long], target)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter((d, n, w, s) for d, _, n, w, s in every)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(best) + 1))
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(b[0], b[4]) for b in best]


def test_op13_without_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert target_sampling.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in target_sampling.resample(some, none).collect()}
    assert got[1].n_features == 5 and got[2].weight == 0 and got[1]["rank"] is None


# ---------------------------------------------------------------- near-duplicate vectors


def noisy(rng, c, n, cos):
    z = rng.standard_normal((n, len(c)))
    z -= np.outer(z @ c, c) / (c @ c)
    return cos * c / np.linalg.norm(c) + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z, axis=1)[:, None]


def linked(ids, vectors, threshold=0.9):
    fine = [x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for x in vectors]
    width = max((len(x) for x, ok in zip(vectors, fine) if ok), default=1)
    y = np.zeros((len(vectors), width))
    for k in np.flatnonzero(fine):
        y[k, : len(vectors[k])] = np.array(vectors[k]) / np.abs(vectors[k]).max()
        y[k] /= np.linalg.norm(y[k])
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    root = {i: i for i in ids}
    while True:
        before = dict(root)
        for a, b in zip(*np.nonzero(near)):
            root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
        if root == before:
            break
    return {(i, int(near[k].sum()), root[i] if fine[k] else i, (root[i] if fine[k] else i) == i) for k, i in enumerate(ids)}


def test_hadamard_and_vertices():
    x = np.random.default_rng(0).standard_normal((5, 16))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)])
    assert np.allclose(cross_polytope.hadamard(x), x @ h)
    near, worse = cross_polytope.vertices(x, 3, 4)
    assert near.shape == (5, 4) and (np.diff(worse, axis=1) >= 0).all() and (worse[:, 0] == 0).all()
    assert (cross_polytope.vertices(-x, 3, 1)[0] == (near[:, :1] ^ 1)).all()


@pytest.mark.parametrize("n", [100, 10_000, 1_000_000, 30_000_000])
def test_close_pairs_meet(n):
    rng = np.random.default_rng(5)
    hashes, tables, probes = cross_polytope.plan(n, 64)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = np.stack([noisy(rng, c, 1, 0.9)[0] for c in a])
    met = np.zeros(len(a), bool)
    for t in range(tables):
        x, y = cross_polytope.buckets(a, t, hashes, probes), cross_polytope.buckets(b, t, hashes, probes)
        met |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
    assert met.mean() > 0.99


def test_op11_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [x.tolist() for x in rng.standard_normal((150, 64))]
    for cos, n in ((0.995, 90), (0.97, 40), (0.95, 30), (0.92, 30)):  # tight and loose groups
        vectors += [x.tolist() for x in noisy(rng, rng.standard_normal(64), n, cos)]
    c = rng.standard_normal(64)
    for turn in (0, 0.2, 0.4, 0.45, 0.5, 0.7):  # balls at all distances
        vectors += [x.tolist() for x in noisy(rng, noisy(rng, c, 1, np.cos(turn))[0], 15, 0.993)]
    vectors += [vectors[5]] * 20 + [vectors[160]] * 15 + [[2 * v for v in vectors[7]]]
    vectors += [None, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [], [1.0, 2.0], [2.0, 4.0], [1e200] * 64, [1e200] * 64, [None] + [1.0] * 63]
    ids = list(range(len(vectors)))
    made = spark.createDataFrame([(i, x, "n", "b") for i, x in zip(ids, vectors)], "vec_id long, embedding array<double>, node string, ball string").repartition(5)
    monkeypatch.setattr(queries, "table", lambda s, d, name: made)
    got = queries.op11_embedding_dedup(spark, "")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == linked(ids, vectors)


def test_op11_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert cross_polytope.near_duplicates(none).count() == 0
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (3, [0.0, 2.0]), (9, None)]
    got = sorted(map(tuple, cross_polytope.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    # rows that share an id are rows of their own; a null id links with nothing
    assert got == sorted([(None, 0, None, False), (4, 0, 4, True), (4, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True)], key=repr)
    with pytest.raises(ValueError):
        cross_polytope.near_duplicates(none, 1.5)


def test_tight_group_makes_no_pairs(spark):
    """A third of all rows in one group: balls stand for it, so that pairs do not grow with its square."""
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.standard_normal((800, 64)), noisy(rng, rng.standard_normal(64), 400, 0.996)])
    made = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = made.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = cross_polytope._classes(rows, 64)
    hashes, tables, _ = cross_polytope.plan(1200, 64)
    balls = cross_polytope._balls(classes, 64, hashes, tables, math.cos(math.acos(0.9) / 2))
    assert balls.where("low >= 800").select("ball").distinct().count() <= 20
    assert {r.n_links for r in cross_polytope.near_duplicates(made).where("vec_id >= 800").collect()} == {399}
