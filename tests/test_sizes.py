"""What steps write, deal and hold follows the size of their tables."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import ranking, session
from graphloom.operators import graph, linalg, splits, walks
from graphloom.plans import catalog
from graphloom.sources import fixtures

from tables import DATA


def _noting(monkeypatch, module, name, sizes):
    plain = getattr(module, name)

    def noted(df, *more):
        out = plain(df, *more)
        sizes.append((df if name == "_starred" else out).count())
        return out

    monkeypatch.setattr(module, name, noted)


def test_rounds_of_components_have_two_links_a_node(spark, monkeypatch):
    sizes = []
    _noting(monkeypatch, graph, "_starred", sizes)
    full = [(a, b) for base in (0, 100) for a, b in itertools.combinations(range(base, base + 30), 2)]
    pairs = [(200, 201), (202, 203), (200, 202), (300, 300), (None, 5), (301, None)]
    got = {(r.id, r.label) for r in graph.components(spark.createDataFrame(full + pairs, "src long, dst long")).collect()}
    ids = {0: range(30), 100: range(100, 130), 200: range(200, 204), 300: [300], 301: [301]}
    assert got == {(i, k) for k, v in ids.items() for i in v} | {(None, None)}
    assert max(sizes) <= 2 * 64


def test_components_meet_by_edges_that_the_first_links_leave_out(spark):
    # the middle nodes 10 and 20 have smaller and larger neighbours than each other
    edges = [(10, 1), (10, 90), (20, 2), (20, 95), (10, 20), (40, 41), (41, 42)]
    for session_edges in (edges, [(b, a) for a, b in edges]):
        got = {r.id: r.label for r in graph.components(spark.createDataFrame(session_edges, "src long, dst long")).collect()}
        assert got == {1: 1, 2: 1, 10: 1, 20: 1, 90: 1, 95: 1, 40: 40, 41: 40, 42: 40}
        inside = graph.largest_component(spark.createDataFrame(session_edges, "src long, dst long")).collect()
        assert {tuple(r) for r in inside} == set(session_edges[:5])


def test_components_with_many_hubs(spark):
    edges = [(h, 1000 + h * 50 + k) for h in range(8) for k in range(50)] + [(1049, 1050), (1099, 1100)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(3)} == {0} and [got[i] for i in range(3, 8)] == list(range(3, 8))
    assert all(label <= min(i, 7) for i, label in got.items())


def test_parts_of_orders_follow_the_line_items(spark, monkeypatch):
    folder = f"{DATA}/sf0.001"
    want = {tuple(r) for r in fixtures.part_pairs(spark, folder).collect()}
    monkeypatch.setattr(fixtures, "PART_ROWS", 100)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    pairs = fixtures.part_pairs(spark, folder)
    assert pairs.rdd.getNumPartitions() == -(-n // 100)
    assert {tuple(r) for r in pairs.collect()} == want


def test_search_writes_no_more_than_the_edges(spark, monkeypatch):
    sizes = []
    _noting(monkeypatch, splits, "cut_lineage", sizes)
    edges = list(itertools.combinations(range(24), 2))
    held = splits.held_out_edges_by_search(spark.createDataFrame(edges, "src long, dst long").withColumn("w", F.lit(1.0)), 0.5, 3)
    assert held.distinct().count() == len(edges) // 2
    assert max(sizes) <= len(edges)


def test_no_entry_carries_a_vector(spark, monkeypatch):
    rng = np.random.default_rng(5)
    width = linalg.COLUMNS + 10
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (300, 2))} | {(7, b) for b in range(60)} | {(a, 3) for a in range(60)})
    a = spark.createDataFrame([(i, j, float(i - j + 1)) for i, j in cells], "src long, dst long, w double")
    x = rng.normal(size=(50, width))
    thin = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    dense = np.zeros((60, 50))
    for i, j in cells:
        if j < 50:
            dense[i, j] = i - j + 1
    for numbers, strip in ((1 << 24, 1 << 22), (40 * width, 7 * width)):
        monkeypatch.setattr(linalg, "THIN", numbers)
        monkeypatch.setattr(linalg, "CELLS", strip)
        found = linalg.times_thin(a, thin, width)
        assert "Join" not in found._jdf.queryExecution().toString()
        rows = found.collect()
        assert len({r.id for r in rows}) == len(rows) == len({i for i, j in cells if j < 50})
        for r in rows:
            assert np.allclose(r.vec, dense[r.id] @ x, atol=1e-9)


def test_moments_of_powers_deal_nothing_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, 50, (500, 2))} | {(9, b) for b in range(50)})
    a = spark.createDataFrame([(i, j, float(i + j)) for i, j in cells] + [(9, 9, 1.0), (None, 3, 1.0)], "src long, dst long, w double")
    m = np.zeros((50, 50))
    for i, j in cells:
        m[i, j] = i + j
    m[9, 9] += 1
    held = (m != 0) | np.isin(np.arange(2500).reshape(50, 50), [50 * i + j for i, j in cells])
    want, stored = m + m @ m, held | (held.astype(float) @ held.astype(float) > 0)
    for most in (1 << 22, 100):  # the long row comes in stretches
        monkeypatch.setattr(linalg, "CELLS", most)
        found = linalg.power_sum_moments(a, 2)
        plan = found._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan
        got = {r.src: (r.n, r.total, r.squares) for r in found.collect()}
        assert got == {i: (stored[i].sum(), want[i].sum(), (want[i] ** 2).sum()) for i in range(50) if held[i].any()}


def test_moments_of_walks_divide_rows_as_they_are_read(spark):
    rng = np.random.default_rng(7)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (150, 2))})
    m = np.zeros((30, 30))
    for i, j in cells:
        m[i, j] = 1 + (i * j) % 5
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in cells], "src long, dst long, w double")
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-32)
    first, second = 1 / 1.8, 0.8 / 1.8
    for steps, want in ((1, p), (2, first * p + second * (p @ p))):
        found = linalg.walk_sum_moments(a, 0.2, steps, shares=True)
        assert "Exchange" not in found._jdf.queryExecution().toString()
        got = {r.src: (r.n, r.total, r.squares) for r in found.collect()}
        assert set(got) == set(np.flatnonzero(m.any(axis=1)))
        assert all(np.allclose(v, ((want[i] > 0).sum(), want[i].sum(), (want[i] ** 2).sum()), atol=1e-12) for i, v in got.items())


def test_first_rows_are_told_without_writing_them(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STRETCHES", 8)
    rows = [((i * 37 % 50) / 10.0 - 2, i) for i in range(200)]
    df = spark.createDataFrame(rows, "v double, k long")
    sizes = []
    _noting(monkeypatch, ranking, "cut_lineage", sizes)
    for limit in (1, 100_000):
        monkeypatch.setattr(ranking, "SMALL_LIMIT", limit)
        for n in (0, 1, 7, 100, 199, 200, 300):
            told = ranking.among_first(df, n, "v", "k")
            assert sorted(tuple(r) for r in df.where(told).collect()) == sorted(rows)[:n]
            assert df.where(~told).count() == max(0, 200 - n)
    assert max(sizes) < 60


def test_kept_tables_are_read_again_and_go(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, -0.0, "b")], "a long, b double, c string")
    kept = session.keep(df)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and kept.schema == df.schema
    place = kept._kept.removeprefix("file://")
    assert os.path.isdir(place)
    session.drop(kept)
    assert not os.path.exists(place)


def test_splits_write_no_row_of_edges_as_it_is(spark, monkeypatch):
    sizes = []
    for module in (splits, graph, ranking):
        _noting(monkeypatch, module, "cut_lineage", sizes)
    edges = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "src long, dst long").withColumn("w", F.lit(1.0))
    parts = splits.split(edges, 0.3, 1)
    assert parts.test.count() == 234
    assert max(sizes) < 200  # of 780 edges; nodes and trees only


def test_walks_are_not_dealt_out_at_each_step(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cells = sorted({(int(a), int(b)) for a, b in rng.integers(-1, 20, (120, 2))})
    edges = spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in cells] + [(3, 4, 0.0), (30, 31, 1.0)], "src long, dst long, w double")
    starts = spark.createDataFrame([(k, k % 21 - 1) for k in range(63)] + [(99, 30), (100, 77)], "walk_id long, start long")
    writes = []
    _noting(monkeypatch, walks, "cut_lineage", writes)
    found = walks.biased_walk(edges, starts, 12, 0.5, 2.0, 3)
    plan = found._jdf.queryExecution().toString()
    assert not writes and "Join" not in plan
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.walk_id, []).append((r.step, r.node))
    heads = {a for a, b in cells} | {30}
    assert got.pop(99) == [(0, 30), (1, 31)] and got.pop(100) == [(0, 77)] and len(got) == 63
    for k, steps in got.items():
        nodes = [n for _, n in steps]
        assert [s for s, _ in steps] == list(range(len(steps))) and nodes[0] == k % 21 - 1
        assert len(steps) == 12 or nodes[-1] not in heads
        assert all(pair in set(cells) for pair in zip(nodes, nodes[1:]))


def test_wide_products_read_edges_that_are_kept_compactly(spark, monkeypatch):
    seen = []

    def stop(edges, *more, **named):
        seen.append(edges)
        raise InterruptedError

    monkeypatch.setattr(linalg, "svd", stop)
    for name in ("svd_supplier_part", "score_blocks"):
        with pytest.raises(InterruptedError):
            catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert len(seen) == 2 and all(hasattr(edges, "_kept") for edges in seen)
