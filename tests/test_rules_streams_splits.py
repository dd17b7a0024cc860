"""Rules, late steps in a stream, connectivity splits and hexagons against brute force."""

import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import benchmark, evaluate, splits
from graphloom.plans import rules
from graphloom.streaming import pairs


def test_rules_run_and_skip(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"

    def copy(add):
        def make(s, given, out):
            df = s.read.parquet(given[0])
            df.select((df.x + add).alias("x")).write.mode("overwrite").parquet(out[0])

        return make

    spark.range(5).select(F.col("id").alias("x")).write.parquet(at("a"))
    made = [rules.Rule("c", (at("b"),), (at("c"),), copy(10)), rules.Rule("b", (at("a"),), (at("b"),), copy(1)), rules.Rule("d", (at("a"),), (at("d"),), copy(2))]
    assert rules.run(spark, made, [at("c")]) == ["b", "c"] and rules.run(spark, made) == ["d"] and rules.run(spark, made) == []
    assert sorted(r.x for r in spark.read.parquet(at("c")).collect()) == [11, 12, 13, 14, 15]
    time.sleep(1.1)
    spark.range(3).select(F.col("id").alias("x")).write.mode("overwrite").parquet(at("a"))
    assert rules.run(spark, made) == ["b", "c", "d"] and spark.read.parquet(at("c")).count() == 3
    with pytest.raises(ValueError, match="missing"):
        rules.run(spark, [rules.Rule("x", (at("none"),), (at("y"),), copy(0))])
    with pytest.raises(ValueError, match="own output"):
        rules.in_order([rules.Rule("x", (at("y"),), (at("z"),), copy(0)), rules.Rule("w", (at("z"),), (at("y"),), copy(0))])
    with pytest.raises(ValueError, match="no rule"):
        rules.in_order(made, [at("q")])
    with pytest.raises(ValueError, match="output of"):
        rules.in_order([*made, made[0]])
    assert rules.expand("{m}-{d}", m=["a", "b"], d=[1, 2]) == ["a-1", "a-2", "b-1", "b-2"]


def test_late_steps_are_counted(spark):
    rng = random.Random(2)
    rows = [(w, t, rng.randint(0, 4), 1_700_000_000 + 60 * t + w) for w in range(6) for t in range(rng.choice([1, 2, 9, 40]))]
    steps = spark.createDataFrame(rows, "walk_id long, step long, node long, s long").select("walk_id", "step", "node", F.timestamp_seconds("s").alias("ts"))
    node = {(w, t): n for w, t, n, _ in rows}
    want = collections.Counter((n, node[w, t + k]) for (w, t), n in node.items() for k in (1, 2, 3) if (w, t + k) in node)
    got = pairs.stream_pair_counts(spark, steps, 3, batches=3, late="2 hours", apart="10 minutes")
    assert {(r.center, r.context): r.freq for r in got.collect()} == dict(want)


def parts(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return len({find(x) for x in nodes})


@pytest.mark.parametrize("fraction", [0.1, 0.5])
def test_split_by_search_keeps_components(spark, fraction):
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(160)} | {(100, 101), (101, 102), (100, 102)} | {(0, 200), (200, 201)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 1.0) for a, b in list(edges)[:20]] + [(5, 5, 1.0)], "src long, dst long, w double")
    held = [(r.src, r.dst) for r in splits.held_out_edges_by_search(df, fraction, 3).collect()]
    assert len(held) == len(set(held)) == int(len(edges) * fraction) and set(held) <= edges
    nodes = {x for e in edges for x in e}
    assert parts(edges - set(held), nodes) == parts(edges, nodes)
    assert not set(held) & {(0, 200), (200, 201)}  # an end of degree one


def test_split_by_search_of_a_tree(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src long, dst long, w double")
    with pytest.raises(ValueError):
        splits.held_out_edges_by_search(chain, 0.3)
    ring = spark.createDataFrame([(i, (i + 1) % 9, 1.0) for i in range(9)], "src long, dst long, w double")
    assert splits.held_out_edges_by_search(ring, 0.12).count() == 1
    assert splits.held_out_edges_by_search(chain, 0.05).count() == 0


def test_hexagons_take_the_nearest_center(spark):
    rng = random.Random(4)
    points = [(rng.uniform(-9, 9), rng.uniform(-5, 5)) for _ in range(500)] + [(0.0, 0.0), (1.0, 3**0.5)]
    size = 2.0
    centers = [(i * size + h, (j * size + h) * 3**0.5) for i in range(-9, 9) for j in range(-9, 9) for h in (0, size / 2)]
    want = collections.Counter(min(centers, key=lambda c: math.dist(c, p)) for p in points)
    df = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0)], "x double, y double")
    got = {(round(r.cx, 6), round(r.cy, 6)): r.n for r in evaluate.hex_binned(df, "x", "y", size).collect()}
    assert got == {(round(x, 6), round(y, 6)): n for (x, y), n in want.items()}
    assert evaluate.hex_binned(df, "x", "y", size, 99).count() == 0


def test_benchmark_graph(spark):
    nodes = spark.range(100, 900).select("id")
    edges, groups = benchmark.benchmark_graph(nodes, 8, 20, 0.25, (40, 80), 2.5, 1.0, 5)
    pairs = [(r.src, r.dst) for r in edges.collect()]
    group = {r.id: r.grp for r in groups.collect()}
    degree = {r.id: r.degree for r in benchmark.drawn_degrees(nodes, 8, 20, 2.5, 5).collect()}
    assert set(group) == set(range(100, 900)) and all(a != b for a, b in pairs) and len(set(pairs)) == len(pairs) and {(b, a) for a, b in pairs} == set(pairs)
    sizes = collections.Counter(group.values())
    assert min(sizes.values()) >= 40 and sorted(sizes.values())[-2] <= 80 and max(sizes.values()) <= 119
    got = collections.Counter(a for a, _ in pairs)
    assert all(got[i] <= degree[i] for i in group) and sum(degree.values()) - len(pairs) <= 0.02 * len(pairs)
    assert abs(sum(degree.values()) / 800 - 8) < 0.8 and max(degree.values()) <= 20
    assert abs(sum(group[a] != group[b] for a, b in pairs) / len(pairs) - 0.25) < 0.04
    with pytest.raises(ValueError):
        benchmark.lowest_for(50, 40, 2.5)
