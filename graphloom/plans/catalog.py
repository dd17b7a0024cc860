"""Registry of the engine's queries with their oracle SQL.

A query takes ``(spark, folder)`` and applies operators to whole tables of
the folder; its oracle is written in plain SQL from the definition of the
result.  Values are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.functions.ranking import first_rows
from graphloom.functions.scalar import rounded
from graphloom.functions.session import cut_lineage, keep, shared_folder, table
from graphloom.operators import benchmark, blocks, evaluate, graph, linalg, models, samplers, splits, walks
from graphloom.plans import experiments
from graphloom.sources import files, fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "link_auc_nation"

EDGES = """edges AS (
  SELECT CAST(c.c_nationkey AS BIGINT) AS src, CAST(s.s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)"""
GROUPS = "groups AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS grp FROM nation)"
PARTS = """parts AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""
BIPARTITE = "bip AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)"
EVENTS = """walks AS (
  SELECT user_id AS walk_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
         dense_rank() OVER (ORDER BY event_type) - 1 AS node FROM events)"""
TRANS = "trans AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM edges)"
PSBM = """lam AS (SELECT a.grp AS src, b.grp AS dst, sum(w) AS w FROM edges JOIN groups a ON a.id = src JOIN groups b ON b.id = dst GROUP BY 1, 2),
psbm AS (SELECT src, dst, w / greatest(sum(w) OVER (PARTITION BY src), 1.0) AS w FROM lam)"""
INDEG = "indeg AS (SELECT dst AS id, sum(w) AS d FROM edges GROUP BY 1)"
CDF = """cdf AS (SELECT src, dst, sum(w) OVER r - w AS lo, sum(w) OVER r AS hi, sum(w) OVER (PARTITION BY src) AS tot FROM edges
  WINDOW r AS (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING))"""


def u(*parts: str) -> str:
    """The portable uniform draw in SQL; parts are SQL expressions."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT) / CAST(4503599627370496.0 AS DOUBLE))"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _w(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", rounded(F.col("w")).alias("w"))


def _nation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cut_lineage(fixtures.nation_edges(spark, d)), fixtures.nation_groups(spark, d)


# ---------------------------------------------------------------- graphs

query("edges_nation", f"WITH {EDGES} SELECT src, dst, w FROM edges")(fixtures.nation_edges)
query("edges_supplier_part", f"WITH {BIPARTITE} SELECT * FROM bip")(fixtures.supplier_part_edges)
query("edges_part_copurchase", f"WITH {PARTS} SELECT * FROM parts")(fixtures.part_pairs)


@query("reindex_nodes", f"""WITH {BIPARTITE}, ids AS (SELECT src AS id FROM bip UNION SELECT dst FROM bip)
SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM ids""")
def _reindex(spark: SparkSession, d: str) -> DataFrame:
    return graph.dense_codes(graph.nodes_of(fixtures.supplier_part_edges(spark, d)), "id")


@query("reindexed_edges", f"""WITH {BIPARTITE}, ids AS (SELECT src AS id FROM bip UNION SELECT dst FROM bip),
c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM ids)
SELECT a.code AS src, b.code AS dst, w FROM bip JOIN c a ON a.id = src JOIN c b ON b.id = dst""")
def _reindexed(spark: SparkSession, d: str) -> DataFrame:
    return graph.reindexed(fixtures.supplier_part_edges(spark, d))[0]


@query("symmetrize", f"WITH {EDGES} SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY 1, 2")
def _symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return graph.symmetrised(fixtures.nation_edges(spark, d))


query("upper_triangle", f"WITH {EDGES} SELECT src, dst, w FROM edges WHERE src < dst")(lambda s, d: graph.upper_triangle(fixtures.nation_edges(s, d)))
query("no_self_loops", f"WITH {EDGES} SELECT src, dst, w FROM edges WHERE src <> dst")(lambda s, d: graph.without_loops(fixtures.nation_edges(s, d)))


@query("directed_mix", f"""WITH {EDGES}, o AS (SELECT src AS id, sum(w) AS o FROM edges GROUP BY 1), i AS (SELECT dst AS id, sum(w) AS i FROM edges GROUP BY 1),
eta AS (SELECT coalesce(o.id, i.id) AS id, CASE WHEN coalesce(o, 0) = 0 THEN 1.0 WHEN coalesce(i, 0) = 0 THEN 0.0
  ELSE o * CAST(0.3 AS DOUBLE) / (i * CAST(0.7 AS DOUBLE) + o * CAST(0.3 AS DOUBLE)) END AS eta FROM o FULL JOIN i ON o.id = i.id)
SELECT src, dst, {r6('sum(w)')} AS w FROM (
  SELECT src, dst, w * (1 - eta) AS w FROM edges JOIN eta ON eta.id = src UNION ALL
  SELECT dst, src, w * eta FROM edges JOIN eta ON eta.id = dst) GROUP BY 1, 2""")
def _mix(spark: SparkSession, d: str) -> DataFrame:
    return _w(graph.directed_mix(fixtures.nation_edges(spark, d), 0.3))


@query("weak_reciprocal", f"WITH {EDGES} SELECT src, dst, {r6('sum(w)')} AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w * CAST(0.01 AS DOUBLE) FROM edges) GROUP BY 1, 2")
def _weak(spark: SparkSession, d: str) -> DataFrame:
    return _w(graph.weak_reciprocal(fixtures.nation_edges(spark, d)))


@query("degree_in_out", f"""WITH {BIPARTITE} SELECT id, sum(o) AS out_w, sum(i) AS in_w FROM (
  SELECT src AS id, w AS o, CAST(0 AS DOUBLE) AS i FROM bip UNION ALL SELECT dst, CAST(0 AS DOUBLE), w FROM bip) GROUP BY 1""")
def _degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(fixtures.supplier_part_edges(spark, d))


@query("mean_degree", f"WITH {EDGES} SELECT {r6('sum(w) / (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges))')} AS mean_degree FROM edges")
def _mean_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.mean_degree(fixtures.nation_edges(spark, d)).select(rounded(F.col("mean_degree")).alias("mean_degree"))


query("transition_matrix", f"WITH {EDGES}, {TRANS} SELECT src, dst, {r6('w')} AS w FROM trans")(lambda s, d: _w(graph.transition(fixtures.nation_edges(s, d))))


@query("norm_adjacency", f"""WITH {EDGES}, dg AS (SELECT src AS id, greatest(sum(w), 1e-12) AS d FROM edges GROUP BY 1)
SELECT src, dst, {r6('w * sqrt(1 / a.d) * sqrt(1 / b.d)')} AS w FROM edges JOIN dg a ON a.id = src JOIN dg b ON b.id = dst""")
def _norm(spark: SparkSession, d: str) -> DataFrame:
    return _w(graph.normalised_adjacency(fixtures.nation_edges(spark, d)))


@query("fairwalk_weights", f"WITH {EDGES}, {GROUPS} SELECT src, dst, {r6('1.0 / count(*) OVER (PARTITION BY src, grp)')} AS w FROM edges JOIN groups ON id = dst")
def _fair(spark: SparkSession, d: str) -> DataFrame:
    return _w(graph.fairwalk_weights(fixtures.nation_edges(spark, d), fixtures.nation_groups(spark, d)))


@query("fairwalk_degree_classes", f"""WITH {BIPARTITE}, b2 AS (SELECT src, dst, w FROM bip UNION ALL SELECT dst, src, w FROM bip),
c AS (SELECT src AS id, count(*) AS grp FROM b2 GROUP BY 1) SELECT src, dst, {r6('1.0 / count(*) OVER (PARTITION BY src, grp)')} AS w FROM b2 JOIN c ON id = dst""")
def _fair_degree(spark: SparkSession, d: str) -> DataFrame:
    return _w(graph.fairwalk_weights(graph.symmetrised(fixtures.supplier_part_edges(spark, d))))


@query("line_graph_pq", f"""WITH {EDGES} SELECT a.src AS prev, a.dst AS cur, b.dst AS nxt,
{r6('b.w * CASE WHEN b.dst = a.src THEN 1.0 / 0.5 WHEN c.src IS NOT NULL THEN 1.0 ELSE 1.0 / 2.0 END')} AS w
FROM edges a JOIN edges b ON a.dst = b.src LEFT JOIN edges c ON c.src = a.src AND c.dst = b.dst
UNION ALL SELECT src, src, dst, w FROM edges""")
def _line(spark: SparkSession, d: str) -> DataFrame:
    return graph.line_graph(fixtures.nation_edges(spark, d), 0.5, 2.0).select("prev", "cur", "nxt", rounded(F.col("w")).alias("w"))


query("membership_matrix", f"WITH {GROUPS} SELECT DISTINCT id AS src, grp AS dst, CAST(1 AS DOUBLE) AS w FROM groups")(lambda s, d: graph.membership_matrix(fixtures.nation_groups(s, d)))


def _labels_sql(source: str, rounds: int = 12) -> str:
    """CTE comp(id, label): the smallest label spreads to the neighbours, for
    more rounds than these graphs have hops."""
    ctes = [f"both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM {source} UNION SELECT dst, src FROM {source})", "l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS label FROM both_ways)"]
    ctes += [f"l{t} AS MATERIALIZED (SELECT a AS id, least(min(x.label), min(y.label)) AS label FROM both_ways JOIN l{t - 1} x ON x.id = b JOIN l{t - 1} y ON y.id = a GROUP BY 1)" for t in range(1, rounds + 1)]
    return ", ".join([*ctes, f"comp AS (SELECT id, label FROM l{rounds})"])


COMPONENTS = f"{PARTS}, {_labels_sql('parts')}"


query("components", f"WITH {COMPONENTS} SELECT id, label FROM comp")(lambda s, d: graph.components(cut_lineage(fixtures.part_pairs(s, d).select("src", "dst"))))


@query("largest_component", f"""WITH {COMPONENTS},
best AS (SELECT label FROM comp GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)
SELECT src, dst, w FROM parts JOIN comp ON id = src WHERE label = (SELECT label FROM best)""")
def _largest(spark: SparkSession, d: str) -> DataFrame:
    return graph.largest_component(cut_lineage(fixtures.part_pairs(spark, d)))


query("connectivity", f"WITH {COMPONENTS} SELECT count(*) AS n_nodes, count(DISTINCT label) AS n_components, count(DISTINCT label) = 1 AS connected FROM comp")(
    lambda s, d: graph.connectivity(cut_lineage(fixtures.part_pairs(s, d).select("src", "dst")))
)


def _tree_weight_sql() -> str:
    # an edge is in the forest iff its ends are not joined by strictly smaller edges
    return f"""WITH RECURSIVE {EDGES}, und AS (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM edges WHERE src <> dst GROUP BY 1, 2),
k AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS k FROM und),
step AS (SELECT a AS x, b AS y, k FROM k UNION ALL SELECT b, a, k FROM k),
reach(k, goal, id) AS (SELECT k, b, a FROM k UNION SELECT r.k, r.goal, s.y FROM reach r JOIN step s ON s.x = r.id AND s.k < r.k)
SELECT a AS src, b AS dst, w FROM k WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k = k.k AND r.id = r.goal)"""


query("spanning_tree", _tree_weight_sql())(lambda s, d: graph.spanning_tree(fixtures.nation_edges(s, d)))


_BLOCK_WANT = {kind: graph._binomial(total, p, f"blocks-{kind}", 7) for kind, total, p in (("within", 30 * 29, 0.28), ("between", 30 * 30, 0.12))}
_BLOCK_SQL = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT src, dst FROM (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(k) AS k FROM (SELECT k, CAST(floor({u(f"'blocks-{kind}-a'", 'k', "'7'")} * 60) AS BIGINT) AS a,
CAST(floor({u(f"'blocks-{kind}-b'", 'k', "'7'")} * 60) AS BIGINT) AS b FROM (SELECT CAST(range AS BIGINT) AS k FROM range(20000))) WHERE a <> b AND (a // 30 {op} b // 30) GROUP BY 1, 2) ORDER BY k LIMIT {_BLOCK_WANT[kind]})"""
    for kind, op in (("within", "="), ("between", "<>"))
)


@query("two_block_graph", f"WITH k AS ({_BLOCK_SQL}) SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM k UNION ALL SELECT dst, src, CAST(1 AS DOUBLE) FROM k")
def _two_blocks(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_block_graph(spark, 60, 0.28, 0.12, 7)


def _benchmark_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"))


_LOWEST = benchmark.lowest_for(12, 60, 2.5)
query("benchmark_degrees", f"SELECT CAST(p_partkey AS BIGINT) AS id, CAST(greatest(1, floor(pow({_LOWEST ** -1.5!r} + {u("'degree'", 'CAST(p_partkey AS BIGINT)', "'3'")} * CAST({60 ** -1.5 - _LOWEST ** -1.5!r} AS DOUBLE), CAST({1 / -1.5!r} AS DOUBLE)) + 0.5)) AS BIGINT) AS degree FROM part")(
    lambda s, d: benchmark.drawn_degrees(_benchmark_nodes(s, d), 12, 60, 2.5, 3)
)


@query("benchmark_graph", "SELECT count(*) AS n_nodes, true AS simple, true AS mixed, true AS sized FROM part")
def _benchmark_graph(spark: SparkSession, d: str) -> DataFrame:
    """A graph over all parts: no loop or repeat, 0.3 of the edges between communities of 20 to 60."""
    edges, groups = benchmark.benchmark_graph(_benchmark_nodes(spark, d), 12, 60, 0.3, (20, 60), 2.5, 1.0, 3)
    edges, groups = cut_lineage(edges), cut_lineage(groups)
    laid = edges.join(groups.toDF("src", "ga"), "src").join(groups.toDF("dst", "gb"), "dst")
    mixing = laid.agg(F.avg((F.col("ga") != F.col("gb")).cast("int")).alias("mu"), F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("once"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_nodes"), F.min("n").alias("low"), F.max("n").alias("high"))
    both = sizes.join(mixing)  # one row each
    return both.select("n_nodes", ((F.col("once") == F.col("n")) & (F.col("loops") == 0)).alias("simple"), (F.abs(F.col("mu") - 0.3) < 0.05).alias("mixed"), ((F.col("low") >= 20) & (F.col("high") <= 79)).alias("sized"))


_STUBS = """laid AS (SELECT src, dst, a.grp AS gs, b.grp AS gd, floor({salt} * 64) AS salt FROM edges JOIN groups a ON a.id = src JOIN groups b ON b.id = dst),
sa AS (SELECT gs, gd, salt, src, row_number() OVER (PARTITION BY gs, gd, salt ORDER BY {a}, src, dst) AS r FROM laid), sb AS (SELECT gs, gd, salt, dst, row_number() OVER (PARTITION BY gs, gd, salt ORDER BY {b}, dst, src) AS r FROM laid)""".format(
    salt=u("'stub-salt'", "src", "dst", "'0'"), a=u("'stub-src'", "src", "dst", "'0'"), b=u("'stub-dst'", "src", "dst", "'0'")
)
query("block_shuffled_graph", f"WITH {EDGES}, {GROUPS}, {_STUBS} SELECT DISTINCT src, dst, CAST(1 AS DOUBLE) AS w FROM sa JOIN sb USING (gs, gd, salt, r) WHERE src <> dst")(lambda s, d: graph.block_shuffled(fixtures.nation_edges(s, d), fixtures.nation_groups(s, d)))
query("value_counts", f"WITH {EVENTS} SELECT node, count(*) AS n FROM walks GROUP BY 1")(lambda s, d: fixtures.event_walks(s, d).groupBy("node").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- walks

query("cdf_table", f"WITH {EDGES}, {CDF} SELECT src, dst, {r6('hi / tot')} AS cum FROM cdf")(lambda s, d: walks.cdf_table(fixtures.nation_edges(s, d)).select("src", "dst", rounded(F.col("cum")).alias("cum")))

STARTS = "s0 AS (SELECT id * 2 + k AS walk_id, id AS start, id AS node FROM groups, (SELECT CAST(range AS BIGINT) AS k FROM range(2)))"


def _walk_sql(length: int, node: str) -> str:
    ctes = [EDGES, GROUPS, CDF, STARTS]
    for t in range(1, length):
        draw = u("'walk'", "walk_id", f"'{t}'", "'42'")
        ctes.append(f"s{t} AS MATERIALIZED (SELECT walk_id, start, {node.format(t=t)} AS node FROM (SELECT walk_id, start, node, {draw} AS u FROM s{t - 1}) p JOIN cdf c ON c.src = p.node AND u * tot >= lo AND u * tot < hi)")
    union = " UNION ALL ".join(f"SELECT walk_id, CAST({t} AS BIGINT) AS step, node FROM s{t}" for t in range(length))
    return f"WITH {', '.join([*ctes, f'wk AS ({union})'])} SELECT walk_id, step, node FROM wk"


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return walks.start_walks(fixtures.nation_groups(spark, d).select("id"), 2)


query("walk_first_order", _walk_sql(8, "c.dst"))(lambda s, d: walks.walk(fixtures.nation_edges(s, d), _starts(s, d), 8, 42))
RESTART = u("'restart'", "walk_id", "'{t}'", "'42'")
query("walk_restart", _walk_sql(6, f"CASE WHEN {RESTART} <= 0.3 THEN start ELSE c.dst END"))(lambda s, d: walks.walk(fixtures.nation_edges(s, d), _starts(s, d), 6, 42, 0.3))
TELEPORT = u("'teleport'", "walk_id", "'{t}'", "'42'")
query("walk_teleport", _walk_sql(6, f"CASE WHEN {RESTART} <= 0.3 THEN CAST(floor({TELEPORT} * 25) AS BIGINT) ELSE c.dst END"))(
    lambda s, d: walks.walk(fixtures.nation_edges(s, d), _starts(s, d), 6, 42, 0.3, 25)
)


def _biased_sql(length: int, p: float, q: float, graph: str = EDGES, starts: str | None = None, tries: int = 100) -> str:
    """Proposals 0..tries-1 of every step at once; the first one accepted counts."""
    starts = starts or f"{GROUPS}, s0 AS (SELECT id * 2 + k AS walk_id, id AS prev, id AS cur FROM groups, (SELECT CAST(range AS BIGINT) AS k FROM range(2)))"
    ctes = [graph, CDF, starts, f"tries AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS try FROM range({tries}))", "tots AS MATERIALIZED (SELECT DISTINCT src, tot FROM cdf)", "flat AS MATERIALIZED (SELECT src, dst, lo, tot FROM cdf)", "pairs AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges)"]
    top = max(1 / p, 1.0, 1 / q)
    for t in range(1, length):
        draw, accept = (u(f"'{use}'", "walk_id", f"'{t}'", "try", "'42'") for use in ("walk", "accept"))
        bias = str(top) if t == 1 else f"CASE WHEN c.dst = x.prev THEN {1 / p} WHEN near.a IS NOT NULL THEN 1.0 ELSE {1 / q} END"
        ctes.append(f"""s{t} AS MATERIALIZED (SELECT x.walk_id, any_value(x.cur) AS prev, arg_min(c.dst, x.try) AS cur
  FROM (SELECT walk_id, prev, cur, try, {draw} * tot AS u, {accept} AS a FROM s{t - 1} JOIN tots ON tots.src = cur, tries) x
  ASOF JOIN flat c ON c.src = x.cur AND x.u >= c.lo LEFT JOIN pairs near ON near.a = x.prev AND near.b = c.dst
  WHERE x.a * {top} < {bias} GROUP BY 1)""")
    union = " UNION ALL ".join(f"SELECT walk_id, CAST({t} AS BIGINT) AS step, cur AS node FROM s{t}" for t in range(length))
    return f"WITH {', '.join(ctes)} {union}"


ONES = "edges AS (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM weighted WHERE w > 5)"
BOTH_WAYS = f"{BIPARTITE}, edges AS (SELECT src, dst, w FROM bip UNION ALL SELECT dst, src, w FROM bip)"
query("walk_node2vec_unweighted", _biased_sql(40, 0.5, 2.0, EDGES.replace("edges AS (", "weighted AS (", 1) + ", " + ONES))(
    lambda s, d: walks.biased_walk(fixtures.nation_edges(s, d).where("w > 5"), _starts(s, d), 40, 0.5, 2.0, 42, weighted=False)
)
query("walk_node2vec", _biased_sql(40, 0.5, 2.0))(lambda s, d: walks.biased_walk(fixtures.nation_edges(s, d), _starts(s, d), 40, 0.5, 2.0, 42))


@query("walk_node2vec_supplier_part", _biased_sql(40, 0.5, 2.0, BOTH_WAYS, "s0 AS (SELECT DISTINCT src AS walk_id, src AS prev, src AS cur FROM edges)"))
def _walk_large(spark: SparkSession, d: str) -> DataFrame:
    edges = cut_lineage(graph.symmetrised(fixtures.supplier_part_edges(spark, d)))
    return walks.biased_walk(edges, walks.start_walks(graph.nodes_of(edges), 1), 40, 0.5, 2.0, 42)


_WINDOW = "SELECT a.walk_id, a.step, a.node AS center, b.node AS context FROM walks a JOIN walks b ON a.walk_id = b.walk_id AND {cond}"
query("event_windows_trim", f"WITH {EVENTS}, m AS (SELECT walk_id, max(step) AS last FROM walks GROUP BY 1) {_WINDOW.format(cond='b.step BETWEEN a.step + 1 AND a.step + 3')} JOIN m ON m.walk_id = a.walk_id AND a.step + 3 <= last")(
    lambda s, d: walks.windows(fixtures.event_walks(s, d), 3, "right", True)
)
for _side, _cond in (("right", "b.step BETWEEN a.step + 1 AND a.step + 3"), ("left", "b.step BETWEEN a.step - 3 AND a.step - 1"), ("double", "b.step BETWEEN a.step - 3 AND a.step + 3 AND b.step <> a.step")):
    query(f"event_windows_{_side}", f"WITH {EVENTS} {_WINDOW.format(cond=_cond)}")(lambda s, d, side=_side: walks.windows(fixtures.event_walks(s, d), 3, side))

PAIRS = f"{EVENTS}, pairs AS (SELECT a.node AS center, b.node AS context, count(*) AS freq FROM walks a JOIN walks b ON a.walk_id = b.walk_id AND b.step BETWEEN a.step + 1 AND a.step + 3 GROUP BY 1, 2)"


def _event_pairs(spark: SparkSession, d: str) -> DataFrame:
    return walks.pair_counts(walks.windows(fixtures.event_walks(spark, d), 3, "right"))


query("pair_counts", f"WITH {PAIRS} SELECT * FROM pairs")(_event_pairs)
query("pair_keys", f"WITH {PAIRS} SELECT CAST((center + context) * (center + context + 1) // 2 + context AS BIGINT) AS key, freq FROM pairs")(lambda s, d: walks.pair_keys(_event_pairs(s, d)))
query("context_transition", f"WITH {PAIRS} SELECT center AS src, context AS dst, {r6('CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY center)')} AS w FROM pairs")(lambda s, d: _w(walks.context_transition(_event_pairs(s, d))))
query("center_share", f"WITH {PAIRS} SELECT center, {r6('CAST(sum(freq) AS DOUBLE) / (SELECT sum(freq) FROM pairs)')} AS share FROM pairs GROUP BY 1")(lambda s, d: walks.center_share(_event_pairs(s, d)).select("center", rounded(F.col("share")).alias("share")))
query("walk_sentences", f"WITH {EVENTS} SELECT walk_id, string_agg(CAST(node AS VARCHAR), ' ' ORDER BY step) AS words FROM walks GROUP BY 1")(
    lambda s, d: walks.sentences(fixtures.event_walks(s, d)).select("walk_id", F.array_join("words", " ").alias("words"))
)


@query("transition_lookup", f"WITH {PAIRS} SELECT g.a AS src, g.b AS dst, {r6('coalesce(t.w, 0)')} AS w FROM (SELECT DISTINCT x.node AS a, y.node AS b FROM walks x, walks y WHERE x.step = 0 AND y.step = 0) g LEFT JOIN (SELECT center, context, CAST(freq AS DOUBLE) / sum(freq) OVER (PARTITION BY center) AS w FROM pairs) t ON t.center = g.a AND t.context = g.b")
def _lookup(spark: SparkSession, d: str) -> DataFrame:
    first = fixtures.event_walks(spark, d).where("step = 0").select("node").distinct()
    asked = first.select(F.col("node").alias("src")).join(F.broadcast(first.select(F.col("node").alias("dst"))), F.lit(True))
    return _w(walks.transition_of(walks.context_transition(_event_pairs(spark, d)), asked))


@query("batch_pairs", f"""WITH {PAIRS}, c AS (SELECT center, sum(freq) OVER (ORDER BY center) - freq AS lo, sum(freq) OVER (ORDER BY center) AS hi, sum(freq) OVER () AS tot FROM (SELECT center, sum(freq) AS freq FROM pairs GROUP BY 1)),
x AS (SELECT center, context, sum(freq) OVER r - freq AS lo, sum(freq) OVER r AS hi, sum(freq) OVER (PARTITION BY center) AS tot FROM pairs WINDOW r AS (PARTITION BY center ORDER BY context ROWS UNBOUNDED PRECEDING)),
i AS (SELECT CAST(range AS BIGINT) AS draw FROM range(1000))
SELECT draw, c.center, x.context FROM i JOIN c ON {u("'batch-center'", 'draw', "'5'")} * c.tot >= c.lo AND {u("'batch-center'", 'draw', "'5'")} * c.tot < c.hi
JOIN x ON x.center = c.center AND {u("'batch-context'", 'draw', "'5'")} * x.tot >= x.lo AND {u("'batch-context'", 'draw', "'5'")} * x.tot < x.hi""")
def _batch(spark: SparkSession, d: str) -> DataFrame:
    return walks.batch_pairs(_event_pairs(spark, d), 1000, 5)


@query("pairing_functions", f"""WITH {EDGES} SELECT src, dst, CAST((src + dst) * (src + dst + 1) // 2 + dst AS BIGINT) AS key, src AS back_a, dst AS back_b,
CAST(least(src, dst) + greatest(src, dst) * 25 AS BIGINT) AS pair, CAST(least(src, dst) AS BIGINT) AS low, CAST(greatest(src, dst) AS BIGINT) AS high FROM edges""")
def _pairing(spark: SparkSession, d: str) -> DataFrame:
    e = fixtures.nation_edges(spark, d).withColumn("key", scalar.cantor(F.col("src"), F.col("dst"))).withColumn("pair", scalar.pair_id(F.col("src"), F.col("dst"), 25))
    a, b = scalar.cantor_inverse(F.col("key"))
    low, high = scalar.pair_of(F.col("pair"), 25)
    return e.select("src", "dst", "key", a.alias("back_a"), b.alias("back_b"), "pair", low.alias("low"), high.alias("high"))


@query("scalar_functions", f"""WITH {EDGES}, x AS (SELECT src, dst, (w - 100) / 50.0 AS x FROM edges) SELECT src, dst,
{r6('ln(greatest(x, 1e-12))')} AS safe_log, {r6('1.0 / greatest(x, 1.0)')} AS inverse, {r6('-ln(1 + exp(-x))')} AS log_sigmoid,
{r6('sign(x) * greatest(abs(x) - 0.5, 0)')} AS soft, {r6('greatest(sign(x) * greatest(abs(x) - 0.5, 0), 0)')} AS soft_positive, CAST(src AS VARCHAR) AS token FROM x""")
def _scalars(spark: SparkSession, d: str) -> DataFrame:
    x = fixtures.nation_edges(spark, d).withColumn("x", (F.col("w") - 100) / 50.0)
    c = F.col("x")
    return x.select("src", "dst", rounded(scalar.safe_log(c)).alias("safe_log"), rounded(scalar.safe_inverse(c, 1.0)).alias("inverse"), rounded(scalar.log_sigmoid(c)).alias("log_sigmoid"), rounded(scalar.soft_threshold(c, 0.5)).alias("soft"), rounded(scalar.soft_threshold(c, 0.5, True)).alias("soft_positive"), scalar.token(F.col("src")).alias("token"))


# ---------------------------------------------------------------- samplers

CENTERS = "centers AS (SELECT CAST(range AS BIGINT) AS draw, CAST(range % 25 AS BIGINT) AS center FROM range(2000))"


def _centers(spark: SparkSession) -> DataFrame:
    return spark.range(2000).select(F.col("id").alias("draw"), (F.col("id") % 25).alias("center"))


def _one_row_sql(use: str, options: str) -> str:
    return f"""o AS (SELECT id, sum(w) OVER (ORDER BY id) - w AS lo, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER () AS tot FROM ({options}))
SELECT draw, center, id AS context FROM (SELECT *, {u(f"'{use}'", 'draw', "'3'")} AS u FROM centers) c JOIN o ON u * tot >= lo AND u * tot < hi"""


query("noise_config", f"WITH {EDGES}, {CENTERS}, {_one_row_sql('noise-config', 'SELECT dst AS id, sum(w) AS w FROM edges GROUP BY 1')}")(lambda s, d: samplers.configuration_noise(3)(fixtures.nation_edges(s, d), _centers(s)))
query("noise_uniform", f"WITH {EDGES}, {CENTERS}, {_one_row_sql('noise-uniform', 'SELECT id, CAST(1 AS DOUBLE) AS w FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)')}")(
    lambda s, d: samplers.uniform_noise(3)(fixtures.nation_edges(s, d), _centers(s))
)


def _powers_sql(name: str, base: str, upto: int) -> str:
    """CTEs name1..nameT of the powers of a matrix CTE and their sum ``name``."""
    out = [f"{name}1 AS (SELECT src, dst, w FROM {base})"]
    out += [f"{name}{t} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM {name}{t - 1} a JOIN {base} b ON a.dst = b.src GROUP BY 1, 2)" for t in range(2, upto + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM {name}{t}" for t in range(1, upto + 1))
    return ", ".join([*out, f"{name} AS (SELECT src, dst, sum(w) AS w FROM ({union}) GROUP BY 1, 2)"])


SHARE = "share AS (SELECT i.id, grp, d / sum(d) OVER (PARTITION BY grp) AS share FROM indeg i JOIN groups g ON g.id = i.id)"
query("block_context_probability", f"WITH {EDGES}, {GROUPS}, {PSBM}, {INDEG}, {SHARE}, {_powers_sql('pw', 'psbm', 5)} SELECT src AS grp, id AS dst, {r6('w / 5 * share')} AS w FROM pw JOIN share ON share.grp = pw.dst")(
    lambda s, d: samplers.context_probability(*_nation(s, d), 5).select("grp", "dst", rounded(F.col("w")).alias("w"))
)


@query("noise_block", f"""WITH {EDGES}, {GROUPS}, {PSBM}, {INDEG}, {CENTERS}, {_powers_sql('pw', 'psbm', 5)},
bc AS (SELECT src, dst, sum(w) OVER r - w AS lo, sum(w) OVER r AS hi, sum(w) OVER (PARTITION BY src) AS tot FROM (SELECT src, dst, w / 5 AS w FROM pw) WINDOW r AS (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING)),
nc AS (SELECT grp AS src, id, sum(d) OVER r - d AS lo, sum(d) OVER r AS hi, sum(d) OVER (PARTITION BY grp) AS tot FROM indeg JOIN groups USING (id) WINDOW r AS (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING)),
b1 AS (SELECT draw, center, bc.dst AS g, {u("'noise-node'", 'draw', "'3'")} AS u2 FROM (SELECT draw, center, grp, {u("'noise-block'", 'draw', "'3'")} AS u FROM centers JOIN groups ON id = center) c JOIN bc ON bc.src = grp AND u * tot >= lo AND u * tot < hi)
SELECT draw, center, id AS context FROM b1 JOIN nc ON nc.src = g AND u2 * tot >= lo AND u2 * tot < hi""")
def _noise_block(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    return samplers.block_noise(groups, 5, True, 3)(edges, _centers(spark))


query("joint_centers", f"WITH {EDGES}, centers AS (SELECT CAST(range AS BIGINT) AS draw, NULL AS center FROM range(2000)), x AS ({'SELECT draw, context AS center FROM (WITH ' + _one_row_sql('joint-center', 'SELECT dst AS id, sum(w) AS w FROM edges GROUP BY 1') + ')'}) SELECT * FROM x")(
    lambda s, d: samplers.joint_centers(fixtures.nation_edges(s, d), 2000, 3)
)


@query("categorical_draw", f"WITH {EDGES}, {CDF}, {CENTERS} SELECT draw, c.center AS src, dst FROM (SELECT *, {u(chr(39) + 'categorical' + chr(39), 'draw', chr(39) + '3' + chr(39))} AS u FROM centers) c JOIN cdf ON cdf.src = c.center AND u * tot >= lo AND u * tot < hi")
def _categorical(spark: SparkSession, d: str) -> DataFrame:
    return samplers.categorical(_centers(spark).select("draw", F.col("center").alias("src")), fixtures.nation_edges(spark, d), 3).select("draw", "src", "dst")


@query("negative_edges", f"""WITH {PARTS}, n AS (SELECT count(*) AS n FROM (SELECT src AS id FROM parts UNION SELECT dst FROM parts)),
ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT src AS id FROM parts UNION SELECT dst FROM parts)),
e AS (SELECT least(a.code, b.code) AS src, greatest(a.code, b.code) AS dst FROM parts JOIN ids a ON a.id = src JOIN ids b ON b.id = dst),
k AS (SELECT CAST(range AS BIGINT) AS k FROM range(2000)),
c AS (SELECT k, CAST(floor({u("'neg-a'", 'k', "'9'")} * n) AS BIGINT) AS a, CAST(floor({u("'neg-b'", 'k', "'9'")} * n) AS BIGINT) AS b FROM k, n),
f AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(k) AS k FROM c WHERE a <> b GROUP BY 1, 2)
SELECT src, dst FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = f.src AND e.dst = f.dst) ORDER BY k LIMIT 1000""")
def _negatives(spark: SparkSession, d: str) -> DataFrame:
    edges, codes = graph.reindexed(fixtures.part_pairs(spark, d))
    return samplers.negative_edges(edges, codes.select(F.col("code").alias("id")), 1000, 9)


VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS grp FROM embeddings)"
PAIRS_Y = f"""pr AS (SELECT draw, CAST(floor({u("'pair-a'", 'draw', "'1'")} * n) AS BIGINT) AS a, CAST(floor({u("'pair-b'", 'draw', "'1'")} * n) AS BIGINT) AS b
  FROM (SELECT CAST(range AS BIGINT) AS draw FROM range(20000)), (SELECT count(*) AS n FROM v)),
py AS (SELECT draw, a, b, CAST(x.grp = y.grp AS INTEGER) AS y FROM pr JOIN v x ON x.id = a JOIN v y ON y.id = b)"""
query("community_pairs", f"WITH {VECTORS}, {PAIRS_Y} SELECT * FROM py")(lambda s, d: samplers.community_pairs(fixtures.vectors(s, d).select("id", "grp"), 20000, 1))
query("sampled_rows", f"WITH {EDGES} SELECT src, dst, w FROM edges ORDER BY {u(chr(39) + 'sample' + chr(39), 'src', 'dst', chr(39) + '4' + chr(39))}, src, dst LIMIT 100")(
    lambda s, d: samplers.sample_rows(fixtures.nation_edges(s, d), 100, "src", "dst", seed=4)
)


_NOISE = "nz AS (SELECT id, sum(w) OVER (ORDER BY id) - w AS lo, sum(w) OVER (ORDER BY id) AS hi, sum(w) OVER () AS tot FROM (SELECT dst AS id, sum(w) AS w FROM edges GROUP BY 1))"
TRIPLETS = _walk_sql(6, "c.dst").removesuffix(" SELECT walk_id, step, node FROM wk") + f""", wp AS (SELECT concat_ws(':', a.walk_id, a.step, b.step - a.step) AS draw, a.node AS center, b.node AS context FROM wk a JOIN wk b ON a.walk_id = b.walk_id AND b.step BETWEEN a.step - 2 AND a.step + 2 AND b.step <> a.step),
{_NOISE}, tr AS (SELECT draw, center, context, id AS noise FROM (SELECT *, {u("'noise-config'", 'draw', "'1'")} AS u FROM wp) x JOIN nz ON u * tot >= lo AND u * tot < hi)"""


def _walk_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges, _ = _nation(spark, d)
    return edges, walks.offset_windows(walks.walk(edges, _starts(spark, d), 6, 42), 2)


def _triplets(spark: SparkSession, d: str, joint: bool = False) -> DataFrame:
    edges, pairs = _walk_windows(spark, d)
    return samplers.triplets(pairs, edges, samplers.configuration_noise(1), joint)


query("triplets", f"{TRIPLETS} SELECT center, context, noise FROM tr")(lambda s, d: _triplets(s, d).select("center", "context", "noise"))
query("triplets_joint", f"""{TRIPLETS} SELECT center, context, noise_center, noise FROM tr JOIN (SELECT draw, id AS noise_center FROM (SELECT draw, {u("'joint-center'", 'draw', "'0'")} AS u FROM wp) x JOIN nz ON u * tot >= lo AND u * tot < hi) USING (draw)""")(
    lambda s, d: _triplets(s, d, True).select("center", "context", "noise_center", "noise")
)


@query("balanced_pairs", f"""WITH gr AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp FROM embeddings), cd AS (SELECT id, grp, row_number() OVER (ORDER BY grp, id) - 1 AS code, count(*) OVER (PARTITION BY grp) AS n, count(*) OVER () AS size FROM gr),
pl AS (SELECT *, min(code) OVER (PARTITION BY grp) AS first FROM cd), dr AS (SELECT CAST(range AS BIGINT) AS draw, y FROM range(5000), (VALUES (1), (0)) t(y)),
ow AS (SELECT draw, y, id AS a, n, first, size, floor({u("'balanced-b'", 'draw', 'y', "'2'")} * CASE WHEN y = 1 THEN n ELSE size - n END) AS r FROM dr JOIN pl ON code = CAST(floor({u("'balanced-a'", 'draw', 'y', "'2'")} * (SELECT count(*) FROM gr)) AS BIGINT)),
bb AS (SELECT draw, y, a, CAST(CASE WHEN y = 1 THEN first + r WHEN n = size THEN NULL WHEN r < first THEN r ELSE r + n END AS BIGINT) AS code FROM ow) SELECT draw, a, pl.id AS b, y FROM bb JOIN pl USING (code)""")
def _balanced(spark: SparkSession, d: str) -> DataFrame:
    return samplers.balanced_pairs(fixtures.vectors(spark, d).select("id", "grp"), 5000, 2)


@query("sampling_loss", f"""{TRIPLETS}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)
SELECT round(avg(ln(1 + exp(-list_sum(list_transform(generate_series(1, len(i.vec)), lambda k: i.vec[k] * o.vec[k])))) + ln(1 + exp(list_sum(list_transform(generate_series(1, len(i.vec)), lambda k: i.vec[k] * n.vec[k]))))), 6) + 0.0 AS loss
FROM tr JOIN v i ON i.id = center JOIN v o ON o.id = context JOIN v n ON n.id = noise""")
def _loss(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.vectors(spark, d).select("id", "vec")
    return models.sampling_loss(_triplets(spark, d), v, v).select(rounded(F.col("loss")).alias("loss"))


query("permuted_edges", f"WITH {EDGES} SELECT src, dst, {r6(u(chr(39) + 'permute' + chr(39), 'src', 'dst', chr(39) + '6' + chr(39)))} AS position FROM edges")(
    lambda s, d: samplers.permuted(fixtures.nation_edges(s, d), "src", "dst", seed=6).select("src", "dst", rounded(F.col("position")).alias("position"))
)
query("uniform_start", f"WITH {GROUPS}, k AS (SELECT CAST(range AS INTEGER) AS k FROM range(4)) SELECT id, k, {r6('(' + u(chr(39) + 'init' + chr(39), 'id', 'k', chr(39) + '0' + chr(39)) + ' - 0.5) / 4')} AS x FROM groups, k")(
    lambda s, d: models.uniform_start(fixtures.nation_groups(s, d), 4).select("id", F.posexplode("vec").alias("k", "x")).withColumn("x", rounded(F.col("x")))
)
query("without_zeros", f"WITH {EDGES} SELECT src, dst, greatest(w - 5, 0) AS w FROM edges WHERE w > 5")(lambda s, d: graph.without_zeros(fixtures.nation_edges(s, d).withColumn("w", F.greatest(F.col("w") - 5, F.lit(0.0)))))
query("group_sizes", f"WITH {GROUPS} SELECT grp, count(*) AS n FROM groups GROUP BY 1")(lambda s, d: fixtures.nation_groups(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
query("edges_of_some_nodes", f"WITH {EDGES} SELECT src, dst, w FROM edges WHERE src IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")(
    lambda s, d: fixtures.nation_edges(s, d).join(table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("src")), "src", "left_semi").select("src", "dst", "w")
)
query("first_rows", f"WITH {EDGES} SELECT src, dst, w FROM edges ORDER BY w DESC, src, dst LIMIT 50")(lambda s, d: first_rows(fixtures.nation_edges(s, d), 50, F.desc("w"), F.col("src"), F.col("dst")))


# ---------------------------------------------------------------- matrices and blocks

query("matrix_product", f"WITH {EDGES}, {TRANS} SELECT a.src, b.dst, {r6('sum(a.w * b.w)')} AS w FROM trans a JOIN trans b ON a.dst = b.src GROUP BY 1, 2")(
    lambda s, d: (lambda p: _w(linalg.matmul(p, p)))(graph.transition(_nation(s, d)[0]))
)
query("matrix_power_sum", f"WITH {EDGES}, {TRANS}, {_powers_sql('pw', 'trans', 3)} SELECT src, dst, {r6('w')} AS w FROM pw")(lambda s, d: _w(linalg.power_sum(graph.transition(_nation(s, d)[0]), 3)))


def _walk_weights(restart: float, steps: int) -> list[float]:
    raw = [(1 - restart) ** i for i in range(steps)]
    return [x / sum(raw) for x in raw]


def _weighted_sql(name: str, base: str, weights: list[float], first: int = 0) -> str:
    terms = " UNION ALL ".join(f"SELECT src, dst, w * CAST({w!r} AS DOUBLE) AS w FROM {name}p{i + 1}" for i, w in enumerate(weights) if i >= first)
    return f"{_powers_sql(name + 'p', base, len(weights))}, {name} AS (SELECT src, dst, sum(w) AS w FROM ({terms}) GROUP BY 1, 2)"


query("walk_sum_restart", f"WITH {EDGES}, {TRANS}, {_weighted_sql('ws', 'trans', _walk_weights(0.2, 4), 1)} SELECT src, dst, {r6('w')} AS w FROM ws")(
    lambda s, d: _w(linalg.walk_sum(graph.transition(_nation(s, d)[0]), 0.2, 4, 1))
)
query("lazy_product", f"WITH {EDGES}, {TRANS}, m AS (SELECT src, sum(w * CAST(dst AS DOUBLE)) AS w FROM trans GROUP BY 1) SELECT trans.src, CAST(0 AS BIGINT) AS dst, {r6('sum(trans.w * m.w)')} AS w FROM trans JOIN m ON m.src = trans.dst GROUP BY 1")(
    lambda s, d: (lambda p: _w(linalg.chain_sum([[p, p]], graph.nodes_of(p).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.col("id").cast("double").alias("w")))))(graph.transition(_nation(s, d)[0]))
)
query("block_matrix", f"WITH {EDGES}, {GROUPS}, {PSBM} SELECT src, dst, w FROM lam")(lambda s, d: blocks.block_matrix(*_nation(s, d)))
query("block_transition", f"WITH {EDGES}, {GROUPS}, {PSBM} SELECT src, dst, {r6('w')} AS w FROM psbm")(lambda s, d: _w(blocks.block_parameters(*_nation(s, d))[2]))
query("block_in_weight", f"WITH {EDGES}, {GROUPS}, {PSBM} SELECT dst AS grp, sum(w) AS din FROM lam GROUP BY 1")(lambda s, d: blocks.block_parameters(*_nation(s, d))[1])
query("pair_codes", f"WITH {GROUPS} SELECT id, dense_rank() OVER (ORDER BY grp, id % 3) - 1 AS code FROM groups")(
    lambda s, d: (lambda g: blocks.pair_codes(g, g.select("id", (F.col("id") % 3).alias("grp"))))(fixtures.nation_groups(s, d))
)


def _residual_sql(window: int) -> str:
    """The residual matrix by its definition: blocks are regions, null groups id % 2."""
    steps = _powers_sql("bs", "psbm", max(window - 1, 1))
    return f"""WITH {EDGES}, {GROUPS}, {TRANS}, {PSBM}, {INDEG}, nul AS (SELECT id, id % 2 AS grp FROM groups),
lam0 AS (SELECT a.grp AS src, b.grp AS dst, sum(w) AS w FROM edges JOIN nul a ON a.id = src JOIN nul b ON b.id = dst GROUP BY 1, 2),
psbm0 AS (SELECT src, dst, w / greatest(sum(w) OVER (PARTITION BY src), 1.0) AS w FROM lam0),
din AS (SELECT dst AS grp, sum(w) AS din FROM lam GROUP BY 1), din0 AS (SELECT dst AS grp, sum(w) AS din FROM lam0 GROUP BY 1),
{steps}, {_powers_sql('ns', 'psbm0', window)},
near AS (SELECT t.src, g.grp AS dst, sum(w) AS w FROM trans t JOIN groups g ON g.id = t.dst GROUP BY 1, 2),
nb AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM near a JOIN bs b ON a.dst = b.src GROUP BY 1, 2),
n AS (SELECT g.id, g.grp, nul.grp AS g0, coalesce(d, 0) AS d FROM groups g JOIN nul ON nul.id = g.id LEFT JOIN indeg ON indeg.id = g.id),
f AS (SELECT i.id AS src, j.id AS dst, p.w AS p, coalesce(nb.w, 0) AS b, din.din, j.d,
  CASE WHEN coalesce(nb.w, 0) <> 0 THEN ln(greatest(nb.w / greatest(din.din, 1e-32), 1e-12)) ELSE 0 END - coalesce(ln(greatest(ns.w / greatest(din0.din, 1e-32), 1e-12)), 0) AS h
  FROM n i CROSS JOIN n j LEFT JOIN nb ON nb.src = i.id AND nb.dst = j.grp LEFT JOIN din ON din.grp = j.grp
  LEFT JOIN ns ON ns.src = i.g0 AND ns.dst = j.g0 LEFT JOIN din0 ON din0.grp = j.g0 LEFT JOIN trans p ON p.src = i.id AND p.dst = j.id),
r AS (SELECT src, dst, greatest(0, h + CASE WHEN p IS NULL THEN 0 ELSE ln(greatest(p * din + b * d, 1e-12)) - ln(greatest(d, 1e-12)) - ln(greatest(b, 1e-12)) END) AS w FROM f)
SELECT src, dst, round(w, 5) + 0.0 AS w FROM r WHERE w > 0.00001"""


def _residual(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    m = blocks.residual_matrix(edges, groups, groups.select("id", (F.col("id") % 2).alias("grp")), 3)
    return m.where("w > 0.00001").select("src", "dst", rounded(F.col("w"), 5).alias("w"))


query("residual_matrix", _residual_sql(3))(_residual)


@query("residual_terms", _residual_sql(3))
def _residual_assembled(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    m = linalg.chain_sum(blocks.residual_terms(edges, groups, groups.select("id", (F.col("id") % 2).alias("grp")), 3))
    return m.where("w > 0.00001").select("src", "dst", rounded(F.col("w"), 5).alias("w"))


@query("residual_lookup", f"WITH m AS ({_residual_sql(3)}), {EDGES} SELECT edges.src, edges.dst, coalesce(m.w, 0) AS w FROM edges LEFT JOIN m ON m.src = edges.src AND m.dst = edges.dst")
def _residual_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the decomposed residual matrix at the edges."""
    edges, groups = _nation(spark, d)
    terms = blocks.residual_terms(edges, groups, groups.select("id", (F.col("id") % 2).alias("grp")), 3)
    found = linalg.looked_up(terms, edges.select("src", "dst"))
    return found.select("src", "dst", rounded(F.when(F.col("w") > 0.00001, F.col("w")).otherwise(0.0), 5).alias("w"))


# The same sums on the supplier-part graph, both ways, always as joins; a row is told by its size and moments.
_MOMENTS = "SELECT src, count(*) AS n, {total} AS total, {squares} AS squares FROM {of} GROUP BY 1"


def _told(moments: DataFrame, digits: int, fine: int) -> DataFrame:
    return moments.select("src", "n", rounded(F.col("total"), digits).alias("total"), rounded(F.col("squares"), fine).alias("squares"))


def _both_ways(spark: SparkSession, d: str) -> DataFrame:
    return keep(graph.symmetrised(fixtures.supplier_part_edges(spark, d)))


def _each_way(spark: SparkSession, d: str) -> DataFrame:
    """The same edges, not written; entries that meet are still to be added up."""
    edges = fixtures.supplier_part_edges(spark, d)
    return edges.unionByName(graph.swapped(edges))


query("matrix_power_sum_supplier_part", f"WITH {BOTH_WAYS}, {_powers_sql('pw', 'edges', 2)} {_MOMENTS.format(total='round(sum(w), 3) + 0.0', squares='round(sum(w * w), 3) + 0.0', of='pw')}")(
    lambda s, d: _told(linalg.power_sum_moments(_each_way(s, d), 2, 2 * table(s, d, "lineitem").count()), 3, 3)
)
query("walk_sum_supplier_part", f"WITH {BOTH_WAYS}, {TRANS}, {_weighted_sql('ws', 'trans', _walk_weights(0.2, 2))} {_MOMENTS.format(total=r6('sum(w)'), squares='round(sum(w * w), 9) + 0.0', of='ws')}")(
    lambda s, d: _told(linalg.walk_sum_moments(_each_way(s, d), 0.2, 2, True, 2 * table(s, d, "lineitem").count()), 6, 9)
)


@query("score_blocks", f"WITH {BIPARTITE} SELECT count(*) AS n_nodes, true AS all_once, true AS at_most_40 FROM (SELECT src AS id FROM bip UNION SELECT dst FROM bip)")
def _score_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SCORE blocks of the supplier-part graph, fewer than nodes: every node is in one of 40."""
    found = blocks.find_blocks(_both_ways(spark, d), 40)
    return found.agg(F.count(F.lit(1)).alias("n_nodes"), (F.count_distinct("id") == F.count(F.lit(1))).alias("all_once"), ((F.count_distinct("grp") <= 40) & (F.min("grp") >= 0)).alias("at_most_40"))


def _top_value_sql(source: str, rounds: int = 12) -> str:
    """The largest singular value: power iteration from ones, by parts and suppliers in turn."""
    ctes = [f"x0 AS MATERIALIZED (SELECT DISTINCT dst AS id, CAST(1 AS DOUBLE) AS x FROM {source})"]
    for t in range(1, rounds + 1):
        ctes.append(f"y{t} AS MATERIALIZED (SELECT src AS id, sum(w * x) AS x FROM {source} JOIN x{t - 1} ON id = dst GROUP BY 1)")
        ctes.append(f"z{t} AS MATERIALIZED (SELECT dst AS id, sum(w * x) AS x FROM {source} JOIN y{t} ON id = src GROUP BY 1)")
        ctes.append(f"x{t} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM z{t}) AS x FROM z{t})")
    last = f"SELECT sqrt((SELECT sum(x * x) FROM y{rounds})) AS s"
    return ", ".join([*ctes, f"top AS ({last})"])


@query("svd_supplier_part", f"WITH {BIPARTITE}, {_top_value_sql('bip')} SELECT round(s, 3) + 0.0 AS top, (SELECT count(DISTINCT src) FROM bip) AS n_left, (SELECT count(DISTINCT dst) FROM bip) AS n_right FROM top")
def _svd_large(spark: SparkSession, d: str) -> DataFrame:
    """The largest singular value of suppliers by parts, by a sketch so wide that its rows are summed as arrays."""
    left, s, right = linalg.svd(keep(fixtures.supplier_part_edges(spark, d)), 5, oversample=130, rounds=2)
    sides = left.agg(F.count(F.lit(1)).alias("n_left")).join(right.agg(F.count(F.lit(1)).alias("n_right")))  # one row each
    return sides.select(rounded(F.lit(float(s[0])), 3).alias("top"), "n_left", "n_right")


EXACT = f"{EDGES}, {GROUPS}, {TRANS}, {_weighted_sql('ex', 'trans', _walk_weights(0.0, 3))}"
query("log_transition_exact", f"WITH {EXACT} SELECT src, dst, {r6('ln(greatest(w, 1e-6))')} AS w FROM ex")(lambda s, d: _w(blocks.log_transition(_nation(s, d)[0], 3)))
BLOCKED = f"""{PSBM}, {INDEG}, {SHARE}, near AS (SELECT t.src, g.grp AS dst, sum(w) AS w FROM trans t JOIN groups g ON g.id = t.dst GROUP BY 1, 2),
{_weighted_sql('lt', 'psbm', _walk_weights(0.0, 3)[1:])}, nb AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM near a JOIN lt b ON a.dst = b.src GROUP BY 1, 2),
ap AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w * CAST({_walk_weights(0.0, 3)[0]!r} AS DOUBLE) AS w FROM trans UNION ALL SELECT nb.src, share.id, nb.w * share FROM nb JOIN share ON share.grp = nb.dst) GROUP BY 1, 2)"""
query("log_transition_blocks", f"WITH {EDGES}, {GROUPS}, {TRANS}, {BLOCKED} SELECT src, dst, {r6('ln(greatest(w, 1e-6))')} AS w FROM ap")(lambda s, d: _w(blocks.log_transition_blocks(*_nation(s, d), 3)))


@query("approximation_quality", f"WITH {EXACT}, {BLOCKED}, j AS (SELECT ln(greatest(ex.w, 1e-6)) AS a, ln(greatest(ap.w, 1e-6)) AS b FROM ex JOIN ap ON ex.src = ap.src AND ex.dst = ap.dst) SELECT count(*) AS n, {r6('corr(a, b)')} AS pearson FROM j WHERE abs(a) > 1e-8 AND abs(b) > 1e-8")
def _quality(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    q = blocks.approximation_quality(blocks.log_transition(edges, 3), blocks.log_transition_blocks(edges, groups, 3))
    return q.select("n", rounded(F.col("pearson")).alias("pearson"))


# ---------------------------------------------------------------- evaluation

DOT = "list_sum(list_transform(generate_series(1, len({a})), lambda i: {a}[i] * {b}[i]))"


def _dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


def _y_pairs(spark: SparkSession, d: str) -> DataFrame:
    return samplers.community_pairs(fixtures.vectors(spark, d).select("id", "grp"), 20000, 1).select("draw", F.col("a").alias("src"), F.col("b").alias("dst"), "y")


def _scored(spark: SparkSession, d: str, how: str = "dot") -> DataFrame:
    return evaluate.edge_scores(_y_pairs(spark, d), fixtures.vectors(spark, d).select("id", "vec"), how)


for _how, _expr in (("dot", _dot("x.vec", "z.vec")), ("cos", _cos("x.vec", "z.vec"))):
    query(f"edge_score_{_how}", f"WITH {VECTORS}, {PAIRS_Y} SELECT draw, a AS src, b AS dst, py.y, {r6(_expr)} AS score FROM py JOIN v x ON x.id = a JOIN v z ON z.id = b")(
        lambda s, d, how=_how: _scored(s, d, how).withColumn("score", rounded(F.col("score")))
    )

NEDGES = f"{EDGES}, {INDEG}, outdeg AS (SELECT src AS id, sum(w) AS o FROM edges GROUP BY 1), {VECTORS}"
_FAMILY = {
    "dot": _dot("x.vec", "z.vec"),
    "minus_dot": f"-({_dot('x.vec', 'z.vec')})",
    "residual": f"{_dot('x.vec', 'z.vec')} + ln(greatest(coalesce(i.d, 0), 1)) + ln(greatest(coalesce(o.o, 0), 1))",
    "glove": f"{_dot('x.vec', 'z.vec')} + CAST(src AS DOUBLE) / 10 + CAST(dst AS DOUBLE) / 20",
}
for _name, _expr in _FAMILY.items():

    def _modelled(spark: SparkSession, d: str, family: str = _name) -> DataFrame:
        edges, groups = _nation(spark, d)
        offsets = groups.select("id", (F.col("id") / 10.0).alias("a"), (F.col("id") / 20.0).alias("b"))
        scored = evaluate.modelled_scores(edges.select("src", "dst"), fixtures.vectors(spark, d), edges, family, offsets)
        return scored.select("src", "dst", rounded(F.col("score")).alias("score"))

    query(f"modelled_score_{_name}", f"WITH {NEDGES} SELECT src, dst, {r6(_expr)} AS score FROM edges JOIN v x ON x.id = src JOIN v z ON z.id = dst LEFT JOIN indeg i ON i.id = src LEFT JOIN outdeg o ON o.id = dst")(_modelled)


def _auc_sql(source: str, by: str = "") -> str:
    part, cols = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f"""rk AS (SELECT {cols}y, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {cols}score) - 1) / 2.0 AS r FROM {source})
SELECT {cols}{r6('(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0))')} AS auc FROM rk {'GROUP BY ' + by if by else ''}"""


SCORED = f"{VECTORS}, {PAIRS_Y}, sc AS (SELECT draw, py.y, {_dot('x.vec', 'z.vec')} AS score FROM py JOIN v x ON x.id = a JOIN v z ON z.id = b)"
COARSE = f"{SCORED}, co AS (SELECT y, round(score, 1) + 0.0 AS score FROM sc)"
query("auc", f"WITH {SCORED}, {_auc_sql('sc')}")(lambda s, d: evaluate.auc(_scored(s, d)).select(rounded(F.col("auc")).alias("auc")))
query("auc_with_ties", f"WITH {COARSE}, {_auc_sql('co')}")(lambda s, d: evaluate.auc(_scored(s, d).withColumn("score", rounded(F.col("score"), 1))).select(rounded(F.col("auc")).alias("auc")))
query("average_precision", f"""WITH {COARSE}, p AS (SELECT score, sum(y) AS p, count(*) AS n FROM co GROUP BY 1),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n FROM p) SELECT {r6('sum(p * tp / CAST(n AS DOUBLE)) / sum(p)')} AS average_precision FROM c""")(
    lambda s, d: evaluate.average_precision(_scored(s, d).withColumn("score", rounded(F.col("score"), 1))).select(rounded(F.col("average_precision")).alias("average_precision"))
)
query("community_auc", f"""WITH {VECTORS}, {PAIRS_Y}, m AS (SELECT 'cosine' AS metric, py.y, {_cos('x.vec', 'z.vec')} AS score FROM py JOIN v x ON x.id = a JOIN v z ON z.id = b
UNION ALL SELECT 'dot', py.y, {_dot('x.vec', 'z.vec')} FROM py JOIN v x ON x.id = a JOIN v z ON z.id = b), {_auc_sql('m', 'metric')}""")(
    lambda s, d: evaluate.community_auc(fixtures.vectors(s, d), 20000, 1).select("metric", rounded(F.col("auc"), 4).alias("auc"))
)
ORACLE_SQL["community_auc"] = ORACLE_SQL["community_auc"].replace(", 6) + 0.0 AS auc", ", 4) + 0.0 AS auc")

LABELS2 = "lab AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS y, CAST((vec_id * 7) % 6 AS BIGINT) AS z FROM embeddings)"


def _labels2(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.vectors(spark, d).select("id", F.col("grp").alias("y"), ((F.col("id") * 7) % 6).alias("z"))


query("contingency", f"WITH {LABELS2} SELECT y, z, count(*) AS n FROM lab GROUP BY 1, 2")(lambda s, d: evaluate.contingency(_labels2(s, d)))
query("nmi", f"""WITH {LABELS2}, c AS (SELECT y, z, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY 1, 2),
m AS (SELECT p, sum(p) OVER (PARTITION BY y) AS a, sum(p) OVER (PARTITION BY z) AS b FROM c) SELECT {r6('2 * sum(p * ln(p / (a * b))) / (-sum(p * ln(a)) - sum(p * ln(b)))')} AS nmi FROM m""")(
    lambda s, d: evaluate.nmi(_labels2(s, d)).select(rounded(F.col("nmi")).alias("nmi"))
)
query("element_similarity", f"""WITH {LABELS2}, c AS (SELECT y, z, count(*) AS n FROM lab GROUP BY 1, 2),
m AS (SELECT n, sum(n) OVER (PARTITION BY y) AS a, sum(n) OVER (PARTITION BY z) AS b FROM c) SELECT {r6('CAST(sum(n * n * least(1.0 / a, 1.0 / b)) AS DOUBLE) / sum(n)')} AS element_similarity FROM m""")(
    lambda s, d: evaluate.element_similarity(_labels2(s, d)).select(rounded(F.col("element_similarity")).alias("element_similarity"))
)
NEAR = f"""{VECTORS}, sim AS (SELECT a.id, b.id AS other, b.grp AS g2, {_dot('a.vec', 'b.vec')} AS score FROM v a JOIN v b ON a.id <> b.id),
nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INTEGER) AS rank FROM sim)"""
query("nearest_neighbours", f"WITH {NEAR} SELECT id, other, {r6('score')} AS score, rank FROM nn WHERE rank <= 10")(lambda s, d: evaluate.nearest(fixtures.vectors(s, d), 10).withColumn("score", rounded(F.col("score"))))
VOTE = f"{NEAR}, vt AS (SELECT id, g2, count(*) AS n FROM nn WHERE rank <= 10 GROUP BY 1, 2), win AS (SELECT id, g2 AS z FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, g2) AS r FROM vt) WHERE r = 1), kl AS (SELECT v.id, grp AS y, z FROM v JOIN win ON win.id = v.id)"
query("knn_vote", f"WITH {VOTE} SELECT * FROM kl")(lambda s, d: evaluate.knn_vote(fixtures.vectors(s, d)))
query("knn_macro_f1", f"""WITH {VOTE}, t AS (SELECT y AS c, count(*) AS ny, count(*) FILTER (y = z) AS tp FROM kl GROUP BY 1), p AS (SELECT z AS c, count(*) AS nz FROM kl GROUP BY 1)
SELECT {r6('avg(2.0 * coalesce(tp, 0) / (coalesce(ny, 0) + coalesce(nz, 0)))')} AS macro_f1 FROM t FULL JOIN p ON t.c = p.c""")(
    lambda s, d: evaluate.macro_f1(evaluate.knn_vote(fixtures.vectors(s, d))).select(rounded(F.col("macro_f1")).alias("macro_f1"))
)
TOP = f"WITH {VECTORS}, tp AS (SELECT a.id AS src, b.id AS dst, {_dot('a.vec', 'b.vec')} AS score FROM v a JOIN v b ON a.id < b.id ORDER BY score DESC, src, dst LIMIT 500)"
query("top_pairs", f"{TOP} SELECT src, dst, {r6('score')} AS score FROM tp")(lambda s, d: evaluate.top_pairs(fixtures.vectors(s, d), 500).withColumn("score", rounded(F.col("score"))))
query("reconstructed_graph", f"{TOP} SELECT src, dst, CAST(2 AS DOUBLE) AS w FROM tp UNION ALL SELECT dst, src, CAST(2 AS DOUBLE) FROM tp")(lambda s, d: evaluate.reconstructed(fixtures.vectors(s, d), 500))
PERSONA = f"""{VECTORS}, pers AS (SELECT id % 25 AS id, id AS persona FROM v), es AS (SELECT src, dst FROM edges)
SELECT src, dst, {{agg}} AS score FROM es JOIN pers a ON a.id = src JOIN pers b ON b.id = dst JOIN v x ON x.id = a.persona JOIN v z ON z.id = b.persona GROUP BY 1, 2"""
for _agg in ("max", "min", "avg"):

    def _persona(spark: SparkSession, d: str, agg: str = _agg) -> DataFrame:
        v = fixtures.vectors(spark, d)
        personas = v.select((F.col("id") % 25).alias("id"), F.col("id").alias("persona"))
        scored = evaluate.persona_scores(fixtures.nation_edges(spark, d).select("src", "dst"), personas, v, agg)
        return scored.select("src", "dst", rounded(F.col("score")).alias("score"))

    _sum = f"{_agg}({_dot('x.vec', 'z.vec')})"
    query(f"persona_score_{_agg}", f"WITH {EDGES}, {PERSONA.format(agg=r6(_sum))}")(_persona)

#: Names under which the whole-table forms were added first.
for _name in ("components", "largest_component", "connectivity", "nearest_neighbours", "knn_vote", "knn_macro_f1", "top_pairs", "reconstructed_graph", "persona_score_max", "persona_score_min", "persona_score_avg"):
    query(f"{_name}_all", ORACLE_SQL[_name])(QUERIES[_name])

query("noise_embedding", f"""WITH {NEAR}, {CENTERS}, op AS (SELECT id AS src, other AS dst, exp(score - max(score) OVER (PARTITION BY id)) AS w FROM nn WHERE rank <= 10),
oc AS (SELECT src, dst, sum(w) OVER r - w AS lo, sum(w) OVER r AS hi, sum(w) OVER (PARTITION BY src) AS tot FROM op WINDOW r AS (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING))
SELECT draw, center, dst AS context FROM (SELECT *, {u("'noise-embedding'", 'draw', "'3'")} AS u FROM centers) c JOIN oc ON oc.src = center AND u * tot >= lo AND u * tot < hi""")(
    lambda s, d: samplers.embedding_noise(fixtures.vectors(s, d), 10, 3)(fixtures.nation_edges(s, d), _centers(s))
)
query("score_quantiles", f"WITH {SCORED} SELECT {', '.join(r6(f'quantile_cont(score, {q})') + f' AS q{i}' for i, q in enumerate((0, 0.01, 0.999, 1)))} FROM sc")(
    lambda s, d: (lambda q: q.select(*(rounded(F.col(c)).alias(c) for c in q.columns)))(evaluate.quantiles(_scored(s, d), "score"))
)
def _weights_and_degrees(spark: SparkSession, d: str) -> DataFrame:
    edges = cut_lineage(fixtures.nation_edges(spark, d))
    return edges.join(graph.degrees(edges).select(F.col("id").alias("dst"), F.col("in_w").alias("d")), "dst")


query("hexagon_counts", f"""WITH {EDGES}, {INDEG}, p AS (SELECT w / 4 AS a, d / 50 / (4 * sqrt(3)) AS b FROM edges JOIN indeg ON id = dst),
c AS (SELECT a, b, floor(a + 0.5) AS i1, floor(b + 0.5) AS j1, floor(a) + 0.5 AS i2, floor(b) + 0.5 AS j2 FROM p),
h AS (SELECT CASE WHEN (a - i1) * (a - i1) + 3 * (b - j1) * (b - j1) <= (a - i2) * (a - i2) + 3 * (b - j2) * (b - j2) THEN i1 ELSE i2 END AS i,
  CASE WHEN (a - i1) * (a - i1) + 3 * (b - j1) * (b - j1) <= (a - i2) * (a - i2) + 3 * (b - j2) * (b - j2) THEN j1 ELSE j2 END AS j FROM c)
SELECT {r6('i * 4')} AS cx, {r6('j * 4 * sqrt(3) * 50')} AS cy, count(*) AS n FROM h GROUP BY 1, 2""")(
    lambda s, d: evaluate.hex_binned(_weights_and_degrees(s, d), "w", "d", 4.0, aspect=0.02).select(rounded(F.col("cx")).alias("cx"), rounded(F.col("cy")).alias("cy"), "n")
)
query("binned_counts", f"WITH {EDGES}, {INDEG}, x AS (SELECT CAST(floor(w / 4) AS BIGINT) AS bx, CAST(floor(d / 200) AS BIGINT) AS \"by\" FROM edges JOIN indeg ON id = dst) SELECT bx, \"by\", count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2")(
    lambda s, d: (lambda e: evaluate.binned(e.join(graph.degrees(e).toDF("dst", "o", "d"), "dst").select((F.col("w") / 4).alias("x"), (F.col("d") / 200).alias("y")), "x", "y", 1.0, 2))(fixtures.nation_edges(s, d))
)
query("score_summary", f"""WITH {SCORED}, hs AS (SELECT y, score, g, md5(concat_ws('|', 'bootstrap', draw, g, '0')) AS h FROM sc, (SELECT range AS g FROM range(25))),
us AS (SELECT y, g * 8 + k AS b, score, CAST('0x' || substr(h, CAST(4 * k + 1 AS BIGINT), 4) AS INTEGER) AS u FROM hs, (SELECT range AS k FROM range(8))),
ws AS (SELECT y, b, score, {' + '.join(f'CAST(u >= {x} AS INTEGER)' for x in evaluate.POISSON_STEPS)} AS w FROM us), ms AS (SELECT y, b, sum(score * w) / sum(w) AS m FROM ws GROUP BY 1, 2),
en AS (SELECT y, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM ms GROUP BY 1)
SELECT y, n, {r6('mean')} AS mean, {r6('sd')} AS sd, {r6('low')} AS low, {r6('high')} AS high FROM (SELECT y, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd FROM sc GROUP BY 1) JOIN en USING (y)""")(
    lambda s, d: evaluate.summary(_scored(s, d).select("draw", "y", "score"), "y", "score", key="draw").select("y", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "sd", "low", "high")))
)
query("mean_and_deviation", f"WITH {SCORED} SELECT y, count(*) AS n, {r6('avg(score)')} AS mean, {r6('stddev_samp(score)')} AS sd FROM sc GROUP BY 1")(
    lambda s, d: evaluate.summary(_scored(s, d).select("draw", "y", "score"), "y", "score", 2).select("y", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("sd")).alias("sd"))
)


# ---------------------------------------------------------------- splits and link prediction

_NATION_SPLIT = """und AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst),
k AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM und), step AS (SELECT src AS x, dst AS y, k FROM k UNION ALL SELECT dst, src, k FROM k),
reach(k, goal, id) AS (SELECT k, dst, src FROM k UNION SELECT r.k, r.goal, s.y FROM reach r JOIN step s ON s.x = r.id AND s.k < r.k),
tree AS (SELECT src, dst FROM k WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k = k.k AND r.id = r.goal)),
test AS (SELECT src, dst FROM und WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.src = und.src AND t.dst = und.dst)
  ORDER BY {draw}, src, dst LIMIT (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM und))""".format(draw=u("'split'", "src", "dst", "'1'"))


@query("held_out_edges", f"WITH RECURSIVE {EDGES}, {_NATION_SPLIT} SELECT src, dst FROM test")
def _held_out(spark: SparkSession, d: str) -> DataFrame:
    e = graph.without_loops(fixtures.nation_edges(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return splits.held_out_edges(e.withColumn("w", F.lit(1.0)), 0.5, 1)


_RANDOM_SPLIT = _NATION_SPLIT.replace("row_number() OVER (ORDER BY src, dst) AS k FROM und", "row_number() OVER (ORDER BY {}, src, dst) AS k FROM und".format(u("'tree'", "src", "dst", "'1'")))


@query("held_out_edges_random_tree", f"WITH RECURSIVE {EDGES}, {_RANDOM_SPLIT} SELECT src, dst FROM test")
def _held_out_random(spark: SparkSession, d: str) -> DataFrame:
    e = graph.without_loops(fixtures.nation_edges(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return splits.held_out_edges(e.withColumn("w", F.lit(1.0)), 0.5, 1, "random")


@query("link_auc_nation", f"""WITH {EDGES}, sy AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM edges WHERE src <> dst GROUP BY 1, 2),
te AS (SELECT src, dst, w, CASE WHEN {u("'hold'", 'src', 'dst', "'1'")} < 0.5 THEN 1 ELSE 0 END AS held FROM sy),
dg AS (SELECT id, sum(w) AS d FROM (SELECT src AS id, w FROM te WHERE held = 0 UNION ALL SELECT dst, w FROM te WHERE held = 0) GROUP BY 1),
med AS (SELECT median(w) AS m FROM te WHERE held = 1),
sc AS (SELECT CASE WHEN w > m THEN 1 ELSE 0 END AS y, ln(greatest(coalesce(a.d, 0), 1)) + ln(greatest(coalesce(b.d, 0), 1)) AS score FROM te CROSS JOIN med LEFT JOIN dg a ON a.id = src LEFT JOIN dg b ON b.id = dst WHERE held = 1),
sr AS (SELECT y, round(score, 9) AS score FROM sc), {_auc_sql('sr')}""")
def _link_auc(spark: SparkSession, d: str) -> DataFrame:
    """Half of the nation pairs are held out; the configuration model of the
    rest scores them; heavy pairs are the positives."""
    pairs = graph.summed(graph.without_loops(fixtures.nation_edges(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w"))
    held = cut_lineage(pairs.withColumn("held", scalar.u01("hold", F.col("src"), F.col("dst"), 1) < 0.5))
    train, test = held.where("not held"), held.where("held")
    ends = graph.degrees(train).select("id", (F.col("out_w") + F.col("in_w")).alias("d"))
    middle = test.agg(F.median("w").alias("m"))
    full = test.join(F.broadcast(middle)).join(ends.toDF("src", "da"), "src", "left").join(ends.toDF("dst", "db"), "dst", "left")
    score = scalar.safe_log(F.coalesce("da", F.lit(0.0)), 1.0) + scalar.safe_log(F.coalesce("db", F.lit(0.0)), 1.0)
    return evaluate.auc(full.select((F.col("w") > F.col("m")).cast("int").alias("y"), F.round(score, 9).alias("score"))).select(rounded(F.col("auc")).alias("auc"))


def _tree_sql(source: str, rounds: int = 16, jumps: int = 16) -> str:
    """CTE tree(src, dst): the spanning forest of source(src, dst) by (src, dst),
    in rounds of picking each component's first way out."""
    ctes = [f"e0 AS MATERIALIZED (SELECT src, dst, src AS a, dst AS b FROM {source})"]
    for r in range(rounds):
        ctes.append(f"p{r} AS MATERIALIZED (SELECT node, src, dst, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY src, dst) AS k FROM (SELECT a AS node, src, dst, b AS parent FROM e{r} UNION ALL SELECT b, src, dst, a FROM e{r})) WHERE k = 1)")
        ctes.append(f"j{r}_0 AS MATERIALIZED (SELECT x.node, CASE WHEN y.parent = x.node AND x.node < x.parent THEN x.node ELSE x.parent END AS parent FROM p{r} x JOIN p{r} y ON y.node = x.parent)")
        ctes += [f"j{r}_{k} AS MATERIALIZED (SELECT x.node, y.parent FROM j{r}_{k - 1} x JOIN j{r}_{k - 1} y ON y.node = x.parent)" for k in range(1, 5 if r > 4 else jumps // 2)]
        last = (5 if r > 4 else jumps // 2) - 1
        ctes.append(f"e{r + 1} AS MATERIALIZED (SELECT src, dst, x.parent AS a, y.parent AS b FROM e{r} JOIN j{r}_{last} x ON x.node = a JOIN j{r}_{last} y ON y.node = b WHERE x.parent <> y.parent)")
    return ", ".join([*ctes, "tree AS (" + " UNION ".join(f"SELECT src, dst FROM p{r}" for r in range(rounds)) + ")"])


@query("train_test_split", f"""WITH {COMPONENTS}, best AS (SELECT label FROM comp GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1),
pl AS MATERIALIZED (SELECT src, dst FROM parts JOIN comp ON id = src WHERE label = (SELECT label FROM best)), {_tree_sql('pl')}, wn AS (SELECT CAST(floor(count(*) * CAST(0.3 AS DOUBLE)) AS BIGINT) AS want FROM pl),
te AS (SELECT src, dst FROM pl WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.src = pl.src AND t.dst = pl.dst) ORDER BY {u("'split'", 'src', 'dst', "'1'")}, src, dst LIMIT (SELECT want FROM wn)),
ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT src AS id FROM pl UNION SELECT dst FROM pl)),
cd AS (SELECT k, CAST(floor({u("'neg-a'", 'k', "'1'")} * n) AS BIGINT) AS a, CAST(floor({u("'neg-b'", 'k', "'1'")} * n) AS BIGINT) AS b FROM (SELECT unnest(range(0, 20 * want + 1000)) AS k FROM wn), (SELECT count(*) AS n FROM ids)),
fr AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(k) AS k FROM cd WHERE a <> b GROUP BY 1, 2),
ne AS (SELECT x.id AS src, y.id AS dst FROM fr JOIN ids x ON x.code = a JOIN ids y ON y.code = b WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.src = x.id AND pl.dst = y.id) ORDER BY k LIMIT (SELECT want FROM wn))
SELECT src, dst, 1 AS edge_type FROM te UNION ALL SELECT src, dst, -1 FROM ne""")
def _split(spark: SparkSession, d: str) -> DataFrame:
    return splits.labelled(splits.split(graph.largest_component(keep(fixtures.part_pairs(spark, d))), 0.3, 1))


@query("held_out_by_search", f"""WITH {COMPONENTS} SELECT CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n_held, CAST(floor(count(*) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS n_edges,
(SELECT count(*) FROM comp) AS n_nodes, (SELECT count(DISTINCT label) FROM comp) AS n_components FROM parts""")
def _searched(spark: SparkSession, d: str) -> DataFrame:
    """Half of all co-purchases go, all of them edges; what is left has the nodes and components of the whole."""
    edges = keep(fixtures.part_pairs(spark, d).select("src", "dst"))
    held = keep(splits.held_out_edges_by_search(edges, 0.5, 2))
    kept = keep(edges.join(held, ["src", "dst"], "left_anti"))
    own = held.join(edges, ["src", "dst"], "left_semi").distinct().agg(F.count(F.lit(1)).alias("n_edges"))
    return held.agg(F.count(F.lit(1)).alias("n_held")).join(own).join(graph.connectivity(kept).select("n_nodes", "n_components"))


@query("result_columns_join", """WITH a AS (SELECT n_nationkey AS nation, n_regionkey AS region, n_name AS name FROM nation), b AS (SELECT r_regionkey AS region, r_name AS region_name FROM region)
SELECT a.region, nation, name, region_name FROM a JOIN b ON a.region = b.region""")
def _natural_join(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.plans.tables import natural_join

    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))
    return natural_join(a, table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name").alias("region_name")))


@query("label_map", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 3 THEN 'north' END AS side FROM nation")
def _label_map(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.plans.tables import mapped

    return table(spark, d, "nation").select("n_nationkey", mapped(F.col("n_regionkey"), {0: "south", 3: "north"}).alias("side"))


@query("file_parameters", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS dim, 'x' AS model FROM nation")
def _parameters(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.files import file_parameters

    path = F.concat(F.lit("/data/net=dblp_cite_model=x_dim="), F.col("n_nationkey").cast("string"), F.lit(".npz"))
    return table(spark, d, "nation").select("n_nationkey", file_parameters(path).alias("p")).select("n_nationkey", F.col("p")["dim"].alias("dim"), F.col("p")["model"].alias("model"))


@query("parameter_grid", "SELECT r_name AS model, d.d AS dim, n_nationkey AS network FROM region, (VALUES (8), (16)) d(d), nation")
def _grid(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.plans.tables import grid

    names = [r["r_name"] for r in table(spark, d, "region").select("r_name").collect()]  # 5 regions
    networks = [r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 nations
    return grid(spark, model=names, dim=[8, 16], network=networks)


# ---------------------------------------------------------------- spectral and trained models


@query("power_iteration", f"""WITH {EDGES}, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), und AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY 1, 2),
x0 AS (SELECT id, CAST(1 AS DOUBLE) AS x FROM ids), x1 AS (SELECT src AS id, sum(w * x) AS x FROM und JOIN x0 ON id = dst GROUP BY 1), n1 AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM x1) AS x FROM x1),
x2 AS (SELECT src AS id, sum(w * x) AS x FROM und JOIN n1 ON id = dst GROUP BY 1), n2 AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM x2) AS x FROM x2) SELECT id, {r6('x')} AS x FROM n2""")
def _power(spark: SparkSession, d: str) -> DataFrame:
    a = cut_lineage(graph.symmetrised(fixtures.nation_edges(spark, d)))
    x = graph.nodes_of(a).select("id", F.array(F.lit(1.0)).alias("vec"))
    for _ in range(2):
        x = linalg.times_thin(a, x, 1)
        length = float(linalg.gram(x, 1)[0, 0]) ** 0.5
        x = x.select("id", F.transform("vec", lambda v: v / length).alias("vec"))
    return x.select("id", rounded(F.col("vec")[0]).alias("x"))


@query("singular_values")
def _singular(spark: SparkSession, d: str) -> DataFrame:
    _, s, _ = linalg.svd(_nation(spark, d)[0], 5)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "rank int, value double")


query("netmf_matrix", f"""WITH {EDGES}, {TRANS}, {_weighted_sql('ws', 'trans', _walk_weights(0.0, 3))}, dg AS (SELECT src AS id, greatest(sum(w), 1) AS d FROM edges GROUP BY 1)
SELECT src, dst, round(x, 5) + 0.0 AS w FROM (SELECT src, dst, ln(greatest(w * (SELECT sum(w) FROM edges) / d, 1)) AS x FROM ws JOIN dg ON id = dst) WHERE x > 0.00001""")(
    lambda s, d: models.netmf_matrix(_nation(s, d)[0], 3).where("w > 0.00001").select("src", "dst", rounded(F.col("w"), 5).alias("w"))
)


@query("graph_convolution", f"""WITH {EDGES}, {VECTORS}, al AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM edges UNION ALL SELECT id, id, CAST(1 AS DOUBLE) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)) GROUP BY 1, 2),
dg AS (SELECT src AS id, sum(w) AS d FROM al GROUP BY 1), ks AS (SELECT range AS k FROM range(1, 65))
SELECT src AS id, k - 1 AS k, {r6('sum(w / sqrt(a.d) / sqrt(b.d) * vec[k])')} AS x FROM al JOIN dg a ON a.id = src JOIN dg b ON b.id = dst JOIN v ON v.id = dst, ks GROUP BY 1, 2""")
def _convolution(spark: SparkSession, d: str) -> DataFrame:
    out = models.propagate(_nation(spark, d)[0], fixtures.vectors(spark, d).select("id", "vec"), 64)
    return out.select("id", F.posexplode("vec").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), rounded(F.col("x")).alias("x"))


@query("principal_components")
def _pca(spark: SparkSession, d: str) -> DataFrame:
    return linalg.pca(fixtures.vectors(spark, d), 2)


@query("spherical_clusters")
def _kmeans(spark: SparkSession, d: str) -> DataFrame:
    return linalg.spherical_kmeans(fixtures.vectors(spark, d), 10)


def _model(name: str, **options: object) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges, groups = _nation(spark, d)
        return models.registry(groups)[name](edges, 8)

    return run


for _name in ("residual", "residual-groups", "leigenmap", "lndeg", "gcn", "gat", "graphsage", "deepwalk", "fairwalk", "glove", "residual-sgd", "residual-sgd-joint", "residual-sgd-groups"):
    query(f"embedding_{_name.replace('-', '_')}")(_model(_name))
query("embedding_netmf")(_model("netmf-spectral"))
query("embedding_node2vec")(_model("node2vec-pq"))


_BIAS_SQL = f"""WITH RECURSIVE {EDGES}, {GROUPS}, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id IN (SELECT id FROM groups)),
sv AS (SELECT x.id, sum(list_sum(list_transform(generate_series(1, len(x.vec)), lambda k: x.vec[k] * z.vec[k]))) AS s FROM v x, v z GROUP BY 1),
rc AS (SELECT id, coalesce((SELECT sum(w) FROM edges WHERE src = id), 0) - s AS r, coalesce((SELECT sum(w) FROM edges WHERE dst = id), 0) - s AS c FROM sv),
it(t, id, r, c, a, b, ma, va, mb, vb, done) AS (SELECT CAST(0 AS BIGINT), id, r, c, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), false FROM rc UNION ALL
  SELECT t + 1, id, r, c, CASE WHEN stop THEN a ELSE na END, CASE WHEN stop THEN b ELSE nb END, xa, ya, xb, yb, stop FROM (
    SELECT *, t % 20 = 0 AND avg(abs(na - a) + abs(nb - b)) OVER () / greatest(avg(abs(a) + abs(b)) OVER (), 2e-8) < 0.01 AS stop FROM (
      SELECT *, a + 0.001 / (sqrt(ya / (1 - pow(0.999, t + 1))) + 1e-8) * xa / (1 - pow(0.9, t + 1)) AS na, b + 0.001 / (sqrt(yb / (1 - pow(0.999, t + 1))) + 1e-8) * xb / (1 - pow(0.9, t + 1)) AS nb FROM (
        SELECT *, 0.9 * ma + (1 - 0.9) * ga AS xa, 0.999 * va + (1 - 0.999) * ga * ga AS ya, 0.9 * mb + (1 - 0.9) * gb AS xb, 0.999 * vb + (1 - 0.999) * gb * gb AS yb FROM (
          SELECT *, r - sum(b) OVER () * a AS ga, c - sum(a) OVER () * b AS gb FROM it WHERE NOT done AND t < 1000)))))
SELECT id, {r6('a')} AS a, {r6('b')} AS b FROM it WHERE t = (SELECT max(t) FROM it)"""


@query("glove_bias", _BIAS_SQL)
def _bias(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    v = fixtures.vectors(spark, d).select("id", "vec").join(groups.select("id"), "id", "left_semi")
    return models.bias_fit(edges, v).select("id", rounded(F.col("a")).alias("a"), rounded(F.col("b")).alias("b"))


@query("svd_invariants", f"""WITH {EDGES}, aa AS (SELECT a.dst AS i, b.dst AS j, sum(a.w * b.w) AS w FROM edges a JOIN edges b ON a.src = b.src GROUP BY 1, 2)
SELECT round((SELECT sum(w * w) FROM edges) / 1000) AS squares, round((SELECT sum(w * w) FROM aa) / 1e9) AS fourths""")
def _svd_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the second and fourth powers of all singular values, in thousands and 10**9."""
    _, s, _ = linalg.svd(_nation(spark, d)[0], 25)
    return spark.createDataFrame([(float(round((s**2).sum() / 1000)), float(round((s**4).sum() / 1e9)))], "squares double, fourths double")


def _products(pairs: DataFrame, factors: DataFrame, digits: int, first: int | None = None) -> DataFrame:
    """The product of a center's and a context's vectors for each pair (src, dst),
    rounded to ``first`` digits before, where the matrix itself is given so."""
    left, right = factors.select(F.col("id").alias("src"), "vec"), factors.select(F.col("id").alias("dst"), "out")
    product = scalar.dot(F.col("vec"), F.col("out"))
    product = product if first is None else rounded(product, first)
    return pairs.select("src", "dst").join(left, "src").join(right, "dst").select("src", "dst", rounded(product, digits).alias("w"))


@query("svd_product", f"WITH {EDGES} SELECT src, dst, round(w, 3) + 0.0 AS w FROM edges")
def _svd_back(spark: SparkSession, d: str) -> DataFrame:
    """U S V' of the whole decomposition gives the matrix back."""
    edges, _ = _nation(spark, d)
    return _products(edges, models.two_factors(*linalg.svd(edges, 25), 1.0), 3)


@query("residual_factors", f"WITH m AS ({_residual_sql(3)}) SELECT src, dst, round(w, 3) + 0.0 AS w FROM m WHERE w > 0.01")
def _residual_back(spark: SparkSession, d: str) -> DataFrame:
    """In-vectors times out-vectors of the factorised residual matrix give it back."""
    edges, groups = _nation(spark, d)
    null = groups.select("id", (F.col("id") % 2).alias("grp"))
    factors = models.two_factors(*linalg.svd(blocks.residual_terms(edges, groups, null, 3), 25), 0.5)
    stored = blocks.residual_matrix(edges, groups, null, 3).where(F.round("w", 5) > 0.01)
    return _products(stored, factors, 3, 5)


#: Nations by the orders they share: symmetric, without negative eigenvalues.
SHARED = f"{EDGES}, sq AS (SELECT a.src, b.src AS dst, sum(a.w * b.w) AS w FROM edges a JOIN edges b ON a.dst = b.dst GROUP BY 1, 2), dg AS (SELECT src AS id, sum(w) AS d FROM sq GROUP BY 1)"


def _shared(spark: SparkSession, d: str) -> DataFrame:
    edges = fixtures.nation_edges(spark, d)
    return cut_lineage(linalg.matmul(edges, linalg.transposed(edges)))


query("netmf_factors", f"""WITH {EDGES}, {TRANS}, {_weighted_sql('ws', 'trans', _walk_weights(0.0, 3))}, dg AS (SELECT src AS id, greatest(sum(w), 1) AS d FROM edges GROUP BY 1)
SELECT src, dst, round(x, 4) + 0.0 AS w FROM (SELECT src, dst, ln(greatest(w * (SELECT sum(w) FROM edges) / d, 1)) AS x FROM ws JOIN dg ON id = dst) WHERE round(x, 6) > 0.001""")(
    lambda s, d: _products(models.netmf_matrix(_nation(s, d)[0], 3).where(F.round("w", 6) > 0.001), models.netmf(3)(_nation(s, d)[0], 25), 4)
)
_SPECTRAL = f"""{SHARED}, nrm AS (SELECT src, dst, w / sqrt(a.d * b.d) AS w FROM sq JOIN dg a ON a.id = src JOIN dg b ON b.id = dst), {_powers_sql('np', 'nrm', 4)},
mm AS (SELECT src, dst, ln(greatest(w / 5 / sqrt(a.d * b.d) * (SELECT sum(w) FROM sq) / CAST(0.2 AS DOUBLE), 1)) AS w FROM np JOIN dg a ON a.id = src JOIN dg b ON b.id = dst)"""
query("netmf_spectral_matrix", f"WITH {_SPECTRAL} SELECT src, dst, round(w, 5) + 0.0 AS w FROM mm WHERE round(w, 6) > 0.001")(
    lambda s, d: models.netmf_spectral_matrix(_shared(s, d), 5, 25, 0.2).where(F.round("w", 6) > 0.001).select("src", "dst", rounded(F.col("w"), 5).alias("w"))
)


@query("netmf_spectral_factors", f"WITH {_SPECTRAL} SELECT src, dst, round(w, 3) + 0.0 AS w FROM mm WHERE round(w, 6) > 0.001")
def _spectral_back(spark: SparkSession, d: str) -> DataFrame:
    a = _shared(spark, d)
    return _products(models.netmf_spectral_matrix(a, 5, 25, 0.2).where(F.round("w", 6) > 0.001), models.netmf_spectral(5, 25, 0.2)(a, 25), 3)


@query("eigenmap_factors", f"WITH {SHARED} SELECT src, dst, round((w / sqrt(a.d * b.d) - sqrt(a.d * b.d) / (SELECT sum(w) FROM sq)) / sqrt(a.d) * 1000, 4) + 0.0 AS w FROM sq JOIN dg a ON a.id = src JOIN dg b ON b.id = dst")
def _eigenmap_back(spark: SparkSession, d: str) -> DataFrame:
    """Centers times what the normalised adjacency N makes of the contexts: D^-1/2 (N less its first part), in thousandths."""
    a = _shared(spark, d)
    factors = cut_lineage(models.laplacian_eigenmap()(a, 24))
    scaled = linalg.times_thin(graph.normalised_adjacency(a), factors.select("id", F.col("out").alias("vec")), 24).toDF("id", "out")
    return _products(a, factors.select("id", F.transform("vec", lambda x: x * 1000).alias("vec")).join(scaled, "id"), 4)


@query("pca_variance", """WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), x AS (SELECT k, vec[k] AS x FROM v, (SELECT range AS k FROM range(1, 65)))
SELECT round(sum(s), 4) + 0.0 AS variance FROM (SELECT k, var_samp(x) AS s FROM x GROUP BY 1)""")
def _pca_sum(spark: SparkSession, d: str) -> DataFrame:
    """The variance of all principal components together is that of the vectors."""
    points = linalg.pca(fixtures.vectors(spark, d), 64).select(F.posexplode("point").alias("k", "x"))
    return points.groupBy("k").agg(F.var_samp("x").alias("s")).agg(rounded(F.sum("s"), 4).alias("variance"))


@query("degree_offsets", f"WITH {EDGES} SELECT id, {r6('ln(greatest(sum(w), 1))')} AS offset FROM (SELECT src AS id, w FROM edges) GROUP BY 1")
def _offsets(spark: SparkSession, d: str) -> DataFrame:
    """The log-degree model: its vectors are zero and these offsets score."""
    edges, _ = _nation(spark, d)
    zero = models.log_degree()(edges, 8).where(F.forall("vec", lambda x: x == 0)).select("id")
    return graph.degrees(edges).join(zero, "id").where("out_w > 0").select("id", rounded(scalar.safe_log(F.col("out_w"), 1.0)).alias("offset"))


@query("streamed_pair_counts", f"WITH {PAIRS} SELECT * FROM pairs")
def _streamed(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.streaming.pairs import stream_pair_counts

    return stream_pair_counts(spark, fixtures.event_walks(spark, d, timed=True), 3)


# ---------------------------------------------------------------- files and experiments


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _pairs_back(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        place, edges = _place(spark, f"edges-{kind}"), fixtures.supplier_part_edges(spark, d).select("src", "dst")
        edges.write.option("sep", "\t" if kind == "tsv" else ",").option("compression", "gzip").csv(place)
        return (files.read_edge_tsv if kind == "tsv" else files.read_edge_csv)(spark, place)

    return run


for _kind in ("csv", "tsv"):
    query(f"edge_{_kind}_round_trip", f"WITH {BIPARTITE} SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM bip")(_pairs_back(_kind))


@query("matrix_round_trip", f"WITH {BIPARTITE} SELECT * FROM bip")
def _matrix_back(spark: SparkSession, d: str) -> DataFrame:
    places = [_place(spark, "matrix"), _place(spark, "matrix")]
    files.write_table(fixtures.supplier_part_edges(spark, d), places[0])
    files.write_table(files.read_table(spark, places[0]), places[1], "csv")
    return files.read_table(spark, places[1], "csv")


@query("embedding_round_trip", f"WITH {VECTORS} SELECT id, grp, k - 1 AS k, vec[k] AS x, 64 AS dim, 'given' AS model FROM v, (SELECT range AS k FROM range(1, 65))")
def _embedding_back(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "embedding")
    files.write_embedding(fixtures.vectors(spark, d), place, dim=64, model="given")
    vectors, said = files.read_embedding(spark, place)
    parts = vectors.select("id", "grp", F.posexplode("vec").alias("k", "x"))
    return parts.select("id", "grp", F.col("k").cast("long").alias("k"), "x", F.lit(said["dim"]).alias("dim"), F.lit(said["model"]).alias("model"))


@query("benchmark_network_round_trip", f"WITH {EDGES}, {GROUPS} SELECT src, dst, a.grp AS ga, b.grp AS gb, '0.3' AS mu FROM edges JOIN groups a ON a.id = src JOIN groups b ON b.id = dst")
def _network_back(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "network")
    files.write_one_based(fixtures.nation_edges(spark, d), fixtures.nation_groups(spark, d), place, mu=0.3, n=25)
    edges, groups = files.read_one_based(spark, f"{place}/network"), files.read_one_based(spark, f"{place}/community", "groups")
    said = files.read_parameters(spark, f"{place}/parameters").select(F.col("parameters")["mu"].alias("mu"))
    return edges.join(groups.toDF("src", "ga"), "src").join(groups.toDF("dst", "gb"), "dst").join(F.broadcast(said)).select("src", "dst", "ga", "gb", "mu")


@query("link_prediction_task", f"""WITH RECURSIVE {EDGES}, {VECTORS}, {_NATION_SPLIT}, ng AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id < b.id AND a.id < 25 AND b.id < 25 WHERE (a.id + b.id) % 3 = 0),
sc AS (SELECT 1 AS y, {_cos('x.vec', 'z.vec')} AS score FROM test JOIN v x ON x.id = src JOIN v z ON z.id = dst UNION ALL SELECT 0, {_cos('x.vec', 'z.vec')} FROM ng JOIN v x ON x.id = src JOIN v z ON z.id = dst), {_auc_sql('sc')}""")
def _task(spark: SparkSession, d: str) -> DataFrame:
    """Held-out nation pairs, written and read back, against every third pair, by cosine of given vectors."""
    edges = graph.without_loops(fixtures.nation_edges(spark, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    ids = fixtures.nation_groups(spark, d).select("id")
    other = ids.toDF("src").join(ids.toDF("dst"), F.col("src") < F.col("dst")).where("(src + dst) % 3 = 0")  # 25 nations
    place = _place(spark, "split")
    files.write_split(splits.Split(edges, splits.held_out_edges(edges, 0.5, 1), other), place)
    found = experiments.link_prediction(files.read_split(spark, place), fixtures.vectors(spark, d), "cos")
    return found.select(rounded(F.col("auc")).alias("auc"))


_FAMILY_SCORE = f"""WITH RECURSIVE {EDGES}, {VECTORS}, {_NATION_SPLIT}, ng AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id < b.id AND a.id < 25 AND b.id < 25 WHERE (a.id + b.id) % 3 = 0),
deg AS (SELECT id, ln(greatest(sum(o), 1)) AS o, ln(greatest(sum(i), 1)) AS i FROM (SELECT src AS id, w AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, w FROM edges) GROUP BY 1),
pr AS (SELECT 1 AS y, src, dst FROM test UNION ALL SELECT 0, src, dst FROM ng),
pl AS (SELECT y, {_dot('x.vec', 'z.vec')} AS score, a.i + b.o AS more FROM pr JOIN v x ON x.id = src JOIN v z ON z.id = dst JOIN deg a ON a.id = src JOIN deg b ON b.id = dst),
sc AS (SELECT m AS model, y, CASE WHEN m = 'residual' THEN score + more ELSE score END AS score FROM pl, (VALUES ('deepwalk'), ('residual'), ('residual-dotsim')) t(m)), {_auc_sql('sc', 'model')}"""


@query("link_prediction_by_model", _FAMILY_SCORE)
def _by_model(spark: SparkSession, d: str) -> DataFrame:
    """Given vectors scored as those of a plain and of a residual model, the latter with and without its offsets."""
    given = cut_lineage(fixtures.nation_edges(spark, d))
    plain = graph.without_loops(given).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    ids = fixtures.nation_groups(spark, d).select("id")
    other = ids.toDF("src").join(ids.toDF("dst"), F.col("src") < F.col("dst")).where("(src + dst) % 3 = 0")  # 25 nations
    v = fixtures.vectors(spark, d).select("id", "vec")
    found = experiments.link_prediction_by_model(splits.Split(plain, splits.held_out_edges(plain, 0.5, 1), other), {"deepwalk": v, "residual": v}, given)
    return found.select("model", rounded(F.col("auc")).alias("auc"))


@query("rules_of_link_prediction", ORACLE_SQL["link_prediction_task"])
def _ruled(spark: SparkSession, d: str) -> DataFrame:
    """The same task as files made by rules: graph, split, vectors, score."""
    from graphloom.plans.rules import Rule, run

    place = _place(spark, "rules")
    at = {name: f"{place}/{name}" for name in ("graph", "train", "test", "negative", "vectors", "auc")}
    save = lambda df, path: df.write.mode("overwrite").parquet(path)
    load = lambda s, path: s.read.parquet(path)

    def graph_of(s: SparkSession, _: list[str], out: list[str]) -> None:
        plain = graph.without_loops(fixtures.nation_edges(s, d)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        save(plain.withColumn("w", F.lit(1.0)), out[0])

    def split_of(s: SparkSession, given: list[str], out: list[str]) -> None:
        edges, ids = load(s, given[0]), fixtures.nation_groups(s, d).select("id")
        test = cut_lineage(splits.held_out_edges(edges, 0.5, 1))
        other = ids.toDF("src").join(ids.toDF("dst"), F.col("src") < F.col("dst")).where("(src + dst) % 3 = 0")  # 25 nations
        for df, path in zip((edges.join(test, ["src", "dst"], "left_anti"), test, other), out):
            save(df, path)

    def score_of(s: SparkSession, given: list[str], out: list[str]) -> None:
        train, test, negative, vectors = (load(s, path) for path in given)
        save(experiments.link_prediction(splits.Split(train, test, negative), vectors, "cos"), out[0])

    parts = (at["train"], at["test"], at["negative"])
    rules = [
        Rule("score", (*parts, at["vectors"]), (at["auc"],), score_of),
        Rule("split", (at["graph"],), parts, split_of),
        Rule("graph", (f"{d}/lineitem.parquet", f"{d}/nation.parquet"), (at["graph"],), graph_of),
        Rule("vectors", (f"{d}/embeddings.parquet",), (at["vectors"],), lambda s, _, out: save(fixtures.vectors(s, d), out[0])),
    ]
    if sorted(run(spark, rules)) != ["graph", "score", "split", "vectors"] or run(spark, rules):
        raise AssertionError("rules run once, and not again while nothing has changed")
    return load(spark, at["auc"]).select(rounded(F.col("auc")).alias("auc"))


@query("community_precision", f"""WITH {VECTORS}, sc AS (SELECT CAST(a.grp = b.grp AS INTEGER) AS y, {_dot('a.vec', 'b.vec')} AS score FROM v a CROSS JOIN v b), p AS (SELECT score, sum(y) AS p, count(*) AS n FROM sc GROUP BY 1),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n FROM p) SELECT {r6('sum(p * tp / CAST(n AS DOUBLE)) / sum(p)')} AS average_precision FROM c""")
def _precision(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.vectors(spark, d)
    return experiments.community_precision(v, v.select("id", "grp")).select(rounded(F.col("average_precision")).alias("average_precision"))


@query("community_benchmark")
def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    named = models.registry(groups)
    return experiments.community_benchmark([({"graph": "nation"}, edges, groups)], {"leigenmap": named["leigenmap"]}, 8)


@query("out_vectors", f"""WITH {EDGES}, {VECTORS}, x AS (SELECT src AS id, k, sum(w * vec[k]) AS x FROM edges JOIN v ON v.id = dst, (SELECT range AS k FROM range(1, 65)) GROUP BY 1, 2)
SELECT id, k - 1 AS k, round(vec[k], 6) + 0.0 AS vec, {r6('x')} AS out FROM x JOIN v USING (id)""")
def _out(spark: SparkSession, d: str) -> DataFrame:
    """A model of one's own: given vectors on one side, sums over out-edges on the other."""
    v, edges = fixtures.vectors(spark, d), _nation(spark, d)[0]
    fitted = experiments.Fitted(lambda e, dim: v.select("id", "vec").join(linalg.times_thin(e, v.select("id", "vec"), dim).toDF("id", "out"), "id"), edges)
    both = fitted.transform(64).join(fitted.transform(64, out=True).toDF("id", "out"), "id")
    return both.select("id", F.posexplode(F.arrays_zip("vec", "out")).alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), rounded(F.col("x.vec")).alias("vec"), rounded(F.col("x.out")).alias("out"))


@query("reconstruction_against_null")
def _against_null(spark: SparkSession, d: str) -> DataFrame:
    edges, groups = _nation(spark, d)
    return experiments.reconstruction_against_null(graph.without_loops(edges), groups, models.laplacian_eigenmap(), 8, 50)
