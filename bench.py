"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  Every query is
run once to warm up and then three times; the median counts.  With ``--duckdb``
the same is printed for the oracle SQL on DuckDB.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = [
    "edges_nation",
    "edges_supplier_part",
    "edges_part_copurchase",
    "reindex_nodes",
    "symmetrize",
    "degree_in_out",
    "transition_matrix",
    "line_graph_pq",
    "fairwalk_degree_classes",
    "pair_counts",
    "event_windows_double",
    "walk_first_order",
    "noise_config",
    "negative_edges",
    "matrix_power_sum",
    "residual_matrix",
    "log_transition_blocks",
    "edge_score_dot",
    "auc",
    "average_precision",
    "nearest_neighbours",
    "top_pairs",
    "components",
    "spanning_tree",
    "link_auc_nation",
]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def medians(run: dict) -> dict[str, float]:
    took: dict[str, float] = {}
    for name, once in run.items():
        runs = []
        for _ in range(4):
            began = time.time()
            once()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    return took


def report(took: dict[str, float], folder: str) -> None:
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


def on_duckdb(folder: str, cpus: str) -> None:
    import duckdb

    from graphloom.plans.catalog import ORACLE_SQL

    con = duckdb.connect(config={"threads": int(cpus)})
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    report(medians({name: (lambda sql=ORACLE_SQL[name]: con.sql(sql).fetchall()) for name in HEADLINE}), folder)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    if "--duckdb" in sys.argv:
        on_duckdb(folder, cpus)
        return
    from pyspark.sql import SparkSession

    from graphloom.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    report(medians({name: (lambda name=name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()) for name in HEADLINE}), folder)
    spark.stop()


if __name__ == "__main__":
    main()
