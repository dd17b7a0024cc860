"""Graphs, walks and pairs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.session import table


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer nation -> supplier nation, weighted by line items."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    # line items shrink to (customer, supplier) counts before the small lookups
    counted = lines.join(orders, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(buyers, "o_custkey").join(sellers, "l_suppkey").groupBy("src", "dst").agg(F.sum("n").cast("double").alias("w"))


def nation_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("grp"))


def supplier_part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier -> part; parts are numbered after a million."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


#: Line items of a part of the orders, and of a part of the pairs: an order makes a few times as many pairs.
PART_ROWS = 250_000


def part_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts in one order, src < dst, weighted by orders; an order has few lines.

    Orders and pairs are dealt to parts whose number follows the line items,
    so that the memory of a task does not grow with them.
    """
    lines = table(spark, d, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // PART_ROWS))
    baskets = lines.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").distinct()
    other = baskets.toDF("l_orderkey", "dst")
    pairs = baskets.withColumnRenamed("l_partkey", "src").join(other, "l_orderkey").where("src < dst")
    return pairs.select("src", "dst").repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def event_walks(spark: SparkSession, d: str, timed: bool = False) -> DataFrame:
    """(walk_id, step, node[, ts]): each user's event types in order of time."""
    events = table(spark, d, "events")
    codes = events.select("event_type").distinct().withColumn("node", F.row_number().over(Window.orderBy("event_type")).cast("long") - 1)
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return events.join(F.broadcast(codes), "event_type").select(F.col("user_id").alias("walk_id"), step.alias("step"), "node", *(["ts"] if timed else []))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vec array<double>, grp)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("grp"))
