"""Context pair counts over a stream of walk steps that come late.

Two copies of the stream are joined: a step meets the steps up to ``size``
before it in its walk, whichever of the two came first.  The join's state
holds open steps until the watermark passes them, and a streaming aggregate
counts the pairs by window of event time.  Nothing leaves the JVM.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage, shared_folder

WINDOW = "1 hour"


def closed_pairs(steps: DataFrame, size: int, late: str, apart: str) -> DataFrame:
    """Streaming ``(walk_id, step, node, ts)`` -> (center, context, at): every
    node with each of the up to ``size`` nodes after it in its walk.

    Steps come up to ``late`` behind the newest one, in any order, and later
    ones are lost; two steps of a pair are at most ``apart`` in event time,
    which bounds the state.  A walk is cut into stretches of ``size`` steps,
    so that a long one is many keys.
    """
    marked = steps.withWatermark("ts", late)
    stretch = F.floor(F.col("step") / size)
    first = marked.select(F.col("walk_id").alias("wa"), stretch.alias("ka"), F.col("step").alias("sa"), F.col("node").alias("center"), F.col("ts").alias("at"))
    again = steps.withWatermark("ts", late)
    second = again.select(F.col("walk_id").alias("wb"), F.explode(F.array(stretch - 1, stretch)).alias("kb"), F.col("step").alias("sb"), F.col("node").alias("context"), F.col("ts").alias("then"))
    follows = (F.col("wa") == F.col("wb")) & (F.col("ka") == F.col("kb")) & (F.col("sb") > F.col("sa")) & (F.col("sb") <= F.col("sa") + size)
    close = (F.col("then") >= F.col("at") - F.expr(f"INTERVAL {apart}")) & (F.col("then") <= F.col("at") + F.expr(f"INTERVAL {apart}"))
    return first.join(second, follows & close).select("center", "context", "at")


def counted_pairs(pairs: DataFrame) -> DataFrame:
    """Streaming (center, context, at) -> (start, center, context, freq) for every window that the watermark has passed."""
    window = F.window("at", WINDOW)
    return pairs.groupBy(window.alias("window"), "center", "context").agg(F.count(F.lit(1)).alias("freq")).select(F.col("window.start").alias("start"), "center", "context", "freq")


def stream_pair_counts(spark: SparkSession, steps: DataFrame, size: int, batches: int = 4, late: str = "400 days", apart: str = "400 days", name: str = "pair_counts_stream") -> DataFrame:
    """(center, context, freq) of ``steps(walk_id, step, node, ts)`` through a stream of files.

    Steps are written as ``batches`` files, dealt by hash, so that a walk's
    steps come out of order; last files, whose step follows no other, move
    the watermark past all of them, so that every window is given out.
    Windows are added up at the end.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    dealt = cut_lineage(steps.select("walk_id", "step", "node", F.col("ts").cast("timestamp").alias("ts")))
    for k in range(batches):
        dealt.where(F.pmod(F.xxhash64("walk_id", "step"), F.lit(batches)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    last = dealt.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("walk_id"), F.lit(-10 - 10 * size).cast("long").alias("step"), F.lit(-1).cast("long").alias("node"), (F.col("ts") + F.expr(f"INTERVAL {late}") + F.expr(f"INTERVAL {apart}") + F.expr("INTERVAL 2 days")).alias("ts"))
    for _ in range(2):  # the first one moves the watermark, the second one's batch gives out what it has passed
        last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    read = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counts = counted_pairs(closed_pairs(read, size, late, apart))
    sink = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    sink.awaitTermination()
    found = spark.read.schema(counts.schema).parquet(f"{folder}/out")
    return cut_lineage(found.groupBy("center", "context").agg(F.sum("freq").alias("freq")))
