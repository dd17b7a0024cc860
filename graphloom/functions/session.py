"""Session helpers: lineage cuts and table access."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A temporary one is made only where none is set and everything runs on
    this machine; elsewhere ``ValueError``, for executors could not see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    return named


#: Seconds between two requests to collect the driver's garbage.
COLLECT_EVERY = 3.0
_collected = [0.0]


def give_back(spark: SparkSession) -> None:
    """Have the files of tables that nothing refers to any more deleted.

    Shuffle files, and checkpoints where the session is set to clean them, go
    when the driver's heap is collected.  A heap with room may not be for
    long, while rounds of a loop leave their files behind.
    """
    if time.monotonic() - _collected[0] >= COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the copy."""
    context = df.sparkSession.sparkContext
    give_back(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, column by column and compressed:
    a few bytes a number, where ``cut_lineage`` writes whole rows.  For tables
    of the size of the edges; ``drop`` deletes what is not needed any more."""
    spark = df.sparkSession
    give_back(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._kept = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kept)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key.

    Keys with a task's share of the rows or more, four a shuffle partition at
    most, are counted by partial sums and joined by broadcast, so that no key
    fills a task.  ``rows`` are read twice: give a table that is cheap to read.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (rows.count() - 1) // (4 * parts))
    heavy = cut_lineage(counts.where(F.col("_n") > share).select(key).join(keyed, key))
    if not heavy.take(1):
        return rows.join(keyed, key)
    hot = F.broadcast(heavy)
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed, key)
    return rows.join(hot, key).unionByName(rest)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
