"""Connected components of a link table, without collecting it anywhere.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each
round is a minimum per node with map-side combining and a join back.  A hub
of any degree is aggregated before the shuffle, and hubs, of which there are
few, are joined back by broadcast.  Lineage is cut after every star by a
checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import cut_lineage


def _hook(pairs: DataFrame, share: int) -> DataFrame:
    """(node, other) -> the smallest of a node and its others, joined back.

    Nodes with more than ``share`` others are few; they are broadcast."""
    lowest = pairs.groupBy("node").agg(F.min("other").alias("low"), F.count(F.lit(1)).alias("n"))
    lowest = lowest.select("node", F.least("node", "low").alias("low"), "n")
    hubs = F.broadcast(lowest.where(F.col("n") > share).drop("n"))
    rest = pairs.join(hubs.select("node"), "node", "left_anti").join(lowest.where(F.col("n") <= share).drop("n"), "node")
    return pairs.join(hubs, "node").unionByName(rest)


def _large_star(links: DataFrame, share: int) -> DataFrame:
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    return _hook(both, share).where("other > node").select(F.col("other").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame, share: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    hooked = _hook(down, share)
    return (
        hooked.select(F.col("other").alias("a"), F.col("low").alias("b"))
        .unionByName(hooked.select(F.col("node").alias("a"), F.col("low").alias("b")))
        .where("a <> b")
        .distinct()
    )


def _digest(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)),
        F.sum(F.hash("a", "b").cast("long")),
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, root)`` for every linked node.

    ``root`` is the smallest node id reachable.  Self links, repeated
    links and nulls are ignored; no links give an empty table.
    """
    links = cut_lineage(links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    before = _digest(links)
    while before[0]:
        share = max(1, before[0] // (4 * int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # so 8 hubs a partition at most
        large = cut_lineage(_large_star(links, share))
        links = cut_lineage(_small_star(large, share))
        after = _digest(links)
        if after == before:
            break
        before = after
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
