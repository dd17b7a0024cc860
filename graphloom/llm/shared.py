"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage, shared_folder, table

__all__ = ["cut_lineage", "join_classes", "shared_folder", "spare", "table"]


def spare(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """Rows joined with ``classes``, one row a key, whose column ``size`` (dropped)
    tells how many rows have the key; ``rows`` has no other rows.

    Keys with about a task's share of the rows or more are at most eight a
    shuffle partition.  They are broadcast, so that no key fills a task.
    """
    spark = rows.sparkSession
    classes = cut_lineage(classes)
    total = classes.agg(F.sum(size)).first()[0] or 0
    share = max(1, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    big = F.broadcast(classes.where(F.col(size) > share).drop(size))
    small = classes.where(F.col(size) <= share).drop(size)
    rest = rows.join(big.select(*keys), keys, "left_anti").join(small, keys)
    return rows.join(big, keys).unionByName(rest)
