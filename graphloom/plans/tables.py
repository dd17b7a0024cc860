"""Relational steps of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns both tables have; ``ValueError`` if there is none."""
    common = sorted(set(a.columns) & set(b.columns))
    if not common:
        raise ValueError("the tables share no column")
    return a.join(b, common, how)


def mapped(value: Column, labels: dict) -> Column:
    """Dictionary look-up; what is not in it becomes null."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the parameter values, one column an axis."""
    lists = [spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name)) for name, values in axes.items()]
    return reduce(lambda x, y: x.join(F.broadcast(y), F.lit(True)), lists)
