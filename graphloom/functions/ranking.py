"""Global ranks and running sums without a single-task sort.

Rows are range-partitioned by the order asked for; only one total a
partition meets in one place, and every partition adds its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.session import cut_lineage

#: Up to this many rows a limit keeps its candidates in the driver's heap.
SMALL_LIMIT = 100_000
#: Stretches by which ``among_first`` counts.
STRETCHES = 4096


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a column for each of ``sums`` (new name -> summed column): the sum
    over all rows up to and with this one, within ``by``, in ``order``."""
    placed = cut_lineage(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_t_{name}") for name, c in sums.items()))
    ahead = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(*by, "_p", *(F.coalesce(F.sum(f"_t_{name}").over(ahead), F.lit(0)).alias(f"_o_{name}") for name in sums))
    local = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(offsets if by else F.broadcast(offsets), [*by, "_p"])
    return joined.select(*df.columns, *((F.col(f"_o_{name}") + F.sum(c).over(local)).alias(name) for name, c in sums.items()))


def among_first(df: DataFrame, n: int, value: str, *ties: str) -> Column:
    """What is true of the first ``n`` rows in the order of the columns
    ``value``, a number, and ``ties``, which tell all rows apart, none null.

    Rows are counted by stretches of ``value``; only those of the stretch in
    which the ``n``-th lies are ranked, and no row is written.  ``df`` is read
    three times: give a table that is cheap to read.
    """
    if n <= 0:
        return F.lit(False)
    total, low, high = df.agg(F.count(F.lit(1)), F.min(value).cast("double"), F.max(value).cast("double")).first()
    if total <= n:
        return F.lit(True)
    step = (high - low) / STRETCHES
    place = F.least(F.floor((F.col(value).cast("double") - low) / step), F.lit(STRETCHES - 1)).cast("long") if step else F.lit(0).cast("long")
    before, at = 0, 0
    for at, count in sorted(tuple(r) for r in df.groupBy(place).count().collect()):
        if before + count >= n:
            break
        before += count
    names = (value, *ties)
    last = first_rows(df.where(place == at).select(*names), n - before, *map(F.col, names)).agg(F.max(F.struct(*names)).alias("x")).first().x
    out = F.lit(True)
    for name in reversed(names):
        out = (F.col(name) < last[name]) | ((F.col(name) == last[name]) & out)
    return out


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in ``order``, which should not have ties.

    A small ``n`` is a bounded top-k; beyond, rows are ranked by partition
    offsets, so that no task and no driver holds ``n`` rows.
    """
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    ranked = running_sums(df.withColumn("_one", F.lit(1).cast("long")), list(order), {"_rank": "_one"})
    return ranked.where(F.col("_rank") <= n).select(*df.columns)
