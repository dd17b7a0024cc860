"""Exact top-k inner products by columnar branch-and-bound (BOND).

Candidates stand in vertical layout, one array a dimension.  A query adds
its products block of dimensions by block, heaviest dimensions first.  What
a candidate can still gain is bounded by the remaining mass of both sides
(Cauchy-Schwarz); candidates whose bound stays below the k-th best score
known so far are dropped and the survivors compacted.

Queries and candidates meet in blocks: candidates are dealt to parts,
queries to groups of bounded size, and each (part, group) is one task's
unit of work with at most ``k`` results a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 4096
GROUP_QUERIES = 8192
STEP = 8


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def best(columns: np.ndarray, ids: np.ndarray, mass: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best candidates; ``columns`` is dims x rows."""
    alive = np.flatnonzero(ids != own)
    order = np.argsort(-np.abs(query), kind="stable")
    q = query[order]
    rest_q = np.concatenate([np.cumsum((q.astype(float) ** 2)[::-1])[::-1], [0.0]])
    score, rest = np.zeros(len(alive), np.int64), mass[alive].copy()
    floor = None
    for a in range(0, len(q), STEP):
        dims = order[a : a + STEP]
        if not q[a]:
            break
        block = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
        score += q[a : a + STEP] @ block
        if len(alive) <= 4 * k or a + STEP >= len(q):
            rest -= (block.astype(float) ** 2).sum(axis=0)
            continue
        rest -= (block.astype(float) ** 2).sum(axis=0)
        lead = np.argpartition(-score, k)[: 2 * k]
        exact = query @ columns[:, alive[lead]]
        known = int(np.partition(exact, len(exact) - k)[len(exact) - k])
        floor = known if floor is None else max(floor, known)
        reach = np.sqrt(np.maximum(rest, 0.0) * rest_q[min(a + STEP, len(q))])
        keep = score + reach * (1 + 1e-9) + 1 >= floor
        if not keep.all():
            alive, score, rest = alive[keep], score[keep], rest[keep]
    top = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[top]], score[top]


def _matrix(vectors: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """Rows of a list column; short vectors are padded with zeros."""
    flat = vectors.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    sizes = np.diff(np.asarray(flat.offsets))
    values = np.asarray(flat.flatten())
    width = max(int(sizes.max(initial=0)), dims or 0)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores.

    Queries are the rows where ``is_query`` holds; candidates are all rows
    with another id.  Ties go to the smaller id.  Rows with a null id or an
    unusable vector take no part; a missing component of a shorter vector
    counts as zero.  A query id that repeats is one query (its smallest
    vector); repeated candidates are candidates each.
    """
    good = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    good = good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    asked = good.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    n, n_asked = good.count(), asked.count()
    parts, groups = max(1, -(-n // PART_ROWS)), max(1, -(-n_asked // GROUP_QUERIES))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    here = good.select(spread("id", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(False).alias("asks"), "id", "v")
    there = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), spread("id", groups).alias("grp"), F.lit(True).alias("asks"), "id", "v")

    def meet(block: pa.Table) -> pa.Table:
        asks = np.asarray(block.column("asks").combine_chunks())
        ids = np.asarray(block.column("id").combine_chunks())
        rows = _matrix(block.column("v"))
        columns = np.ascontiguousarray(rows[~asks].T)
        mass = (columns.astype(float) ** 2).sum(axis=0)
        out = [[], [], []]
        for own, query in zip(ids[asks], rows[asks]):
            got, scores = best(columns, ids[~asks], mass, query, int(own), k)
            out[0].append(np.full(len(got), own))
            out[1].append(got)
            out[2].append(scores)
        flat = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in out]
        return pa.table(flat, names=["query_id", "vec_id", "score"])

    met = here.unionByName(there).groupBy("part", "grp").applyInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
