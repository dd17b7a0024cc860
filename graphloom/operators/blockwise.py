"""Stochastic gradients over partitions: node and context tables in blocks.

A model is two tables of vectors, one a node as a center and one a node as a
context, and rows ``(a, b, y, n)`` that say how the product of center ``a``
and context ``b`` should come out.  Both tables are dealt to ``B`` blocks by
hash.  In round ``r`` center block ``i`` meets context block ``i + r``: no two
tasks of a round share a vector, so each trains on the rows of its own cell
and hands both blocks on.  ``B`` rounds are an epoch.  A task holds two blocks
and one cell, whatever the size of the graph.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import u01
from graphloom.functions.session import cut_lineage

#: Nodes of a block and rows of a cell that a task holds.
BLOCK_NODES = 16_384
CELL_ROWS = 2_000_000
STATE = "side int, id long, weight double, vec array<double>, m array<double>, v array<double>, t long"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def block_of(id_: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")


def blocks_for(nodes: int, rows: int) -> int:
    """Two blocks at least, and as many as keep blocks and cells small."""
    return max(2, -(-nodes // BLOCK_NODES), int(np.ceil((rows / CELL_ROWS) ** 0.5)))


def start_tables(nodes: DataFrame, dim: int, seed: int = 0, weights: DataFrame | None = None, extra: int = 0, zero_contexts: bool = False) -> DataFrame:
    """Both tables with components uniform in +-0.5/dim, and ``extra`` zeros after them.

    ``weights(id, weight)`` are what contexts are drawn by as negatives; a node
    without is never drawn.
    """
    ks = F.sequence(F.lit(0), F.lit(dim - 1))
    draws = lambda side: F.transform(ks, lambda k: (u01(f"start-{side}", F.col("id"), k, seed) - 0.5) / dim)
    more = F.array_repeat(F.lit(0.0), extra)
    nothing = F.array_repeat(F.lit(0.0), dim + extra)
    weighed = nodes.join(weights, "id", "left") if weights is not None else nodes.withColumn("weight", F.lit(0.0))
    rows = None
    for side in (0, 1):
        vec = F.concat(draws(side), more) if side == 0 or not zero_contexts else nothing
        part = weighed.select(F.lit(side).alias("side"), "id", F.coalesce("weight", F.lit(0.0)).alias("weight"), vec.alias("vec"), nothing.alias("m"), nothing.alias("v"), F.lit(0).cast("long").alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


class Steps:
    """Adam (``adam``: with the gradient's norm over both blocks clipped) or AdaGrad steps on both blocks."""

    def __init__(self, kind: str, rate: float, clip: float | None, state: list[list[np.ndarray]], t: int) -> None:
        self.kind, self.rate, self.clip, self.state, self.t = kind, rate, clip, state, t

    def take(self, grads: list[np.ndarray], frozen: bool) -> None:
        self.t += 1
        if self.clip is not None:
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            grads = [g * min(1.0, self.clip / (norm + 1e-6)) for g in grads]
        for side, ((x, m, v), g) in enumerate(zip(self.state, grads)):
            if frozen and side == 0:
                continue
            if self.kind == "adagrad":
                v += g * g
                x += self.rate * g / np.sqrt(v + 1e-8)
            else:
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _sums(n: int, width: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` added up by position, one component after the other."""
    return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(width)], axis=1)


def logistic(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Ascent of n (y ls(a.b) + (1 - y) ls(-a.b))."""
    pull = ((y - sigmoid((a[i] * b[j]).sum(1))) * n)[:, None]
    return [_sums(len(a), a.shape[1], i, pull * b[j]), _sums(len(b), b.shape[1], j, pull * a[i])]


def weighted_squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Descent of n (a.b + bias a + bias b - y)^2 / 2; the last component is the bias."""
    error = n * (y - (a[i, :-1] * b[j, :-1]).sum(1) - a[i, -1] - b[j, -1])
    pull = error[:, None]
    left, right = np.concatenate([pull * b[j, :-1], pull], axis=1), np.concatenate([pull * a[i, :-1], pull], axis=1)
    return [_sums(len(a), a.shape[1], i, left), _sums(len(b), b.shape[1], j, right)]


KERNELS = {"logistic": logistic, "squares": weighted_squares}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([np.asarray(c.flatten()) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1).copy()


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def train(
    tables: DataFrame,
    rows: DataFrame,
    blocks: int,
    kernel: str = "logistic",
    steps: str = "adagrad",
    rate: float = 0.05,
    batch: int = 4096,
    clip: float | None = None,
    a_sample: int = 1,
    negatives: int = 0,
    epochs: int = 1,
    frozen: bool = False,
    seed: int = 0,
) -> DataFrame:
    """The tables after ``epochs`` epochs over ``rows(a, b, y, n)``.

    ``negatives`` more rows with y = 0 are made for every row with y = 1: same
    center, contexts drawn by weight from the block that the center has met.
    Adam takes the mean over samples of ``a_sample`` rows each, AdaGrad the sum.
    ``frozen`` leaves the centers as they are.  The order of the rows and the
    draws hang on ids and the seed, not on partitions.
    """
    cells = cut_lineage(rows.select("a", "b", "y", F.col("n").cast("double").alias("n"), block_of(F.col("a"), blocks).alias("i"), block_of(F.col("b"), blocks).alias("j")))
    def task(epoch: int, r: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, group: pa.Table) -> pa.Table:
            side = np.asarray(group.column("side").combine_chunks())
            parts, ids = [], []
            for s in (0, 1):
                own = group.filter(pa.array(side == s))
                own = own.take(pa.array(np.argsort(np.asarray(own.column("id").combine_chunks()))))
                parts.append(own)
                ids.append(np.asarray(own.column("id").combine_chunks()))
            cell = group.filter(pa.array(side == 2))
            arrays = [[_matrix(p.column(c)) for c in ("vec", "m", "v")] for p in parts]
            t = max((int(np.asarray(p.column("t").combine_chunks()).max(initial=0)) for p in parts), default=0)
            if cell.num_rows and all(map(len, ids)):
                a, b, y, n = (np.asarray(cell.column(c).combine_chunks()) for c in ("id", "b", "y", "n"))
                order = np.lexsort((y, b, a))
                rng = np.random.default_rng([seed, epoch, r, key[0].as_py()])
                rng.shuffle(order)
                i, j, y, n = np.searchsorted(ids[0], a[order]), np.searchsorted(ids[1], b[order]), y[order], n[order]
                weight = np.asarray(parts[1].column("weight").combine_chunks())
                run_up = np.cumsum(weight)
                stepper = Steps(steps, rate, clip, arrays, t)
                for lo in range(0, len(i), batch):
                    bi, bj, by, bn = (x[lo : lo + batch] for x in (i, j, y, n))
                    if negatives and run_up[-1] > 0:
                        good = np.repeat(np.flatnonzero(by > 0), negatives)
                        drawn = np.minimum(np.searchsorted(run_up, rng.random(len(good)) * run_up[-1], side="right"), len(run_up) - 1)
                        miss = drawn != bj[good]  # the context itself is no negative
                        good, drawn = good[miss], drawn[miss]
                        bi, bj, by, bn = np.concatenate([bi, bi[good]]), np.concatenate([bj, drawn]), np.concatenate([by, np.zeros(len(good))]), np.concatenate([bn, bn[good]])
                    scale = a_sample / max(len(bi), 1) if steps == "adam" else 1.0
                    stepper.take([g * scale for g in KERNELS[kernel](arrays[0][0], arrays[1][0], bi, bj, by, bn)], frozen)
                t = stepper.t
            out = [pa.table([p.column("side"), p.column("id"), p.column("weight"), *map(_lists, xs), pa.array(np.full(p.num_rows, t))], names=["side", "id", "weight", "vec", "m", "v", "t"]) for p, xs in zip(parts, arrays) if p.num_rows]
            return pa.concat_tables(out) if out else group.select(["side", "id", "weight", "vec", "m", "v", "t"]).slice(0, 0)

        return run

    state = tables
    for epoch in range(epochs):
        for r in range(blocks):
            own = block_of(F.col("id"), blocks)
            met = F.when(F.col("side") == 0, own).otherwise(F.pmod(own - r, F.lit(blocks))).cast("int")
            given = cells.where(F.pmod(F.col("j") - F.col("i"), F.lit(blocks)) == r)
            nothing = F.lit(None)
            asked = given.select(F.col("i").alias("key"), F.lit(2).alias("side"), F.col("a").alias("id"), F.lit(0.0).alias("weight"), *(nothing.cast("array<double>").alias(c) for c in ("vec", "m", "v")), F.lit(0).cast("long").alias("t"), "b", "y", "n")
            held = state.select(met.alias("key"), "side", "id", "weight", "vec", "m", "v", "t", nothing.cast("long").alias("b"), nothing.cast("double").alias("y"), nothing.cast("double").alias("n"))
            state = cut_lineage(held.unionByName(asked).groupBy("key").applyInArrow(task(epoch, r), STATE))
    return state


def two_sided(state: DataFrame, dim: int) -> DataFrame:
    """(id, vec, out): centers and contexts side by side, the first ``dim`` components."""
    of = lambda side, name: state.where(F.col("side") == side).select("id", F.slice("vec", 1, dim).alias(name))
    return of(0, "vec").join(of(1, "out"), "id")
