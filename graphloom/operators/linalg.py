"""Sparse linear algebra on tables ``(src, dst, w)`` and thin matrices.

Products are joins on the inner index with partial aggregation.  Chains are
multiplied thin first.  Only blocks of at most a few hundred columns, whose
size does not follow the data, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import u01
from graphloom.functions.session import cut_lineage
from graphloom.functions.store import Rows, keep_rows


def scaled(a: DataFrame, factor: float) -> DataFrame:
    return a.select("src", "dst", (F.col("w") * factor).alias("w"))


def plus(*terms: DataFrame) -> DataFrame:
    out = terms[0]
    for t in terms[1:]:
        out = out.unionByName(t)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """sum_k A[i, k] B[k, j] over stored entries."""
    right = b.select(F.col("src").alias("_k"), F.col("dst").alias("_j"), F.col("w").alias("_w"))
    return a.join(right, F.col("dst") == F.col("_k")).groupBy("src", "_j").agg(F.sum(F.col("w") * F.col("_w")).alias("w")).select("src", F.col("_j").alias("dst"), "w")


#: A square matrix over at most this many ids (8 MB dense) is raised to powers as one array.
SMALL = 1024


def _small_powers(a: DataFrame, weights: Sequence[float | None], small: int) -> DataFrame | None:
    """sum_i weights[i] A^(i+1) by dense products, if A has at most ``small``
    ids; else nothing.  The ids are counted before anything is collected."""
    ids = a.select(F.explode(F.array("src", "dst")).alias("id")).distinct().limit(small + 1).collect()
    if not ids or len(ids) > small:
        return None
    names = np.array(sorted(r["id"] for r in ids))
    rows = a.groupBy("src", "dst").agg(F.sum("w").alias("w")).collect()
    m = np.zeros((len(names), len(names)))
    held = np.zeros(m.shape, bool)
    for r in rows:
        i, j = np.searchsorted(names, [r["src"], r["dst"]])
        m[i, j], held[i, j] = r["w"], True
    power, stored, total, seen = m, held, np.zeros(m.shape), np.zeros(m.shape, bool)
    for k, weight in enumerate(weights):
        if k:
            power, stored = power @ m, (stored.astype(float) @ held.astype(float)) > 0
        if weight is not None:
            total, seen = total + weight * power, seen | stored
    i, j = np.nonzero(seen)
    return a.sparkSession.createDataFrame([(int(names[x]), int(names[y]), float(total[x, y])) for x, y in zip(i, j)], "src long, dst long, w double")


def power_sum(a: DataFrame, upto: int, small: int = SMALL) -> DataFrame:
    """A + A^2 + ... + A^upto; nothing for upto = 0.  Matrices of at most
    ``small`` ids, such as those over blocks, are multiplied as arrays."""
    if upto <= 0:
        return a.limit(0)
    if upto > 1 and (dense := _small_powers(a, [1.0] * upto, small)) is not None:
        return dense
    power, terms = a, [a]
    for _ in range(upto - 1):
        power = cut_lineage(matmul(power, a))
        terms.append(power)
    return plus(*terms)


def walk_sum(p: DataFrame, restart: float, steps: int, offset: int = 0, weights: Sequence[float] | None = None, small: int = SMALL) -> DataFrame:
    """sum_i w_i P^(i+1) for offset <= i < steps; w_i falls as (1-restart)^i,
    normalised over all steps, unless given."""
    if weights is None:
        raw = [(1 - restart) ** i for i in range(steps)]
        weights = [x / sum(raw) for x in raw]
    used = [float(w) if i >= offset else None for i, w in enumerate(weights[:steps])]
    if steps > 1 and steps > offset and (dense := _small_powers(p, used, small)) is not None:
        return dense
    power, terms = p, []
    for i in range(steps):
        if i:
            power = cut_lineage(matmul(power, p))
        if i >= offset:
            terms.append(scaled(power, float(weights[i])))
    return plus(*terms) if terms else p.limit(0)


#: Products that a task of ``row_moments`` adds up at once.
CELLS = 1 << 22
#: Rows that a task of ``row_moments`` looks up at once.
BLOCK_IDS = 4096


class _Sums:
    """Adds numbers up by cell; the room is kept, and is zero between two calls."""

    def __init__(self) -> None:
        self.dense, self.stamp = np.zeros(0), np.zeros(0, np.int32)

    def __call__(self, cells: np.ndarray, x: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct cells, sums); cells are below ``room``."""
        if len(self.dense) < room:
            self.dense, self.stamp = np.zeros(room), np.zeros(room, np.int32)
        np.add.at(self.dense, cells, x)
        number = np.arange(len(cells), dtype=np.int32)
        self.stamp[cells] = number
        own = cells[self.stamp[cells] == number]
        sums = self.dense[own]
        self.dense[own] = 0.0
        return own, sums


def _stretches(sizes: np.ndarray, limit: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``most`` items that come to ``limit``, one item at least."""
    upto, lo = np.concatenate(([0], np.cumsum(sizes))), 0
    while lo < len(sizes):
        hi = int(np.searchsorted(upto, upto[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most)
        yield lo, min(hi, len(sizes))
        lo = hi


def row_moments(spark: SparkSession, a: Rows, share: float, right: Rows) -> DataFrame:
    """(src, n, total, squares): how many entries each row of ``share`` x A + A x
    ``right`` stores, their sum and the sum of their squares.

    The matrix is not written and nothing is dealt out: a task has a part of
    the rows of A, reads the rows of ``right`` that these reach from the shared
    folder and adds up the products of some rows at a time.
    """
    low, span = min(a.low, right.low), max(a.high, right.high) - min(a.low, right.low) + 1

    def of_part(part: int, add_up: _Sums) -> Iterator[tuple[np.ndarray, ...]]:
        ids, starts, cols, w, factor = a.of_part(part)
        x = w * np.repeat(factor, np.diff(starts))
        inner, back = np.unique(cols, return_inverse=True)
        inner = inner.astype(np.int64)
        sizes = right.sizes(inner)[back] + 1
        for lo, hi in _stretches(np.add.reduceat(sizes, starts[:-1]) if len(ids) else np.zeros(0, np.int64), CELLS, BLOCK_IDS):
            row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            own, met, begin = slice(starts[lo], starts[hi]), [], starts[lo]
            for first, last in _stretches(sizes[own], CELLS, starts[hi] - begin):  # one but for a very long row
                here = slice(begin + first, begin + last)
                used, at = np.unique(back[here], return_inverse=True)
                start, to, y = right.take(inner[used])
                names = None
                to, straight, width = to - low, cols[here].astype(np.int64) - low, span
                if span > 4 * CELLS:  # ids far apart: those met are numbered
                    names, code = np.unique(np.concatenate([to, straight]), return_inverse=True)
                    to, straight, width = code[: len(to)], code[len(to) :], len(names)
                most, size = max(1, 4 * CELLS // width), start[at + 1] - start[at]
                edge = np.searchsorted(row[first:last], np.arange(row[first], row[last - 1] + most + 1, most))
                for s, e in zip(edge[:-1], edge[1:]):
                    n = size[s:e]
                    place = np.arange(n.sum()) + np.repeat(start[at[s:e]] - np.cumsum(n) + n, n)
                    base = (row[first:last][s:e] - row[first + s]) * width
                    cells = np.concatenate([np.repeat(base, n) + to[place], base + straight[s:e]])
                    products = np.concatenate([np.repeat(x[here][s:e], n) * y[place], share * x[here][s:e]])
                    cell, sums = add_up(cells, products, most * width)
                    col = cell % width
                    met.append((cell // width + row[first + s], col if names is None else names[col], sums))
            r, c, v = (np.concatenate(m) for m in zip(*met))
            if hi == lo + 1 and len(met) > 1:
                code, at = np.unique(c, return_inverse=True)
                r, v = np.zeros(len(code), np.int64), np.bincount(at, v)
            yield ids[lo:hi], np.bincount(r, minlength=hi - lo), np.bincount(r, v, hi - lo), np.bincount(r, v * v, hi - lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add_up = _Sums()
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for found in of_part(part, add_up):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["src", "n", "total", "squares"])

    return spark.range(0, a.parts, 1, a.parts).mapInArrow(run, "src long, n long, total double, squares double")


def power_sum_moments(a: DataFrame, upto: int, about: int | None = None) -> DataFrame:
    """``row_moments`` of ``power_sum``: A + A (A + .. + A^(upto - 1)); ``about``
    as in ``keep_rows``.  Up to the second power A is all that is written."""
    own = keep_rows(a, about=about)
    return row_moments(a.sparkSession, own, 1.0, own if upto == 2 else keep_rows(power_sum(a, upto - 1, small=0)))


def walk_sum_moments(p: DataFrame, restart: float, steps: int, shares: bool = False, about: int | None = None) -> DataFrame:
    """``row_moments`` of ``walk_sum``: its first term and P times the rest; with
    ``shares`` the rows of ``p`` are weights that are divided by their sums."""
    raw = [(1 - restart) ** i for i in range(steps)]
    weights = [x / sum(raw) for x in raw]
    own = keep_rows(p, shares, about)
    if steps == 2:
        return row_moments(p.sparkSession, own, weights[0], own.scaled(weights[1]))
    if shares:
        from graphloom.operators.graph import transition

        p = cut_lineage(transition(p))
    return row_moments(p.sparkSession, own, weights[0], keep_rows(walk_sum(p, restart, steps - 1, weights=weights[1:], small=0)))


def chain(factors: Sequence[DataFrame]) -> DataFrame:
    """The product of the factors from the right, so that a thin last factor
    keeps every intermediate thin."""
    out = factors[-1]
    for a in reversed(factors[:-1]):
        out = matmul(a, out)
    return out


def chain_sum(terms: Sequence[Sequence[DataFrame]], right: DataFrame | None = None) -> DataFrame:
    """Sum over terms of the product of factors, times ``right`` if given."""
    return plus(*(chain([*t, right] if right is not None else t) for t in terms))


def looked_up(terms: Sequence[Sequence[DataFrame]], asked: DataFrame) -> DataFrame:
    """``asked(src, dst)`` with ``w``, the entry of a sum of products, 0 where it has none.

    Only the rows asked for are multiplied out, from the left.
    """
    rows, pairs, found = asked.select("src").distinct(), asked.select("src", "dst").distinct(), None
    for factors in terms:
        x = factors[0].join(rows, "src", "left_semi")
        for a in factors[1:]:
            x = matmul(x, a)
        x = x.join(pairs, ["src", "dst"], "left_semi").select("src", "dst", "w")
        found = x if found is None else found.unionByName(x)
    entries = found.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return asked.join(entries, ["src", "dst"], "left").select(*asked.columns, F.coalesce("w", F.lit(0.0)).alias("w"))


def transposed_terms(terms: Sequence[Sequence[DataFrame]]) -> list[list[DataFrame]]:
    return [[transposed(a) for a in reversed(t)] for t in terms]


def gaussian(ids: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """(id, vec): seeded standard normal rows, by Box-Muller from hash draws."""
    k = F.sequence(F.lit(0), F.lit(width - 1))
    normal = lambda j: F.sqrt(-2 * F.log(1 - u01("gauss-r", F.col("id"), j, seed))) * F.cos(2 * np.pi * u01("gauss-a", F.col("id"), j, seed))
    return ids.select("id", F.transform(k, normal).alias("vec"))


#: Up to this many columns a thin matrix is summed column by column; wider ones as arrays.
COLUMNS = 40
#: Numbers that the vectors of one side of a cell of ``_cell_sums`` hold (128 MB).
THIN = 1 << 24


def _summed_rows(rows: DataFrame, width: int) -> DataFrame:
    """(src, w, vec) -> (id, vec): weighted row vectors added up by ``src``.

    Each batch adds up its own rows first, so that a node passes on as many
    rows as batches it stands in, a hub too.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                src = np.asarray(batch.column(0))
                x = np.asarray(batch.column(2).flatten()).reshape(-1, width) * np.asarray(batch.column(1))[:, None]
                order = np.argsort(src, kind="stable")
                ids, first = np.unique(src[order], return_index=True)
                yield _vectors(ids, np.add.reduceat(x[order], first, axis=0))

    def total(group: pa.Table) -> pa.Table:
        x = np.concatenate([np.asarray(c.flatten()) for c in group.column("vec").chunks]).reshape(-1, width)
        return pa.Table.from_batches([_vectors(np.asarray(group.column("id").slice(0, 1).combine_chunks()), x.sum(axis=0, keepdims=True))])

    return rows.select("src", "w", "vec").mapInArrow(partial, "id long, vec array<double>").groupBy("id").applyInArrow(total, "id long, vec array<double>")


def _vectors(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "vec"])


def _cell_sums(a: DataFrame, thin: DataFrame, width: int) -> DataFrame:
    """A times a thin matrix (id, vec) by cells: (id, vec).

    Vectors are dealt to blocks, entries to cells of a block of columns and
    one of rows.  A vector is sent once for each block of rows, a cell passes
    on one sum a row, so that no entry carries a vector.
    """
    rows = max(1, THIN // width)
    n = max(1, -(-8 * thin.count() // rows))
    m = max(1, -(-a.count() // (n * rows)))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    none = F.lit(None)
    entries = a.where("src is not null and dst is not null and w is not null").select(deal("dst", n).alias("cb"), deal("src", m).alias("rb"), "src", "dst", "w", none.cast("array<double>").alias("vec"))
    sent = thin.select(deal("id", n).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("rb"), none.cast("long").alias("src"), F.col("id").alias("dst"), none.cast("double").alias("w"), "vec")

    def added(ids: np.ndarray, vectors: Callable[[slice], np.ndarray]) -> pa.Table:
        """Sums of the vectors of equal ``ids``, which are sorted; some at once."""
        step, out = max(1, CELLS // width), [_vectors(np.zeros(0, np.int64), np.zeros((0, width)))]
        for lo in range(0, len(ids), step):
            own, first = np.unique(ids[lo : lo + step], return_index=True)
            out.append(_vectors(own, np.add.reduceat(vectors(slice(lo, lo + step)), first, axis=0)))
        return pa.Table.from_batches(out)

    def meet(cell: pa.Table) -> pa.Table:
        given = cell.filter(pc.is_valid(cell.column("vec"))).combine_chunks()
        names = given.column("dst").to_numpy()
        flat = given.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, order = flat.reshape(len(names), width), np.argsort(names, kind="stable")
        own = cell.filter(pc.is_null(cell.column("vec"))).select(["src", "dst", "w"])
        src, dst, w = (own.column(c).to_numpy() for c in ("src", "dst", "w"))
        at = np.searchsorted(names[order], dst)
        met = np.flatnonzero((at < len(names)) & (names[order][np.minimum(at, len(names) - 1)] == dst)) if len(names) else np.zeros(0, np.int64)
        met = met[np.argsort(src[met], kind="stable")]
        return added(src[met], lambda s: x[order[at[met[s]]]] * w[met[s], None])

    def total(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        x, order = group.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width), np.argsort(ids, kind="stable")
        out = added(ids[order], lambda s: x[order[s]])
        ids = out.column("id").to_numpy()
        if len(np.unique(ids)) == len(ids):
            return out
        last = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in out.column("vec").chunks]).reshape(len(ids), width)
        own, first = np.unique(ids, return_index=True)
        return pa.Table.from_batches([_vectors(own, np.add.reduceat(last, first, axis=0))])

    schema = "id long, vec array<double>"
    part = entries.unionByName(sent).groupBy("cb", "rb").applyInArrow(meet, schema)
    return part.groupBy(deal("id", n * m)).applyInArrow(total, schema) if n * m > 1 else part.groupBy().applyInArrow(total, schema)


def times_thin(a: DataFrame, thin: DataFrame, width: int) -> DataFrame:
    """A times a thin matrix (id, vec): (id, vec) of the non-empty rows.

    Entries meet their row vectors by a join and are summed by one column a
    component, with partial aggregation, or, beyond ``COLUMNS``, by cells.
    """
    if width > COLUMNS:
        return _cell_sums(a, thin, width)
    joined = a.join(thin.withColumnRenamed("id", "dst"), "dst")
    sums = joined.groupBy("src").agg(*(F.sum(F.col("w") * F.col("vec")[k]).alias(f"_{k}") for k in range(width)))
    return sums.select(F.col("src").alias("id"), F.array(*(F.col(f"_{k}") for k in range(width))).alias("vec"))


def gram(thin: DataFrame, width: int) -> np.ndarray:
    """vec' vec summed over rows: width x width, folded per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(total.ravel())], names=["g"])

    parts = thin.select("vec").mapInArrow(run, "g double").withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)))
    rows = parts.groupBy("k").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(width * width)
    for r in rows:
        out[r["k"]] = r["g"]
    return out.reshape(width, width)


def rotated(thin: DataFrame, m: np.ndarray) -> DataFrame:
    """Every row vector times the small matrix ``m``."""
    rows, cols = m.shape
    flat = m.T.tolist()
    dot = lambda c: sum((F.col("vec")[k] * float(c[k]) for k in range(1, rows)), F.col("vec")[0] * float(c[0]))
    if rows * cols <= 400:
        return thin.select("id", F.array(*(dot(c) for c in flat)).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, rows) @ m
            at = pa.array(np.arange(0, x.size + 1, cols), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["id", "vec"])

    return thin.select("id", "vec").mapInArrow(run, "id long, vec array<double>")


#: A Gram matrix whose eigenvalues span no more than this gives orthonormal columns at once.
SPAN = 1e-7


def orthonormal(thin: DataFrame, width: int) -> DataFrame:
    """Columns made orthonormal through the Gram matrix; directions without
    mass (1e-13 of the longest) become zero.

    A Gram matrix tells directions only down to the root of the machine's
    precision.  Where they span more, columns are turned first, by which they
    stand nearly at right angles, then brought to length one and made
    orthonormal by the Gram matrix of these, so that short ones count too.
    """
    values, axes = np.linalg.eigh(gram(thin, width))
    if values.max(initial=0.0) <= 0:
        return cut_lineage(rotated(thin, np.zeros((width, width))))
    if values.min() > values.max() * SPAN:
        return cut_lineage(rotated(thin, axes / np.sqrt(values)))
    thin = cut_lineage(rotated(thin, axes))
    for _ in range(4):
        g = gram(thin, width)
        length = np.sqrt(np.diag(g))
        keep = length > length.max() * 1e-13
        scale = np.where(keep, 1 / np.where(keep, length, 1.0), 0.0)
        values, axes = np.linalg.eigh(g * scale[:, None] * scale[None, :])
        kept = values > 1e-10
        thin = cut_lineage(rotated(thin, scale[:, None] * axes * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1.0)), 0.0)))
        if values[kept].min() > 1e-3:
            break
    return thin


def svd(terms: Sequence[Sequence[DataFrame]] | DataFrame, rank: int, oversample: int = 10, rounds: int = 1, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Randomised SVD (U as (id, vec), S, V as (id, vec)) of a table or of a
    sum of products, which is never assembled.

    A Gaussian sketch and ``rounds`` power iterations, made orthonormal each
    time; singular values are in falling order.
    """
    terms = [[terms]] if isinstance(terms, DataFrame) else terms
    back, width = transposed_terms(terms), rank + oversample

    def apply(side: Sequence[Sequence[DataFrame]], thin: DataFrame) -> DataFrame:
        out = None
        for factors in side:
            x = thin
            for a in reversed(factors):
                x = times_thin(a, x, width)
            out = x if out is None else out.unionByName(x)
        if len(side) > 1 and width > COLUMNS:
            out = _summed_rows(out.select(F.col("id").alias("src"), F.lit(1.0).alias("w"), "vec"), width)
        elif len(side) > 1:
            out = out.groupBy("id").agg(*(F.sum(F.col("vec")[k]).alias(f"_{k}") for k in range(width))).select("id", F.array(*(F.col(f"_{k}") for k in range(width))).alias("vec"))
        return cut_lineage(out)

    columns = None
    for factors in terms:
        ids = factors[-1].select(F.col("dst").alias("id"))
        columns = ids if columns is None else columns.union(ids)
    z = orthonormal(apply(terms, gaussian(columns.distinct(), width, seed)), width)
    for _ in range(rounds):
        z = orthonormal(apply(terms, orthonormal(apply(back, z), width)), width)
    b = apply(back, z)  # columns x width: X' Z
    values, axes = np.linalg.eigh(gram(b, width))
    order = np.argsort(-values)[:rank]
    s, axes = np.sqrt(np.maximum(values[order], 0.0)), axes[:, order]
    inverse = np.where(s > 1e-12 * max(s.max(initial=0.0), 1e-300), 1 / np.where(s > 0, s, 1.0), 0.0)
    return rotated(z, axes), s, rotated(b, axes * inverse)


def pca(vectors: DataFrame, k: int = 2, vec_col: str = "vec") -> DataFrame:
    """(id, point): the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.col(vec_col)).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select("id", vector_to_array("p").alias("point"))


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 10, seed: int = 0, vec_col: str = "vec") -> DataFrame:
    """(id, grp): k-means by cosine."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.where(F.exists(vec_col, lambda x: x != 0)).select("id", array_to_vector(F.col(vec_col)).alias("v"))
    model = KMeans(k=k, maxIter=rounds, seed=seed, distanceMeasure="cosine", featuresCol="v", predictionCol="grp").fit(v)
    return model.transform(v).select("id", F.col("grp").cast("long").alias("grp"))


class Adam:
    """Adam ascent with an optional soft threshold after each step."""

    def __init__(self, rate: float = 0.001, first: float = 0.9, second: float = 0.999, tiny: float = 1e-8) -> None:
        self.rate, self.first, self.second, self.tiny = rate, first, second, tiny
        self.step, self.m, self.v = 0, 0.0, 0.0

    def ascend(self, theta: np.ndarray, gradient: np.ndarray, lasso: float = 0.0, positive: bool = False) -> np.ndarray:
        self.step += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        size = self.rate / (np.sqrt(self.v / (1 - self.second**self.step)) + self.tiny)
        out = theta + size * self.m / (1 - self.first**self.step)
        out = np.sign(out) * np.maximum(np.abs(out) - lasso * size, 0.0)
        return np.maximum(out, 0.0) if positive else out
