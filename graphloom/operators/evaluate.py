"""Scores and evaluation measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.ranking import first_rows, running_sums
from graphloom.functions.scalar import cosine, dot, kl_term, safe_log, u01, unit
from graphloom.functions.session import cut_lineage
from graphloom.functions.store import new_folder, read_arrays, write_arrays
from graphloom.operators.graph import degrees, dense_codes
from graphloom.operators.samplers import community_pairs

#: Distribution function of Poisson(1) at 0, 1, .. in steps of 2**-16.
POISSON_STEPS = [24109, 48219, 60273, 64292, 65296, 65497, 65531]

PLAIN, REVERSED, BIASED, RESIDUAL, ADAPTIVE = "dot", "minus_dot", "glove", "residual", "offset"


def gathered(pairs: DataFrame, vectors: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Pairs with the vectors ``va`` and ``vb`` of both ends."""
    left, right = vectors.select(F.col("id").alias(a), F.col("vec").alias("va")), vectors.select(F.col("id").alias(b), F.col("vec").alias("vb"))
    return pairs.join(left, a).join(right, b)


def edge_scores(pairs: DataFrame, vectors: DataFrame, proximity: str = "dot") -> DataFrame:
    """``pairs`` with ``score``: inner product or cosine; else ``ValueError``."""
    if proximity not in ("dot", "cos"):
        raise ValueError(f"unknown proximity {proximity!r}")
    joined = gathered(pairs, vectors)
    score = dot(F.col("va"), F.col("vb")) if proximity == "dot" else cosine(F.col("va"), F.col("vb"))
    return joined.select(*pairs.columns, score.alias("score"))


def modelled_scores(pairs: DataFrame, vectors: DataFrame, edges: DataFrame, family: str, offsets: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``score`` in a model family's own terms.

    dot; minus_dot; glove and offset add ``offsets(id, a, b)`` of source and
    target; residual adds ln max(in-weight of src, 1) + ln max(out-weight of
    dst, 1).
    """
    scored = edge_scores(pairs, vectors)
    if family == PLAIN:
        return scored
    if family == REVERSED:
        return scored.withColumn("score", -F.col("score"))
    if family == RESIDUAL:
        deg = degrees(edges)
        offsets = deg.select("id", safe_log(F.col("in_w"), 1.0).alias("a"), safe_log(F.col("out_w"), 1.0).alias("b"))
    elif family not in (BIASED, ADAPTIVE) or offsets is None:
        raise ValueError(f"unknown family {family!r}, or offsets are missing")
    left, right = offsets.select(F.col("id").alias("src"), F.col("a").alias("_a")), offsets.select(F.col("id").alias("dst"), F.col("b").alias("_b"))
    full = scored.join(left, "src", "left").join(right, "dst", "left")
    return full.select(*pairs.columns, (F.col("score") + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score"))


def auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., auc) of ``y`` in {0, 1} and ``score``; ties count half, a NaN or
    null score is 0.5, one class only gives null.

    Scores are first counted per value; ranks run over distinct values by
    partition offsets, so that no task sorts a group.
    """
    clean = F.when(F.col("score").isNull() | F.isnan("score"), 0.5).otherwise(F.col("score"))
    per = scored.select(*by, clean.alias("s"), (F.col("y") > 0).cast("long").alias("y")).groupBy(*by, "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    below = running_sums(per, [F.col("s")], {"upto": "n"}, by).withColumn("below", F.col("upto") - F.col("n"))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    out = below.groupBy(*by) if by else below.groupBy()
    return out.agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: sum over falling distinct scores of precision times the gain
    in recall."""
    per = scored.groupBy("score").agg(F.sum((F.col("y") > 0).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    run = running_sums(per, [F.desc("score")], {"tp": "p", "all": "n"})
    return run.agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def contingency(labels: DataFrame, a: str = "y", b: str = "z") -> DataFrame:
    return labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def nmi(labels: DataFrame) -> DataFrame:
    """One row: 2 I(y; z) / (H(y) + H(z)) of two labelings in columns y, z."""
    cells = contingency(labels)
    total = F.sum("n").over(Window.partitionBy())
    p = cells.select("y", "z", (F.col("n") / total).alias("p"))
    p = p.select("p", F.sum("p").over(Window.partitionBy("y")).alias("py"), F.sum("p").over(Window.partitionBy("z")).alias("pz"))
    info = F.sum(kl_term(F.col("p"), F.col("py") * F.col("pz")))
    entropy = -F.sum(F.col("p") * F.log("py")) - F.sum(F.col("p") * F.log("pz"))
    return p.agg((2 * info / F.nullif(entropy, F.lit(0.0))).alias("nmi"))


def element_similarity(labels: DataFrame) -> DataFrame:
    """One row: mean over elements of n_ab min(1/n_a, 1/n_b)."""
    cells = contingency(labels)
    sized = cells.select("n", F.sum("n").over(Window.partitionBy("y")).alias("a"), F.sum("n").over(Window.partitionBy("z")).alias("b"))
    return sized.agg((F.sum(F.col("n") * F.col("n") * F.least(1.0 / F.col("a"), 1.0 / F.col("b"))) / F.sum("n")).alias("element_similarity"))


#: Vectors of one side of a block: with 64 components two sides and a strip of scores
#: stay near 100 MB.  Every vector is sent to all blocks of the other side.
BLOCK_ROWS = 16_384
STRIP = 64


def _rows_of(block: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    own = block.filter(pc.equal(block.column("side"), side))
    ids = np.asarray(own.column("id").combine_chunks())
    order = np.argsort(ids, kind="stable")
    flat = own.column("vec").combine_chunks()
    x = np.asarray(flat.flatten()).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
    return ids[order], x[order]


def _strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores) of strips of a b'; products are added in the order
    of the components, so that equal vectors score alike wherever they are."""
    for lo in range(0, len(a), STRIP):
        part = a[lo : lo + STRIP]
        scores = np.zeros((len(part), len(b)))
        for k in range(part.shape[1] if len(part) else 0):
            scores += part[:, k, None] * b[None, :, k]
        yield lo, scores


def _near_strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first row, scores, error) of strips of a b' by matrix products in single
    precision; no score is further from that of ``_in_order`` than the error.
    Vectors whose lengths leave that range are left to ``_strips``."""
    width, flat = a.shape[1], None
    longest = float(np.sqrt(np.einsum("ij,ij->i", b, b).max()))
    for lo in range(0, len(a), STRIP):
        part = a[lo : lo + STRIP]
        own = float(np.sqrt(np.einsum("ij,ij->i", part, part).max()))
        if all(1e-15 < x < 1e15 for x in (own, longest)):
            flat = np.ascontiguousarray(b.T, np.float32) if flat is None else flat
            yield lo, part.astype(np.float32) @ flat, 1.5 * (width + 4) * (2.0**-24 * own * longest + 1e-37)
        else:
            yield lo, next(_strips(part, b))[1], 0.0


def _in_order(a: np.ndarray, row: np.ndarray, b: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Products of the rows ``row`` of ``a`` and ``col`` of ``b``, added in the
    order of the components; one component is gathered at a time."""
    out = np.zeros(len(row))
    for k in range(a.shape[1]):
        out += a[row, k] * b[col, k]
    return out


def _candidates(scores: np.ndarray, k: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all scores that may be among the ``k`` largest of their
    rows.  The k-th largest of the maxima of stretches of a row is reached by
    ``k`` scores; only stretches that reach it are looked through."""
    n, cols = scores.shape
    least = -np.finfo(scores.dtype).max
    if cols <= k:
        return np.nonzero(scores >= least)
    parts = min(cols, max(8 * k, 64))
    size = cols // parts
    view = scores[:, : parts * size].reshape(n, parts, size)
    tops = view.max(axis=2)
    cut = np.maximum(np.partition(tops, parts - k, axis=1)[:, parts - k].astype(float) - 2 * error, least)
    row, part = np.nonzero(tops >= cut[:, None])
    hit, at = np.nonzero(view[row, part] >= cut[row, None])
    last, rest = np.nonzero(scores[:, parts * size :] >= cut[:, None])
    return np.concatenate([row[hit], last]), np.concatenate([part[hit] * size + at, rest + parts * size])


def _block_pairs(left: DataFrame, right: DataFrame, half: bool) -> DataFrame:
    """Rows (id, vec, side) dealt to pairs of blocks (qb, vb) of about
    ``BLOCK_ROWS`` rows a side; with ``half`` only pairs with qb <= vb."""
    count = lambda df: max(1, -(-df.count() // BLOCK_ROWS))
    n, m = count(left), count(right)
    deal = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda a, b: F.explode(F.sequence(a, b))
    first, last = F.lit(0), F.lit(m - 1)
    a = left.withColumn("qb", deal(n)).withColumn("vb", every(F.col("qb") if half else first, last))
    b = right.withColumn("vb", deal(m)).withColumn("qb", every(first, F.col("vb") if half else F.lit(n - 1)))
    side = lambda df, k: df.select("qb", "vb", "id", "vec", F.lit(k).alias("side"))
    return side(a, 0).unionByName(side(b, 1))


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.where("id is not null and vec is not null").select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("vec"))


#: Aggregates over persona pairs that are folded where blocks of personas meet.
EXTREMES = {"max": (np.maximum, 1.0), "min": (np.fmin, -1.0)}


def persona_scores(pairs: DataFrame, personas: DataFrame, vectors: DataFrame, aggregate: Column | str | None = None) -> DataFrame:
    """``pairs(src, dst)`` scored over all persona pairs: ``max`` (the default),
    ``min`` or ``avg`` of the inner products.

    The average is the product of both ends' mean vectors; the extremes are
    found where blocks of personas meet, one row a pair and block.  Any other
    aggregate is a column over ``s``; it needs a row for every persona pair.
    """
    if isinstance(aggregate, Column):
        a, b = personas.select(F.col("id").alias("src"), F.col("persona").alias("pa")), personas.select(F.col("id").alias("dst"), F.col("persona").alias("pb"))
        each = gathered(pairs.join(a, "src").join(b, "dst"), vectors, "pa", "pb").withColumn("s", dot(F.col("va"), F.col("vb")))
        return each.groupBy("src", "dst").agg(aggregate.alias("score"))
    aggregate = aggregate or "max"
    if aggregate != "avg" and aggregate not in EXTREMES:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    held = cut_lineage(personas.select("id", "persona").join(vectors.select(F.col("id").alias("persona"), "vec"), "persona"))
    sizes = cut_lineage(held.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    asked = pairs.select("src", "dst").distinct()
    asked = cut_lineage(asked.join(sizes.toDF("src", "na"), "src").join(sizes.toDF("dst", "nb"), "dst"))
    # a vector with a null component has no product
    whole = held.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).withColumn("vec", F.col("vec").cast("array<double>"))
    found = _persona_means(asked, whole) if aggregate == "avg" else _persona_extremes(asked, whole, sizes, aggregate)
    return asked.select("src", "dst").join(found, ["src", "dst"], "left")


def _persona_means(asked: DataFrame, whole: DataFrame) -> DataFrame:
    rows = whole.select("id", F.posexplode("vec").alias("k", "x")).groupBy("id", "k").agg(F.avg("x").alias("x"))
    means = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("vec"))  # one row a component
    return gathered(asked.select("src", "dst"), means).select("src", "dst", dot(F.col("va"), F.col("vb")).alias("score"))


def _persona_extremes(asked: DataFrame, whole: DataFrame, sizes: DataFrame, aggregate: str) -> DataFrame:
    """Personas are dealt to blocks by their node, those of a large node to
    several; a pair goes wherever a block of one end meets one of the other."""
    fold, sign = EXTREMES[aggregate]
    blocks = max(1, -(-whole.count() // BLOCK_ROWS))
    shares = lambda n: F.least(F.ceil(F.col(n) / (BLOCK_ROWS // 4)), F.lit(blocks)).cast("int")
    at = lambda node, part: F.pmod(F.xxhash64(node) + part, F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), shares(n) - 1))
    dealt = asked.select("src", "dst", each("na").alias("i"), "nb").select("src", "dst", "i", each("nb").alias("j"))
    dealt = cut_lineage(dealt.select(at("src", F.col("i")).alias("qb"), at("dst", F.col("j")).alias("vb"), "src", "dst").distinct())
    meetings = cut_lineage(dealt.select("qb", "vb").distinct())
    own = whole.join(sizes, "id").withColumn("at", at("id", F.pmod(F.xxhash64("persona"), shares("n")))).select("at", "id", "vec")
    side = lambda key, k: own.withColumnRenamed("at", key).join(meetings, key).select("qb", "vb", F.lit(k).alias("side"), "id", F.lit(0).cast("long").alias("dst"), "vec")
    named = dealt.select("qb", "vb", F.lit(2).alias("side"), F.col("src").alias("id"), "dst", F.lit(None).cast("array<double>").alias("vec"))

    def best(x: np.ndarray, y: np.ndarray) -> float:
        out = np.nan if fold is np.fmin else -np.inf
        for lo, scores, error in _near_strips(x, y):
            scores *= sign
            floor = float(np.fmax.reduce(scores, axis=None)) - 2 * error
            some = np.flatnonzero(~(scores.max(axis=1) < floor))
            row, col = np.nonzero(~(scores[some] < floor))
            row = some[row]
            value = fold.reduce(_in_order(x, lo + row, y, col))
            out = fold(out, value)
        return float(out)

    def meet(block: pa.Table) -> pa.Table:
        (ids, x), (others, y) = _rows_of(block, 0), _rows_of(block, 1)
        asks = block.filter(pc.equal(block.column("side"), 2))
        src, dst = np.asarray(asks.column("id").combine_chunks()), np.asarray(asks.column("dst").combine_chunks())
        a, b = (np.searchsorted(ids, src, s) for s in ("left", "right"))
        c, d = (np.searchsorted(others, dst, s) for s in ("left", "right"))
        some = (a < b) & (c < d)
        score = [best(x[a[k] : b[k]], y[c[k] : d[k]]) for k in np.flatnonzero(some)]
        return pa.table([pa.array(src[some]), pa.array(dst[some]), pa.array(np.array(score, float))], names=["src", "dst", "score"])

    met = side("qb", 0).unionByName(side("vb", 1)).unionByName(named).groupBy("qb", "vb").applyInArrow(meet, "src long, dst long, score double")
    return met.groupBy("src", "dst").agg(getattr(F, aggregate)("score").alias("score"))


def nearest(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(id, other, score, rank): each query's ``k`` largest inner products, ties
    to the smaller id.  Vectors have one length; null ones take no part.

    Queries meet all vectors in blocks of bounded size, dealt by hash; each
    pair of blocks is one task's product and passes on ``k`` rows a query.
    Products of matrices find what may count; that is summed anew in the order
    of the components, which settles scores and ties.
    """

    def meet(block: pa.Table) -> pa.Table:
        (ids, x), (others, y) = _rows_of(block, 0), _rows_of(block, 1)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for lo, scores, error in _near_strips(x, y) if len(ids) and len(others) else ():
            own = ids[lo : lo + len(scores)]
            if np.isin(own, others).any():
                scores[own[:, None] == others[None, :]] = -np.inf
            row, col = _candidates(scores, k, error)  # ties are settled by id
            exact = _in_order(x, lo + row, y, col)
            order = np.lexsort((others[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, exact = row[rank < k], col[rank < k], exact[rank < k]
            for at, v in zip(out, (own[row], others[col], exact)):
                at.append(v)
        return pa.table([pa.array(np.concatenate(v)) for v in out], names=["id", "other", "score"])

    every = _plain(vectors)
    met = _block_pairs(every if queries is None else _plain(queries), every, False).groupBy("qb", "vb").applyInArrow(meet, "id long, other long, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("id", "other", "score", F.col("rank").cast("int").alias("rank"))


def all_scores(vectors: DataFrame) -> DataFrame:
    """(id, other, score) of every ordered pair, a vector with itself included:
    as many rows as pairs."""

    def meet(block: pa.Table) -> pa.Table:
        (ids, x), (others, y) = _rows_of(block, 0), _rows_of(block, 1)
        parts = [scores.ravel() for _, scores in _strips(x, y)] if len(ids) and len(others) else []
        score = np.concatenate(parts) if parts else np.zeros(0)
        n = len(others) if len(score) else 0
        return pa.table([pa.array(np.repeat(ids, n)), pa.array(np.tile(others, len(ids) if n else 0)), pa.array(score)], names=["id", "other", "score"])

    every = _plain(vectors)
    return _block_pairs(every, every, False).groupBy("qb", "vb").applyInArrow(meet, "id long, other long, score double")


#: Vectors of a block, and pairs whose scores a task holds, in ``pair_precision``.
PAIR_BLOCK = 4096
PAIRS_HELD = 1 << 25


def _dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the columns of ``a`` and ``b``, added in the order of the rows."""
    out, one = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], min(b.shape[1], 2048)))
    for lo in range(0, b.shape[1], 2048):
        part, own = b[:, lo : lo + 2048], out[:, lo : lo + 2048]
        for x, y in zip(a, part):
            own += np.multiply(x[:, None], y[None, :], out=one[:, : own.shape[1]])
    return out


class _Blocks:
    """Vectors and group codes in files of the shared folder."""

    def __init__(self, folder: str, blocks: int) -> None:
        self.folder, self.blocks = folder, blocks
        self.pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]

    def read(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        flat, grp = read_arrays(self.folder, str(k)) or (np.zeros(0), np.zeros(0, np.int64))
        return flat.reshape(-1, len(grp)) if len(grp) else np.zeros((0, 0)), grp

    def strips(self, i: int, j: int, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores, hit) of the pairs of two blocks with ``low`` <= score < ``high``, a pair
        once, a vector with itself never.  Products in single precision tell which
        may be meant; what may be is added up in the order of the components."""
        (x, g), (y, h) = self.read(i), self.read(j)
        if not len(g) or not len(h):
            return
        every = low == -np.inf and high == np.inf
        near = _near_strips(x.T, y.T) if not every else ((lo, None, 0.0) for lo in range(0, len(g), STRIP))
        for lo, rough, error in near:
            own = x[:, lo : lo + STRIP]
            if every:
                may = np.ones((own.shape[1], len(h)), bool)
            else:
                may = ~((rough < float(low - 2 * error)) | (rough > float(high + 2 * error)))
            if i == j:
                may &= np.arange(lo, lo + own.shape[1])[:, None] < np.arange(len(h))[None, :]
            if 5 * np.count_nonzero(may) > may.size:
                score = _dense(own, y)[may]
                hit = ((g[lo : lo + STRIP, None] == h[None, :]) & (h >= 0))[may]
            else:
                row, col = np.nonzero(may)
                score = np.zeros(len(row))
                for a, b in zip(own, y):
                    score += a[row] * b[col]
                hit = (g[lo + row] == h[col]) & (h[col] >= 0)
            if not every:
                keep = ~(score < low) if high == np.inf else (score >= low) & (score < high)
                score, hit = score[keep], hit[keep]
            yield score, hit

    def selves(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """The same of the vectors with themselves."""
        out = [(np.zeros(0), np.zeros(0, bool))]
        for k in range(self.blocks):
            x, g = self.read(k)
            score = np.zeros(len(g))
            for a in x:
                score += a * a
            keep = ~(score < low) if high == np.inf else (score >= low) & (score < high)
            out.append((score[keep], g[keep] >= 0))
        return tuple(np.concatenate(v) for v in zip(*out))  # type: ignore[return-value]


def _at_least(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return len(values) - np.searchsorted(values, x)


def pair_precision(vectors: DataFrame) -> DataFrame:
    """One row (average_precision): all ordered pairs of ``vectors(id, vec,
    grp)``, a vector with itself included, ranked by inner product; a hit is a
    pair within a group, which a null is not.

    No pair is a row.  Vectors lie in blocks in the shared folder; scores are
    cut into ranges of about ``PAIRS_HELD`` pairs by a few of them, which
    bears on the shares of the tasks only.  One pass over all pairs counts
    hits and pairs of each range; then a task for each range finds all its
    scores, sorts them and adds the precisions up, exactly as one sort of all
    would.  Work grows with the pairs times the ranges.
    """
    spark = vectors.sparkSession
    codes = dense_codes(vectors, "grp").select(F.col("grp").alias("_g"), "code")
    plain = vectors.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("vec"), "grp").where("id is not null and vec is not null")
    coded = cut_lineage(plain.join(codes, F.col("grp") == F.col("_g"), "left").select("id", "vec", F.coalesce("code", F.lit(-1).cast("long")).alias("code")))
    n = coded.count()
    found = _Blocks(new_folder(spark, "vectors"), max(1, -(-n // PAIR_BLOCK)))

    def write(block: pa.Table) -> pa.Table:
        k, size = block.column("block")[0].as_py(), block.num_rows
        x = np.concatenate([np.asarray(c.flatten()) for c in block.column("vec").chunks]).reshape(size, -1)
        write_arrays(found.folder, str(k), [np.ascontiguousarray(x.T).ravel(), block.column("code").to_numpy()])
        return pa.table([pa.array([k], pa.int32())], names=["block"])

    coded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(found.blocks)).cast("int")).groupBy("block").applyInArrow(write, "block int").count()
    pairs, count = found.pairs, n * (n - 1) // 2
    ranges = max(1, -(-count // PAIRS_HELD), min(spark.sparkContext.defaultParallelism, count >> 20))
    tasks = spark.range(0, len(pairs), 1, len(pairs))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                (x, _), (y, _) = (found.read(b) for b in pairs[k])
                if x.size and y.size:
                    rng = np.random.default_rng([k, 1])
                    size = max(1, 256 * ranges // len(pairs))
                    row, col = rng.integers(0, x.shape[1], size), rng.integers(0, y.shape[1], size)
                    yield pa.RecordBatch.from_arrays([pa.array(sum(a[row] * b[col] for a, b in zip(x, y)))], names=["s"])

    given = np.sort([r.s for r in tasks.mapInArrow(some, "s double").collect() if np.isfinite(r.s)]) if ranges > 1 else np.zeros(0)
    cuts = np.unique(given[np.linspace(0, len(given) - 1, ranges + 1).astype(int)[1:-1]]) if len(given) else given
    low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                total = np.zeros((2, len(low)), np.int64)
                for score, hit in found.strips(*pairs[k], -np.inf, np.inf):
                    total += np.bincount(np.searchsorted(cuts, score, side="right") + len(low) * hit, minlength=2 * len(low)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(total[0]), pa.array(total[1])], names=["r", "miss", "hit"])

    counted = {r.r: (r.miss, r.hit) for r in tasks.mapInArrow(tally, "r long, miss long, hit long").groupBy("r").agg(F.sum("miss").alias("miss"), F.sum("hit").alias("hit")).collect()}
    own = [counted.get(r, (0, 0)) for r in range(len(low))]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                above = [2 * sum(o[k] for o in own[r + 1 :]) for k in (0, 1)]
                if r + 1 < len(low):
                    _, hit = found.selves(high[r], np.inf)
                    above = [above[0] + int((~hit).sum()), above[1] + int(hit.sum())]
                held, filled = [np.empty(own[r][k]) for k in (0, 1)], [0, 0]
                for i, j in pairs if sum(own[r]) else ():
                    for score, hit in found.strips(i, j, low[r], high[r]):
                        for k, x in enumerate((score[~hit], score[hit])):
                            held[k][filled[k] : filled[k] + len(x)] = x
                            filled[k] += len(x)
                score, hit = found.selves(low[r], high[r])
                alone = [np.sort(score[~hit]), np.sort(score[hit])]
                for x in held:
                    x.sort()
                out = 0.0
                for start in range(0, len(held[1]) + 1, 1 << 20):  # some hits at a time, equal ones together
                    end = start + (1 << 20)
                    x = held[1][start:end]
                    if start and len(x):
                        x = x[np.searchsorted(x, held[1][start - 1], side="right") :]
                    if not start:
                        x = np.concatenate([x, alone[1]])
                    x = np.unique(x)
                    if start:
                        x = x[~np.isin(x, alone[1])]
                    ahead = [2 * _at_least(held[k], x) + _at_least(alone[k], x) for k in (0, 1)]
                    same = ahead[1] - 2 * (len(held[1]) - np.searchsorted(held[1], x, side="right")) - (len(alone[1]) - np.searchsorted(alone[1], x, side="right"))
                    out += float((same * ((above[1] + ahead[1]) / (above[0] + above[1] + ahead[0] + ahead[1]))).sum())
                hits = 2 * len(held[1]) + len(alone[1])
                yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([hits])], names=["gain", "hits"])

    ranked = spark.range(0, len(low), 1, len(low)).mapInArrow(rank, "gain double, hits long")
    return ranked.agg((F.sum("gain") / F.nullif(F.sum("hits"), F.lit(0))).alias("average_precision"))


def knn_vote(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(id, y, z): own group and the majority of the k nearest, ties to the smaller group."""
    votes = nearest(vectors, k).join(vectors.select(F.col("id").alias("other"), F.col("grp").alias("z")), "other").groupBy("id", "z").agg(F.count(F.lit(1)).alias("n"))
    winner = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "z")).alias("b")).select("id", F.col("b.z").alias("z"))
    return vectors.select("id", F.col("grp").alias("y")).join(winner, "id")


def macro_f1(labels: DataFrame) -> DataFrame:
    """One row: mean over true or predicted classes of 2 tp / (n_y + n_z)."""
    true = labels.groupBy(F.col("y").alias("c")).agg(F.count(F.lit(1)).alias("ny"), F.sum((F.col("y") == F.col("z")).cast("long")).alias("tp"))
    pred = labels.groupBy(F.col("z").alias("c")).agg(F.count(F.lit(1)).alias("nz"))
    both = true.join(pred, "c", "full").fillna(0, ["ny", "nz", "tp"])
    return both.agg(F.avg(2.0 * F.col("tp") / (F.col("ny") + F.col("nz"))).alias("macro_f1"))


def top_pairs(vectors: DataFrame, m: int) -> DataFrame:
    """(src, dst, score): the ``m`` largest inner products with src < dst, ties
    to the smaller pair.  A pair of blocks passes on ``m`` rows at most."""

    def meet(block: pa.Table) -> pa.Table:
        (ids, x), (others, y) = _rows_of(block, 0), _rows_of(block, 1)
        same = block.column("qb")[0].as_py() == block.column("vb")[0].as_py()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for lo, scores, error in _near_strips(x, y) if len(ids) and len(others) else ():
            own = ids[lo : lo + len(scores)]
            if same:
                scores[own[:, None] >= others[None, :]] = -np.inf
            elif np.isin(own, others).any():
                scores[own[:, None] == others[None, :]] = -np.inf
            floor = -np.inf
            if len(best[2]) == m:
                floor = best[2][-1] - error
            elif scores.size > m:
                floor = float(np.partition(scores, scores.size - m, axis=None)[scores.size - m]) - 2 * error
            floor = max(floor, -float(np.finfo(scores.dtype).max))
            some = np.flatnonzero(scores.max(axis=1) >= floor)
            row, col = np.nonzero(scores[some] >= floor)
            row = some[row]
            a, b, s = own[row], others[col], _in_order(x, lo + row, y, col)
            a, b, s = (np.concatenate(v) for v in zip(best, (np.minimum(a, b), np.maximum(a, b), s)))
            top = np.lexsort((b, a, -s))[:m]
            best = (a[top], b[top], s[top])
        return pa.table([pa.array(v) for v in best], names=["src", "dst", "score"])

    every = _plain(vectors)
    met = _block_pairs(every, every, True).groupBy("qb", "vb").applyInArrow(meet, "src long, dst long, score double")
    return first_rows(met, m, F.desc("score"), F.col("src"), F.col("dst"))


def reconstructed(vectors: DataFrame, m: int) -> DataFrame:
    """The graph of the ``m`` closest pairs, both directions, weight 2."""
    pairs = top_pairs(vectors, m).select("src", "dst", F.lit(2.0).alias("w"))
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def community_auc(vectors: DataFrame, n: int = 100_000, seed: int = 0) -> DataFrame:
    """(metric, auc): same-group pairs told from others by cosine and by dot."""
    pairs = community_pairs(vectors.select("id", "grp"), n, seed)
    joined = gathered(pairs, vectors.select("id", "vec"), "a", "b")
    cos, plain = dot(unit(F.col("va")), unit(F.col("vb"))), dot(F.col("va"), F.col("vb"))
    scored = joined.select("y", F.explode(F.array(F.struct(F.lit("cosine").alias("metric"), cos.alias("score")), F.struct(F.lit("dot").alias("metric"), plain.alias("score")))).alias("s"))
    return auc(scored.select("y", "s.metric", "s.score"), ("metric",))


def summary(df: DataFrame, by: str, value: str, resamples: int = 200, seed: int = 0, key: str | None = None) -> DataFrame:
    """(by, n, mean, sd, low, high): mean, sample deviation and a bootstrap 90 %
    interval of the mean.

    A row counts Poisson(1) times in a resample.  The counts come from the
    MD5 of the row's ``key`` (a hash of the row by default): eight resamples
    share one MD5 of 16 bits each, and sums are folded before the shuffle.
    """
    own = F.col(key).cast("string") if key else F.xxhash64(*(F.col(c) for c in df.columns)).cast("string")
    rounds = -(-resamples // 8)
    draws = df.select(by, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_g"), own.alias("_k"))
    draws = draws.withColumn("_h", F.md5(F.concat_ws("|", F.lit("bootstrap"), "_k", F.col("_g").cast("string"), F.lit(str(seed)))))

    def times(k: int) -> Column:
        u = F.conv(F.substring("_h", 4 * k + 1, 4), 16, 10).cast("int")
        return sum((F.when(u >= s, 1).otherwise(0) for s in POISSON_STEPS[1:]), F.when(u >= POISSON_STEPS[0], 1).otherwise(0))

    draws = draws.select(by, "_v", "_g", *(times(k).alias(f"_w{k}") for k in range(8)))
    sums = draws.groupBy(by, "_g").agg(*(F.sum(F.col("_v") * F.col(f"_w{k}")).alias(f"_s{k}") for k in range(8)), *(F.sum(f"_w{k}").alias(f"_n{k}") for k in range(8)))
    mean = lambda k: F.struct((F.col("_g") * 8 + k).alias("b"), (F.col(f"_s{k}") / F.nullif(F.col(f"_n{k}"), F.lit(0))).alias("m"))
    means = sums.select(by, F.inline(F.array(*map(mean, range(8))))).where(F.col("b") < resamples)
    ends = means.groupBy(by).agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"))
    plain = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return plain.join(ends, by)


def quantiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.0, 0.01, 0.999, 1.0)) -> DataFrame:
    """One row q0, q1, ..: exact quantiles with linear interpolation."""
    return df.agg(*(F.percentile(value, F.lit(q)).alias(f"q{i}") for i, q in enumerate(at)))


def binned(df: DataFrame, x: str, y: str, size: float, least: int = 5) -> DataFrame:
    """(bx, by, n): counts on a square grid, cells under ``least`` left out."""
    cell = df.groupBy(F.floor(F.col(x) / size).alias("bx"), F.floor(F.col(y) / size).alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return cell.where(F.col("n") >= least)


def hex_binned(df: DataFrame, x: str, y: str, size: float, least: int = 1, aspect: float = 1.0) -> DataFrame:
    """(cx, cy, n): counts on hexagons ``size`` wide, by their centers; fewer than ``least`` are left out.

    Centers form two rectangular lattices, ``size`` by ``size`` x sqrt 3, the
    second moved by half a step both ways; a point goes to the nearest center
    of either, the first on a tie.  ``aspect`` is what a unit of y counts in
    units of x.  Null and non-finite points are left out.
    """
    a, b = F.col(x) / size, F.col(y) * aspect / (size * 3**0.5)
    near = F.struct(F.floor(a + 0.5).alias("i"), F.floor(b + 0.5).alias("j"))
    moved = F.struct((F.floor(a) + 0.5).alias("i"), (F.floor(b) + 0.5).alias("j"))
    away = lambda c: (a - c["i"]) * (a - c["i"]) + 3 * (b - c["j"]) * (b - c["j"])
    first = away(near) <= away(moved)
    cell = F.struct(*(F.when(first, near[k].cast("double")).otherwise(moved[k]).alias(k) for k in "ij"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    counted = df.where(finite(x) & finite(y)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counted.select((F.col("c.i") * size).alias("cx"), (F.col("c.j") * (size * 3**0.5) / aspect).alias("cy"), "n")
