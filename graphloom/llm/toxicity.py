"""Toxicity: a linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios (NB-SVM), with a logistic loss.

The n-grams of a text are its strings of ``LENGTHS`` characters (code
points), ASCII lower-cased, each counted once.  The fit uses a bounded sample
of labelled rows and scales its scores to probabilities on rows that a model
of the other half has not seen; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrow_text import _power_table, flat_text, lower_ascii, slices

LENGTHS = (2, 4, 6)
BITS = 19
#: Labelled rows used for the fit, at most, of each class.
CLASS_ROWS = 4000
MIN_DOCS = 8
MIN_RATIO = 1.6


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, ASCII lower-cased, and their row boundaries.

    Bytes that are no UTF-8 make some code point too; a row starts one always.
    """
    low = lower_ascii(data)
    lead = (low & 0xC0) != 0x80
    lead[bounds[:-1][bounds[:-1] < len(low)]] = True
    starts = np.flatnonzero(lead)
    size = np.minimum(np.diff(np.append(starts, len(low))), 4)
    out = low[starts].astype(np.uint32) & np.array([0, 0xFF, 0x1F, 0x0F, 0x07], np.uint32)[size]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] = out[more] << np.uint32(6) | low[starts[more] + k] & np.uint32(0x3F)
    return out, np.searchsorted(starts, bounds)


def ngram_ids(data: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """The hashed id of the n-gram at each character, -1 where none starts."""
    size = len(data)
    out = np.full(size, -1, np.int64)
    if size < n:
        return out
    with np.errstate(over="ignore"):
        run = np.zeros(size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", size), out=run[1:])
        h = (run[n:] - run[:-n]) * _power_table("down", size + 1)[: size - n + 1]
        h ^= h >> np.uint64(32)
        h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    out[: size - n + 1] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    for back in range(1, n):
        cut = bounds[1:] - back
        out[cut[cut >= 0]] = -1
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def _solve(x: list[np.ndarray], y: np.ndarray, steps: int, ridge: float) -> Model:
    """Log-count ratios, then logistic regression on the scaled features; both
    labels weigh the same and have to be there."""
    width = 1 << BITS
    p, q = np.zeros(width), np.zeros(width)
    for own, label in zip(x, y):  # ids are distinct within a row
        (p if label else q)[own] += 1
    ratio = np.log(p + 1) - np.log(q + 1) - np.log(y.sum() + 1) + np.log((1 - y).sum() + 1)
    active = (p + q >= MIN_DOCS) & (np.abs(ratio) >= MIN_RATIO)
    number = np.full(width, -1)
    number[active] = np.arange(active.sum())
    kept = [number[own[active[own]]] for own in x]
    cols = np.concatenate(kept)
    rows = np.repeat(np.arange(len(kept)), [len(v) for v in kept])
    scale = ratio[active]
    m = len(scale)
    w, b = np.zeros(m), 0.0
    m1, m2, g1, g2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=(w * scale)[cols], minlength=len(y)) + b
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(cols, weights=err[rows], minlength=m) * scale + ridge * w
        gb = err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        g1, g2 = 0.9 * g1 + 0.1 * gb, 0.999 * g2 + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w -= rate * m1 / (np.sqrt(m2) + 1e-8)
        b -= rate * g1 / (np.sqrt(g2) + 1e-8)
    weights = np.zeros(width, np.float32)
    weights[active] = w * scale
    return Model(weights, float(b))


def _scaled(z: np.ndarray, y: np.ndarray, share: float, steps: int = 50) -> tuple[float, float] | None:
    """(slope, offset) of a logistic fit of ``y`` on the scores ``z``, the
    labels weighing as their true shares; None where it has no use."""
    own = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    both, at = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, np.log(share / (1 - share))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(both @ at, -30, 30)))
        curve = (both * (own * p * (1 - p))[:, None]).T @ both + 1e-6 * np.eye(2)
        at = at - np.clip(np.linalg.solve(curve, both.T @ (own * (p - aim))), -1, 1)
    return (float(at[0]), float(at[1])) if at[0] > 0 and np.isfinite(at).all() else None


def _train(x: list[np.ndarray], y: np.ndarray, share: float, steps: int = 300, ridge: float = 1e-3) -> Model:
    """The model of all rows, its scores scaled to probabilities by what models
    of either half give on the other; a hash of the features deals the halves,
    so that copies stay together."""
    s = min(max(share, 1e-6), 1 - 1e-6)
    prior = float(np.log(s / (1 - s)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), prior)
    model = _solve(x, y, steps, ridge)
    half, z, found = np.array([zlib.crc32(own.tobytes()) & 1 for own in x]), np.zeros(len(y)), None
    if all(0 < y[half == k].sum() < (half == k).sum() for k in (0, 1)):
        for k in (0, 1):
            other = _solve([own for own, h in zip(x, half) if h != k], y[half != k], steps, ridge)
            z[half == k] = [other.weights[own].sum() + other.bias for own, h in zip(x, half) if h == k]
        found = _scaled(z, y, s)
    slope, offset = found or (1.0, prior)
    return Model((model.weights * slope).astype(np.float32), model.bias * slope + offset)


def fit(labelled: DataFrame, class_rows: int = CLASS_ROWS, share: float | None = None) -> Model:
    """Fit on ``labelled(row_id long, text, label)``.

    At most ``class_rows`` rows of each label take part: those with the
    smallest hashes of their id.  They meet in one task; the driver gets the
    weights only.  Null labels are ignored.  ``share`` is the share of label 1
    among all labelled rows, counted if not given.  With one label only,
    every text scores that share.
    """
    known = labelled.where("label is not null")
    if share is None:
        ones, rows = known.agg(F.count_if(F.col("label") == 1), F.count(F.lit(1))).first()
        share = ones / rows if rows else 0.0
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("row_id"), "row_id").limit(class_rows) for v in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            data, bounds = characters(*flat_text(batch.column(0)))
            for i in range(batch.num_rows):
                own, at = data[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]])
                ids = np.concatenate([ngram_ids(own, at, n) for n in LENGTHS])
                x.append(np.unique(ids[ids >= 0]).astype(np.int32))
            y += batch.column(1).to_pylist()
        model = _train(x, np.array(y, float), share)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["w", "b"])

    sample = parts[0].unionByName(parts[1]).select(F.col("text").cast("string").alias("text"), F.col("label").cast("double").alias("label"))
    got = sample.repartition(1).mapInArrow(run, "w binary, b double").collect()
    return Model(np.frombuffer(got[0]["w"], np.float32), got[0]["b"]) if got else _train([], np.zeros(0), share)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; a null or empty text gets the bias alone."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_text(batch.column(1))
            z = np.full(batch.num_rows, bias)
            for lo, hi in slices(bounds):
                part, at = characters(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                seen = []
                for n in LENGTHS:
                    ids = ngram_ids(part, at, n)
                    hit = np.flatnonzero((weights[ids] != 0) & (ids >= 0))
                    row = np.searchsorted(at, hit, side="right") - 1
                    seen.append((row << BITS) | ids[hit])
                pairs = np.unique(np.concatenate(seen))
                z[lo:hi] += np.bincount(pairs >> BITS, weights=weights[pairs & (1 << BITS) - 1], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[id_col, "score"])

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(run, f"{id_col} long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", class_rows: int = CLASS_ROWS) -> DataFrame:
    """(id, held_out, score) of every row of ``docs``.

    Labels are learnt only from rows whose crc32 of the id as text, modulo
    ``folds``, is not ``held``; ids and other columns never feed a score.
    The bounded sample of labels is taken first, so that only its texts are
    looked up.  A null id is not held out.
    """
    fold = lambda c: F.crc32(F.col(c).cast("long").cast("string").cast("binary")) % folds
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.where(fold("label_id") != held)
    ones, rows = known.agg(F.count_if(F.col("label") == 1), F.count(F.lit(1))).first()
    picked = [known.where(F.col("label") == v).orderBy(F.xxhash64("label_id"), "label_id").limit(class_rows) for v in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text")).join(sample, "label_id")
    model = fit(texts.select(F.col("label_id").alias("row_id"), "text", "label"), class_rows, ones / rows if rows else 0.0)
    scored = scores(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(fold(id_col) == held, F.lit(False)).alias("held_out"), "score")
