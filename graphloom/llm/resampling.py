"""Quality classification by importance resampling (DSIR).

Two bag-of-n-gram models over hashed buckets are counted: one of target
texts, one of all raw texts.  A document's log importance weight is the
sum over its unigrams and bigrams of log p_target - log p_raw.  Adding
Gumbel noise and keeping the k largest keys samples k documents without
replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.arrow_text import flat_text, lower_ascii, mix64, slices, span_hashes
from graphloom.llm.shared import cut_lineage, spare

BUCKETS = 1 << 14
TARGET_ROWS = 20_000

_KIND = np.full(256, 1, np.uint8)
_KIND[0x21:0x7F] = 2
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_lo:_hi] = 1
_KIND[:0x21] = 0
_KIND[0x7F] = 0


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, and runs of punctuation, as tokens."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    kind = _KIND[data]
    change = np.zeros(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[bounds] = True
    change[0] = change[n] = True
    cuts = np.flatnonzero(change)
    starts, ends = cuts[:-1], cuts[1:]
    ink = kind[starts] > 0
    starts, ends = starts[ink], ends[ink]
    return starts, ends, np.searchsorted(starts, bounds)


def hashed_ngrams(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams with the row of each."""
    starts, ends, first = _tokens(data, bounds)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    one = span_hashes(lower_ascii(data), starts, ends)
    with np.errstate(over="ignore"):
        two = mix64(one[:-1] * np.uint64(0x9FB21C651E98DF25) + one[1:])
    same = rows[1:] == rows[:-1]
    both = np.concatenate([one, two[same]])
    return ((both >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[:-1][same]])


def ngram_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all n-grams of a text column, per bucket.

    Each task sends at most one row a bucket; what reaches the driver is
    bounded by the number of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, bounds = flat_text(batch.column(0))
            for lo, hi in slices(bounds):
                part, at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                total += np.bincount(hashed_ngrams(part, at, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


@dataclass(frozen=True)
class RatioModel:
    """Log ratios per bucket and the share of target documents."""

    log_ratio: np.ndarray
    share: float


def fit(target: DataFrame, raw: DataFrame, share: float, text_col: str = "text", prior: float = 200.0, buckets: int = BUCKETS) -> RatioModel:
    """Count both generative models.

    Both get ``prior`` pseudo-counts a bucket at the size of the target, so
    that a target sample says nothing about n-grams it would hardly show.
    Without target texts all ratios are 0.
    """
    t, r = ngram_counts(target, text_col, buckets), ngram_counts(raw, text_col, buckets)
    if not t.sum():
        return RatioModel(np.zeros(buckets), share)
    # the occurrence being weighed is itself in the raw counts: it is left out of them
    expected = t.sum() * np.maximum(r - 1, 0) / max(r.sum() - 1, 1)
    return RatioModel(np.log(t + prior) - np.log(expected + prior), share)


def log_weights(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """(id, n_features, log_weight) for every row; no features: weight 0.

    With ``whole_rows`` all columns of ``docs`` stay and the weight is added
    to them as the last one, under a name that is free.
    """
    ratio = model.log_ratio
    text_at = docs.columns.index(text_col) if whole_rows else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat_text(batch.column(text_at))
            counts, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for lo, hi in slices(bounds):
                part, at = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
                grams, rows = hashed_ngrams(part, at, len(ratio))
                counts[lo:hi] = np.bincount(rows, minlength=hi - lo)
                sums[lo:hi] = np.bincount(rows, weights=ratio[grams], minlength=hi - lo)
            if whole_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[f"c{k}" for k in range(batch.num_columns + 1)])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(sums)], names=[id_col, "n_features", "log_weight"])

    if whole_rows:
        carried = docs.select(*((F.col(c).cast("string") if k == text_at else F.col(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)))
        schema = T.StructType([*carried.schema.fields, T.StructField(f"c{len(docs.columns)}", T.DoubleType())])
        return carried.mapInArrow(run, schema).toDF(*docs.columns, spare(docs.columns, "log_weight"))
    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return source.mapInArrow(run, f"{id_col} long, n_features long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the key and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, col: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a long column and how many equal it must be
    taken, by four rounds of counting 16 bits each (65,536 rows at most)."""
    prefix, need = None, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(F.col(col).bitwiseXOR(F.lit(-(1 << 63))), shift).alias("head")
        heads = df.select(digit)
        if prefix is not None:
            heads = heads.where(F.shiftrightunsigned("head", 16) == F.lit(prefix))
        counts = sorted(((int(r["head"]) & 0xFFFF, r["n"]) for r in heads.groupBy("head").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for low, n in counts:
            if n >= need:
                prefix = low if prefix is None else (prefix << 16) | low
                if prefix >= 1 << 63:
                    prefix -= 1 << 64
                break
            need -= n
    return (prefix & (1 << 64) - 1) - (1 << 63), need


def sortable(value: Column) -> Column:
    """A long that orders like the double: fixed point with 2**-20 steps."""
    return F.round(F.least(F.greatest(value, F.lit(-4e12)), F.lit(4e12)) * float(1 << 20)).cast("long")


def resample(weighted: DataFrame, k: int | None, share: float, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds ``key`` and ``selected``: the Gumbel top-k of the log weights.

    Without ``k`` it is the number of documents that are target documents
    more likely than not: share * weight >= 1/2.  Equal keys are taken by
    smaller id (null first), then as they come.
    """
    noisy = cut_lineage(weighted.withColumn("key", F.col("log_weight") + gumbel(F.col(id_col), seed)).withColumn("order", sortable(F.col("key"))))
    total = noisy.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= F.lit(float(np.log(0.5 / max(share, 1e-12))))))
    n, likely = total.first()
    k = min(n, likely if k is None else max(0, k))
    if k in (0, n):
        return noisy.withColumn("selected", F.lit(k > 0)).drop("order")
    value, ties = kth_largest(noisy, "order", k)
    above = noisy.withColumn("selected", F.col("order") > F.lit(value)).where(F.col("order") != F.lit(value))
    level = noisy.where(F.col("order") == F.lit(value))
    taken = level.orderBy(F.col(id_col).asc_nulls_first()).limit(ties).select(F.col(id_col).alias("taken"))
    counted = taken.groupBy("taken").agg(F.count(F.lit(1)).alias("quota"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(id_col).orderBy("log_weight"))
    at_level = level.join(counted, level[id_col].eqNullSafe(counted["taken"]), "left").withColumn("place", place)
    at_level = at_level.withColumn("selected", F.coalesce(F.col("place") <= F.col("quota"), F.lit(False)))
    return above.unionByName(at_level.select(above.columns)).drop("order")


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> RatioModel:
    """The model of ``docs`` with at most ``target_rows`` texts labelled
    ``quality = 1`` (smallest hashes of the id) as target."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("q"))
    good, rows = known.agg(F.count_if(F.col("q") == 1), F.count(F.lit(1))).first()
    picked = known.where("q = 1").select("label_id").distinct().orderBy(F.xxhash64("label_id"), "label_id").limit(target_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    return fit(texts.join(F.broadcast(picked), "label_id", "left_semi"), texts, good / rows if rows else 1.0, "text")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, seed: int = 42) -> DataFrame:
    """(id, n_features, log_weight, key, selected) for every row of ``docs``.

    The target model is counted on at most ``target_rows`` texts labelled
    ``quality = 1`` (smallest hashes of the id); the raw model and the
    weights cover every text.  Null labels are ignored; with no labels every
    document has weight 0 and is selected.  Null and empty texts have no
    features and weight 0.  The noise of a row hangs on its id: rows with one
    id share a draw (null ids too), so that repeated rows are taken together
    unless the k-th key falls among them.
    """
    model = fit_on_labels(docs, labels, id_col, text_col, target_rows)
    return resample(log_weights(docs, model, id_col, text_col), None, model.share, id_col, seed)


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that ``classify`` selects, with all their columns.

    The key of the k-th document is found on keys alone; then texts are
    weighed once more as they pass, so they are never shuffled.  Rows level
    with the k-th key all stay.
    """
    model = fit_on_labels(docs, labels, id_col, text_col, target_rows)
    order = lambda weight: sortable(F.col(weight) + gumbel(F.col(id_col), seed))
    keys = cut_lineage(log_weights(docs, model, id_col, text_col).select("log_weight", order("log_weight").alias("order")))
    n, likely = keys.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") >= F.lit(float(np.log(0.5 / max(model.share, 1e-12)))))).first()
    if likely in (0, n):
        return docs if likely else docs.limit(0)
    value, _ = kth_largest(keys, "order", likely)
    weighed = log_weights(docs, model, id_col, text_col, True)
    return weighed.where(order(weighed.columns[-1]) >= F.lit(value)).select(docs.columns)
