"""The registered queries of packing, toxicity and language-model scores against brute force."""

import collections
import heapq
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import kneser_ney, queries, toxicity
from texts import corpus, prose


@pytest.fixture(scope="module")
def table_rows():
    rng = random.Random(11)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 410]
    return rows + [(600 + i, prose(rng, n)) for i, n in enumerate((700, 900, 1500, 2500, 4000, 30, 30))]


@pytest.fixture(scope="module")
def folder(spark, table_rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("registered"))
    rng = random.Random(6)
    spark.createDataFrame(table_rows, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(rng.random() < 0.7), int(rng.random() < 0.4)) for i, _ in table_rows[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_op8(spark, folder, table_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in table_rows}
    assert sum(len(x) > 2048 for x in ids.values()) >= 3
    got = queries.QUERIES["op8_packing"](spark, folder).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        lengths = [r.length for r in rows]
        assert [r.piece for r in rows] == list(range(len(rows))) and sum(lengths) == len(ids[i]) and len(rows) == -(-len(ids[i]) // 2048)
        assert all(n == 2048 for n in lengths[1:]) and [r.start for r in rows] == [sum(lengths[:k]) for k in range(len(rows))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 2048
    # best fit, one piece after the other, longest first
    rooms: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(2048 - n)
    assert len(by_sequence) == len(rooms) >= -(-sum(map(len, ids.values())) // 2048)
    assert heapq.nsmallest(1, rooms)[0] >= 0


def test_op6(spark, folder, table_rows):
    texts = dict(table_rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if not held(r.doc_id)]
    known = spark.createDataFrame([(i, texts[i], y) for i, y in labels], "row_id long, text string, label int")
    model = toxicity.fit(known, toxicity.CLASS_ROWS, sum(y for _, y in labels) / len(labels))

    def ids(text):
        data = np.array([ord(c) for c in (text or "").encode().lower().decode()], np.uint32)
        return {int(x) for k in toxicity.LENGTHS for x in toxicity.ngram_ids(data, np.array([0, len(data)]), k) if x >= 0}

    got = queries.QUERIES["op6_toxicity"](spark, folder).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: held(i) for i in texts}
    for r in got:
        z = model.bias + sum(float(model.weights[g]) for g in ids(texts[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-max(min(z, 500), -500)))) < 1e-5 and r.predicted == int(r.score >= 0.5)
    # labels of held-out rows are never read
    other = spark.read.parquet(f"{folder}/labels.parquet").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.classify(spark.read.parquet(f"{folder}/documents.parquet"), other).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in got}


def test_op5_score(spark, folder, table_rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    grams = lambda x: list(zip(["<", "<", *x], ["<", *x], x))
    three = collections.Counter(g for i, t in table_rows if zlib.crc32(str(i).encode()) % 7 != 2 for g in grams(tokens(t)))
    uni = collections.Counter()
    for (_, _, c), n in three.items():
        uni[c] += n
    two = collections.Counter((b, c) for _, b, c in three)
    one = collections.Counter(c for _, c in two)
    off = lambda counts: [0, *kneser_ney.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])]
    d3, d2, d1 = off(three), off(two), off(one)

    def tally(counts):
        total, spare = collections.Counter(), collections.Counter()
        d = off(counts)
        for g, c in counts.items():
            total[g[:-1]] += c
            spare[g[:-1]] += d[min(c, 3)]
        return total, spare

    (t3, s3), (t2, s2) = tally(three), tally(two)
    rest = sum(d1[min(c, 3)] for c in one.values()) / len(two) / (len(uni) + 1)

    def p(g):
        out = max(one[g[2]] - d1[min(one[g[2]], 3)], 0) / len(two) + rest
        for counts, d, total, spare, key in ((two, d2, t2, s2, g[1:]), (three, d3, t3, s3, g)):
            if total[key[:-1]]:
                out = (max(counts[key] - d[min(counts[key], 3)], 0) + spare[key[:-1]] * out) / total[key[:-1]]
        return out

    got = {r.doc_id: r for r in queries.QUERIES["op5_lm_scoring"](spark, folder).collect()}
    for i, t in table_rows:
        assert abs(got[i].score - sum(math.log10(p(g)) for g in grams(tokens(t)))) < 1e-5
