"""Quality, toxicity, packing, PII, the pipeline and the registered queries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import packing, pii, resampling, toxicity

from texts import prose


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        junk, rude = i % 5 == 0, i % 7 == 0
        text = prose(rng, 60)
        if rude:
            text = text.replace(" ", " stupid idiot ", 2)
        if junk:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(not junk), int(rude)))
    rows += [(900, None), (901, ""), (902, prose(rng, 30)), (902, prose(rng, 30)), (None, prose(rng, 30))]
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("selected", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(judged, nothing):
    docs, labels = judged
    got = resampling.classify(docs, labels).collect()
    assert len(got) == docs.count()
    kept = collections.Counter((r.doc_id % 5 == 0, r.selected) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert kept[False, True] > 310 and kept[True, False] > 75
    assert all(r.log_weight == 0 for r in got if r.doc_id in (900, 901))
    stay = resampling.keep_sampled(docs, labels)
    assert stay.columns == docs.columns and abs(stay.count() - sum(r.selected for r in got)) <= 1
    assert resampling.classify(docs.limit(0), labels).count() == 0
    assert resampling.classify(docs, labels.limit(0)).where("selected").count() == docs.count()


def test_gumbel_top_k(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("double").alias("log_weight"))
    for k in (0, 1, 37, 499, 500, 900):
        got = resampling.resample(df, k, 1.0).collect()
        best = sorted(got, key=lambda r: -r.key)[: min(k, 500)]
        assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in best}
    ties = spark.createDataFrame([(i, 0.0) for i in (4, 4, 4, None, 7)], "doc_id long, log_weight double")
    assert [resampling.resample(ties, k, 1.0).where("selected").count() for k in range(6)] == [0, 1, 2, 3, 4, 5]


def test_hashed_ngrams_brute_force():
    texts = ["Ab, cd%%% e", "", "x", "a b a b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t) for t in texts)])
    grams, rows = resampling.hashed_ngrams(data, bounds)
    tokens = [re.findall(r"[a-z0-9]+|[^\sa-z0-9]+", t.lower()) for t in texts]
    assert np.bincount(rows, minlength=4).tolist() == [max(0, 2 * len(t) - 1) for t in tokens]
    last = grams[rows == 3]
    assert len(set(last[:4].tolist())) == 2 and len(set(last[4:].tolist())) == 2


def test_toxicity(judged, nothing):
    docs, labels = judged
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score >= 0.5, r.doc_id % 7 == 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert {round(r.score, 3) for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_packing(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    extra = docs.sparkSession.createDataFrame([(990, "a<|endoftext|>b"), (991, "word " * 5000)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(extra)
    got = packing.pack(all_docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    want = collections.Counter()
    for i, t in [*rows, (990, "a<|endoftext|>b"), (991, "word " * 5000)]:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for slots in bins.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(slots[-1]) <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(nothing, path).count() == 0


def test_plan_equals_best_fit_one_by_one():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([7, 30, 100])
        histogram = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        rooms = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fit = [r for r in rooms if r >= length]
                if fit:
                    rooms.remove(min(fit))
                    rooms.append(min(fit) - length)
                else:
                    rooms.append(cap - length)
        runs = packing.plan_runs(histogram, cap)
        assert max(r.first + r.bins for r in runs) == len(rooms)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accept(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        twice = [int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c) for k, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(twice) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_pii_brute_force(spark, docs, rows):
    rng = random.Random(3)
    bits = ["a@b.co", "a@b.co_x@y.zz", "x@@y.z", "@a.b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1", "+12 ()", "+49 30.1234567 8", "12 34", " ", "é", "🙂", "token = \"0123456789abcdef0123456789abcdef\"", "word", ".", "-", "9" * 30, "a.b@c.d.e.f-g", "%+-@x.y"]
    cases = [(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    cases += [(500 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for k in range(300)]
    cases += [(900, None), (901, ""), (902, "a" * 50000), (903, "1" * 50000), (904, "a@" + "b." * 20000 + "c"), (905, "+1" + "-" * 50000), (None, "a@b.co")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = pii.detect(df.repartition(4)).select("doc_id", pii.digest(F.col("base")).alias("b"), "base", "added").collect()
    want = collections.Counter((i, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, t or "") if accept(k, m.group()))) for i, t in cases)
    assert collections.Counter((r.doc_id, r.b) for r in got) == want
    for r in got:
        assert not any(a.start < b.end and b.start < a.end for a in r.added for b in r.base)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[900] is None and clean[901] == "" and clean[902] == "a" * 50000
    assert pii.detect(df.limit(0)).count() == 0
    plan = pii.detect(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_numbers_side_by_side(spark):
    rng = random.Random(4)

    def card(good):
        while True:
            d = "".join(str(rng.randrange(10)) for _ in range(16))
            if accept("card", d) == good:
                return d

    phone = lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randint(100, 255)) for _ in range(4))
    cases = [(k, f"x {card(True)} {card(True)} y") for k in range(40)]
    cases += [(100 + k, f"x {phone()} {ip()} y") for k in range(40)]
    cases += [(200 + k, f"x {card(False)} y") for k in range(40)]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert all(not re.search("[0-9]", t) for i, t in clean.items() if i < 200)
    assert all(t == dict(cases)[i] for i, t in clean.items() if i >= 200)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "x a@b.co y 1.2.3.4 z"), (2, "🙂 +1 (555) 123-4567")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df, pii.Boosted(0.0, [], [float("inf")] * 3)).collect()} == {1: "x [email] y [ip] z", 2: "🙂 [phone]"}


def test_boosting_learns_a_rule():
    cells = np.array([[1 + k % 3, a, b, 0, 0, 0, 0, 0, 0, 0, 0] for k in range(3) for a in range(4) for b in range(4)])
    pos = np.array([10.0 if c[1] >= 2 else 0.0 for c in cells])
    model = pii.boost(cells, pos, np.full(len(cells), 10.0))
    assert all(np.isfinite(model.thresholds))
    assert pii.boost(cells[:0], pos[:0], pos[:0]).thresholds == [float("inf")] * 3


def test_pipeline_stages(docs, tmp_path, spark):
    import corpus_pipeline

    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect() if r.doc_id is not None]
    docs.sparkSession.createDataFrame([(i, 1, 0) for i in ids[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    at = plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == plain.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0, name


def test_base_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
