"""Added spans of personal data against brute force, and long texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii

MAIL = r"(?<![^\s@<>,;|])[^\s@<>,;|]+@[^\s@<>,;|]+"
NUMBER = r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}"
TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{24,}"

TEXTS = [
    "write to <a.b@c> or tel +1 (555) 123-4567 ext 44 55 66 77 88 99 00 11 22 33",
    "api_key = 'abcdef0123456789ABCDEF0123456789', seen 4111 1111 1111 1111 12 34",
    "call +49 (0)30.1234-5678 90 then (12)34 56 78 90 12 34 56 78",
    "x@y z@@w a@b@c, 10.0.0.1 1.2.3.4.5.6.7 user@host.example.org|other@host",
    "12 " * 60,
    "Größe 東京 mail: jo@ex.org 🙂 token: deadbeefdeadbeefdeadbeefdeadbeef99",
    "",
    None,
]


def proposed(text):
    out = [("contact", m.start(), m.end()) for m in re.finditer(MAIL, text)]
    for m in re.finditer(NUMBER, text):
        out.append(("number", m.start(), m.end()))
        s = m.group()
        groups = [g.span() for g in re.finditer("[0-9]+", s)]
        for i, (a, _) in enumerate(groups):
            plus = i == 0 and s.startswith("+")
            first = 0 if plus else a
            for _, b in groups[i : i + 19]:
                n = len(re.sub("[^0-9]", "", s[first:b]))
                if b - first < len(s) and (8 <= n <= 15 if plus else 16 <= n <= 19):
                    out.append(("number", m.start() + first, m.start() + b))
    return out + [("secret", m.start(), m.end()) for m in re.finditer(TOKEN, text)] if re.search("[0-9]", text) else [x for x in out if x[0] == "contact"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_candidates(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", pii.candidates(F.col("t")).alias("c")).collect()
    for r in rows:
        assert sorted((c.kind, c.start, c.end) for c in r.c) == sorted(proposed(r.t))
        for c in r.c:
            before = r.t[: c.start]
            assert c.text == r.t[c.start : c.end] and before.lower().endswith(c.before)


class Everything:
    """Accepts every candidate."""

    def accepts(self, values):
        return F.lit(True)


def test_added_spans(docs):
    for r in pii.detect(docs, Everything()).collect():
        base = [(s.start, s.end) for s in r.base]
        clear = [c for c in proposed(r.text or "") if not any(a < c[2] and c[1] < b for a, b in base)]
        outer = [c for c in clear if not any(d[1] <= c[1] and c[2] <= d[2] and d[2] - d[1] > c[2] - c[1] for d in clear)]
        assert sorted((s.kind, s.start, s.end) for s in r.added) == sorted(outer)


def test_folds_in_chunks(spark):
    rows = spark.range(5).select("id", F.when(F.col("id") > 0, F.sequence(F.lit(1), (F.col("id") * 100).cast("int"))).otherwise(F.array().cast("array<int>")).alias("xs"))
    for r in rows.select("xs", pii.scanned(F.col("xs"), F.lit(0).cast("long"), lambda at, x: at + x).alias("sums")).collect():
        assert r.sums == [sum(r.xs[:k]) for k in range(len(r.xs))]


@pytest.mark.parametrize("text", ["12 " * 10_000, "a@b.co, " * 20_000, "7" * 300_000, "+1 (555) 123-4567 " * 10_000])
def test_long_texts(spark, text):
    model = pii.Boosted(0.0, [], [0.0] * 3)
    began = time.time()
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).select(F.size("base").alias("b"), F.size("added").alias("a")).first()
    assert time.time() - began < 90 and row.b + row.a > 0
