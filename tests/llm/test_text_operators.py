"""SimHash, suffix dedup, BPE, language model and media against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, exact_topk, kneser_ney, media, simhash, suffix_dedup


def brute_print(text):
    words = (text or "").encode().lower().split()
    spans = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [(i, brute_print(t)) for i, t in rows]
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == collections.Counter(prints)
    group = {p: {p} for _, p in prints}
    for a in list(group):
        for b in list(group):
            if bin(a ^ b).count("1") <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    for r in got:
        ids = [i for i, p in prints if p in group[r.fp & (1 << 64) - 1] and i is not None]
        assert r.component_id == (min(ids) if ids else None)


def test_simhash_hot_values(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 16)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = set()
    for s in seeds:
        for _ in range(80):
            prints.add(int(s) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    from graphloom.llm.components import components

    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 4:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    classes = collections.defaultdict(set)
    for p in prints:
        classes[find(p)].add(root.get(sign(p), sign(p)))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_similar_texts_and_one_of_each(docs, rows, nothing):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {100 + k for k in range(0, 20, 2)}
    assert len([t for t in texts if t]) == len({t for t in texts if t})
    assert simhash.one_of_each(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("hot", [4096, 8])
def test_similar_texts_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(8)
    texts = []
    for n in (5, 9, 30, 60, 104, 200, 400):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(words))
            for changes in (1, 1, 2, 3, 4, 5, 8):
                for at in rng.sample(range(n), min(n, changes)):
                    words[at] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(words))
    line = " ".join(f"c{k}" for k in range(30))
    texts += [f"{line} e{k}" for k in range(40)] + [f"{line} " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(40)) for k in range(40)]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            near += 0.7 < both / (len(sets[a]) + len(sets[b]) - both) < 0.9
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert near > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.first_id for r in simhash.similar_texts(df).collect()}
    assert got == {k: find(k) for k in range(len(texts))}


def test_similar_texts_in_other_scripts(spark):
    words = [f"größe{k} été{k} ñu{k} мир{k}" for k in range(30)]
    text = " ".join(words)
    rows = [(0, text), (1, text.upper()), (2, text.replace(" ", "\u00a0")), (3, text.replace(" ", "\u2003").title()), (4, "Ö"), (5, "ö"), (6, "o"), (7, "\u00a0"), (8, "")]
    got = {r.doc_id: r.first_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lower = [" ".join(t.lower().split()) for _, t in rows]
    assert got[2] == got[3] == 0 and got[4] == got[5] == 4
    assert got == {i: lower.index(x) for i, x in enumerate(lower)}


@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup_brute_force(docs, rows, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(suffix_dedup, "MIXED", 3)  # every name with several contents goes window by window
        monkeypatch.setattr(suffix_dedup, "SAME", 1)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    want = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


def test_suffix_dedup_orders_stretches_of_whole_routes(docs, monkeypatch):
    route, sizes = np.array([1, 1, 2, 3, 3, 3, 4, 9], np.uint64), np.array([60, 60, 50, 90, 90, 90, 50, 50])
    assert [x.tolist() for x in suffix_dedup._stretches(route, sizes, 150)] == [[0, 1, 2], [3, 4, 5], [6], [7]]
    whole = sorted(map(str, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "ORDER_BYTES", 300)
    assert sorted(map(str, suffix_dedup.remove_repeats(docs).collect())) == whole


def test_suffix_dedup_names_short_matches_apart():
    """A phrase of 16 bytes is too short for a window and makes no names meet."""
    rng, phrase = np.random.default_rng(3), b"sixteen bytes in"
    names = []
    for _ in range(2):
        text = b"".join(rng.integers(33, 127, 60).astype(np.uint8).tobytes() + phrase for _ in range(200))
        seg, _ = suffix_dedup.winnow(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50)
        names.append(set(seg.name.tolist()))
    assert len(names[0]) > 500 and not names[0] & names[1]


@pytest.mark.parametrize("length", [24, 27, 28])
def test_suffix_dedup_short_windows(spark, length):
    texts = ["the quick brown fox jumps over the lazy dog " * 2, "say that the quick brown fox jumps over it", "x" * 80, "y" + "x" * 40, "a short one"]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=length)
    first = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    want = {i: len({q for p in range(len(t) - length + 1) if first[t[p : p + length]] < i for q in range(p, p + length)}) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_removed for r in out.collect()} == want


def test_suffix_dedup_rows(docs, nothing):
    out = suffix_dedup.remove_repeats(docs, whole_rows=True)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_runs_again_on_mistaken_prints(docs, rows, monkeypatch):
    calls = []
    plain = suffix_dedup._find_cover
    monkeypatch.setattr(suffix_dedup, "_find_cover", lambda *a, **k: calls.append(k) or (plain(*a, **k) and bool(k)))
    again = suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0]
    assert calls == [{}, {"all_bytes": True}]
    monkeypatch.undo()
    assert again == suffix_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0]


def test_bpe_round_trip(docs, rows, nothing):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    want = collections.Counter((i, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode_documents(nothing, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 2000)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for _, t in rows)


def test_bpe_shares_pieces_between_fine_partitions(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TASK_BYTES", 1 << 30)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    cores = spark.sparkContext.defaultParallelism
    fine = docs.repartition(3 * max(8, 2 * cores))
    got = byte_bpe.encode_documents(fine, ranks, public_tokenizers.PATTERN)
    assert got.rdd.getNumPartitions() == max(8, 2 * cores)
    assert sorted(bytes(r.decoded) for r in got.collect()) == sorted((t or "").encode() for _, t in rows)


def test_bpe_edges_of_the_fold(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"..": 260, b"aaaa": 261}
    plain = tiktoken.Encoding("t", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    texts = ["a", "ab", "xabc", "abcx", "aaaaa", "....", ".|.", "bcab", "é", "aabcaab", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode_documents(docs, ranks, r"(?s).+").collect()}
    assert got == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("order", "parts", "finer"), [(3, None, 1), (3, 3, 2000), (2, None, 1), (2, 3, 2000)])
def test_language_model_brute_force(docs, rows, nothing, monkeypatch, order, parts, finer):
    """A finer share than a part's makes many words and pairs heavy."""
    heavy_keys = kneser_ney.heavy_keys
    monkeypatch.setattr(kneser_ney, "heavy_keys", lambda texts, parts, order: heavy_keys(texts, finer * parts, order))
    train = docs.where(~kneser_ney.held_out())
    model = kneser_ney.fit(train, parts=parts, order=order)
    if finer > 1:
        assert len(model.heavy_words) > 20 and len(model.heavy_pairs) > 20 and (order == 2 or model.pair_counts.max() > 1)
    got = kneser_ney.scores(docs, model).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    grams = lambda x: list(zip((["<", "<"] + x if order == 3 else ["<"] * len(x)), ["<"] + x, x))
    uni, tri = collections.Counter(), collections.Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            x = tokens(t)
            uni.update(x)
            tri.update(grams(x))
    bi = collections.Counter((b, c) for _, b, c in tri)
    pre = collections.Counter(c for _, c in bi)
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.vocabulary, model.bigrams) == (n, v, len(bi))

    def level(counts):
        d = [0, *kneser_ney.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])]
        total, seen = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for g, c in counts.items():
            total[g[:-1]] += c
            seen[g[:-1]][min(c, 3) - 1] += 1

        def mixed(g, low):
            if not total[g[:-1]]:
                return low
            return (max(counts[g] - d[min(counts[g], 3)], 0) + sum(x * y for x, y in zip(d[1:], seen[g[:-1]])) * low) / total[g[:-1]]

        return mixed

    top, middle = level(tri), level(bi)
    du = [0, *kneser_ney.discounts([sum(c == k for c in pre.values()) for k in (1, 2, 3, 4)])]
    back = sum(du[min(c, 3)] for c in pre.values()) / len(bi)

    def p(g):
        low = max(pre[g[2]] - du[min(pre[g[2]], 3)], 0) / len(bi) + back / (v + 1)
        return top(g, middle(g[1:], low) if order == 3 else low)

    want = collections.Counter()
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x)
        want[i, len(x), sum(uni[w] > 0 for w in x), round(base, 5), round(sum(math.log10(p(g)) for g in grams(x)), 5)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert abs(sum(p(("<", "<", w)) for w in uni) + p(("<", "<", "never seen")) - 1) < 1e-9
    if parts is None:
        empty = kneser_ney.fit(nothing, order=order)
        assert all(math.isfinite(r.score) for r in kneser_ney.scores(docs, empty).collect())
        assert kneser_ney.scores(nothing, model).count() == 0


def test_media_round_trip(docs, rows, nothing):
    got = media.store_texts(docs).collect()
    want = collections.Counter((i, media.pad((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.payload)) for r in got) == want
    assert {r.kind for r in got} <= {"audio/wav", "image/bmp", "audio/basic"} and media.store_texts(nothing).count() == 0


def test_sniffing_corrects_and_carves(spark):
    import gzip
    import struct

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab")) + chunk(b"IEND", b"")
    bmp = b"BM" + struct.pack("<IIIIiiHHI", 54 + 8, 0, 54, 40, 2, 1, 1, 24, 0) + bytes(20) + bytes(8)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    zipped = gzip.compress(b"text" * 50)
    parts = [media.to_wav(b"x" * 5), png, bmp, gif, zipped]
    blob = b"junk RIFF BM GIF8 " + b"--".join(parts) + b"\xff\xd8\xff tail"
    rows = [(1, blob, "text/plain"), (2, png, "image/jpeg"), (3, None, "image/png"), (4, b"", None), (5, png[:-3], "image/png")]
    got = {r.id: r for r in media.sniff_column(spark.createDataFrame(rows, "id long, raw binary, t string"), "id", "raw", "t").collect()}
    assert [blob[m.start : m.end] for m in got[1].media] == parts and got[1].kind is None
    assert got[2].kind == "image/png" and got[2].corrected
    assert not got[3].media and not got[4].media and not got[5].media


@pytest.mark.parametrize("dims", [3, 20])
def test_exact_topk_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=dims), 1)]) for i in range(700)]
    rows += [(50, None), (701, [None] * dims), (702, [float("nan")] * dims), (703, [float("inf")] * dims), (704, [0.0] * dims), (705, rows[3][1]), (None, rows[4][1])]
    rows = [r for r in rows if r != (50, None)] + [(750, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((int(good[q] @ v), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == [(i, s) for s, i in best]
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0).count() == 1
