"""The ``opN_*`` queries: thin digests of the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.resampling import classify

    sampled = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sampled.select("doc_id", "n_features", "log_weight", "key", "selected")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm import byte_bpe

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, packed=True)
    return byte_bpe.digests(encoded)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import kneser_ney

    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.fit(docs.where(~kneser_ney.held_out()))
    scored = kneser_ney.scores(docs, model)
    return scored.select("doc_id", kneser_ney.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.media import store_texts

    stored = store_texts(table(spark, sf_dir, "documents"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.col("declared"), F.lit("->"), F.col("kind")), "samples").alias("feature"),
        F.col("embedded").alias("n_embedded"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import pii

    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.concat("base", F.array_sort("added"))).alias("spans"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.cross_polytope import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import periodic

    return periodic.digests(periodic.collapse(table(spark, sf_dir, "documents"), rewrite=periodic.planted))


def op13_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.target_sampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity": op6_toxicity,
    "op7_exact_topk": op7_exact_topk,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_pii": op10_pii,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_target_sampling": op13_target_sampling,
}

_LE4 = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"
_BE4 = "printf('%08X', {0})"

_CRC_TABLE = "(SELECT list(c) AS crc FROM (SELECT list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(n) ORDER BY n))"
_BYTES = "list_transform(range(0, len(hex(encode({0}))) // 2), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"
_CRC = "xor(list_reduce(list_prepend(4294967295, {0}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op11_embedding_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        good AS (
            SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM e
            WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
        reached(vec_id, label) AS (SELECT vec_id, vec_id FROM e UNION SELECT links.a, label FROM reached JOIN links ON links.b = reached.vec_id),
        counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(label) AS component_id, coalesce(vec_id = min(label), false) AS kept
        FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id
    """,
    "op12_periodic_runs": f"""
        WITH t AS {_CRC_TABLE},
        d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC.format(_BYTES.format("CAST(doc_id AS VARCHAR)"))} AS h FROM documents, t),
        a AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
        p AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS ws FROM a),
        w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(0, n)) AS i FROM p),
        o AS (SELECT doc_id, n, i, dense_rank() OVER (ORDER BY w) AS w FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, w) >= 4),
        m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM m),
        c AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS l FROM s GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS f WHERE f.doc_id = c.doc_id AND f.q < c.q AND f.a <= c.a AND f.a + f.l >= c.a + c.l)),
        per AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) AS said,
                   arg_min(struct_pack(a := a, l := l, q := q), row(-l / q, a, q)) AS best
            FROM r GROUP BY doc_id
        ),
        dropped AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + l)) AS i FROM r),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.a AS start, best.l AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
               sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op13_target_sampling": f"""
        WITH t AS {_CRC_TABLE},
        pool AS (SELECT true AS ours, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
        d AS (SELECT row_number() OVER () AS k, ours, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM pool),
        f AS (SELECT k, ours, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
        x AS (SELECT f, {_CRC.format(_BYTES.format("f"))} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), t),
        n AS (SELECT k, ours, bucket, count(*) AS n FROM f JOIN x USING (f) GROUP BY k, ours, bucket),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (ours), 0) AS s, coalesce(sum(n) FILTER (NOT ours), 0) AS t FROM n GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM c) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM c) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c),
        w AS (SELECT k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS s FROM n JOIN g USING (bucket) WHERE ours GROUP BY k),
        v AS (SELECT id AS doc_id, len(ws) >= 20 AS fits, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (s - ((s % n) + n) % n) // n END AS weight,
              CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (k) WHERE ours),
        z AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM v),
        r AS (SELECT *, CASE WHEN fits THEN row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) END AS place FROM z)
        SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CAST(CASE WHEN place <= 25 * (SELECT count(*) FROM v WHERE fits) // 100 THEN place END AS BIGINT) AS rank FROM r
    """,
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
        f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)),
        c AS (SELECT s.doc_id, p, lag(p) OVER (PARTITION BY s.doc_id ORDER BY p) AS before FROM s JOIN f ON f.x = s.x AND first < s.doc_id),
        i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM c),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, span),
        g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
        k AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS stop, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op9_media": f"""
        WITH t AS {_CRC_TABLE},
        d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n, h || repeat('20', CASE WHEN h = '' THEN 192 ELSE (192 - (len(h) // 2) % 192) % 192 END) AS p FROM d),
        l AS (SELECT *, CAST(len(p) // 2 AS BIGINT) AS m, list_transform(range(0, len(p) // 2), lambda i: CAST('0x' || substr(p, 2 * i + 1, 2) AS BIGINT)) AS v FROM p),
        s AS (SELECT *, CASE (m // 192) % 3
            WHEN 0 THEN '52494646' || {_LE4.format('(m + 36)')} || '57415645666D74201000000001000100401F0000401F00000100080064617461' || {_LE4.format('m')}
            WHEN 1 THEN '424D' || {_LE4.format('(m + 54)')} || '00000000360000002800000040000000' || {_LE4.format('(m // 192)')} || '0100180000000000' || {_LE4.format('m')} || '130B0000130B00000000000000000000'
            ELSE '2E736E6400000018' || {_BE4.format('m')} || '0000000200001F4000000001' END || p AS stored,
            CASE (m // 192) % 3 WHEN 0 THEN 'audio/wav;channels=1,rate=8000,bits=8' WHEN 1 THEN 'image/bmp;width=64,height=' || (m // 192) || ',bits=24' ELSE 'audio/basic;channels=1,rate=8000,bits=8' END AS what FROM l)
        SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(p)) AS payload_sha256,
            CAST(xor(list_reduce(list_prepend(4294967295, v[len(v) - 15:]), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS tail_crc32,
            CAST(len(stored) // 2 AS BIGINT) AS media_bytes, sha256(unhex(stored)) AS media_sha256,
            'audio/wav->' || what || ',n=' || m || ',mean=' || printf('%.6f', CAST(list_sum(v) AS DOUBLE) / m) || ',peak=' || list_max(v) || ',distinct=' || len(list_distinct(v)) AS feature,
            CAST(0 AS BIGINT) AS n_embedded
        FROM s, t
    """,
    "op7_exact_topk": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored
        )
        SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
    """,
}
