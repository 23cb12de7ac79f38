"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, huffman, mixing, near_dedup, packing, pii, quality, resampling, secrets, sharding, va_search, warc
from .common import table


def op8_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.membership(table(spark, sf_dir, "documents"))


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.layout(2, 3, 4))


def op5_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.membership(table(spark, sf_dir, "documents"))


def op10_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).drop("n_best_b")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_hash_tree_shards": op1_hash_tree_shards,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op4_histogram_packing": op4_histogram_packing,
    "op5_golden_ratio_mix": op5_golden_ratio_mix,
    "op2_crf_pii": op2_crf_pii,
    "op6_huffman_ids": op6_huffman_ids,
    "op7_quality_cascade": op7_quality_cascade,
    "op8_grace_dedup": op8_grace_dedup,
    "op9_lsh_forest": op9_lsh_forest,
    "op10_owned_secrets": op10_owned_secrets,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_va_file_search": op13_va_file_search,
}

ORACLES = {
    "op3_warc_round_trip": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
        f AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
        SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM f
    """,
    "op7_quality_cascade": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents
        ), windows AS (
            SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n
            FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows), (VALUES (0), (1), (2)) AS v(k)
            WHERE c > 1 GROUP BY doc_id
        ), counts AS (
            SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   len(ls) AS n_lines, coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
                   len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_bare, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest
            FROM d LEFT JOIN repeated ON d.doc_id = repeated.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                    OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
                    OR 100 * n_digits > 30 * word_chars OR 100 * n_bare > 30 * n_words OR longest > 1000) AS kept
        FROM counts
    """,
    "op8_grace_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_lsh_forest": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM w
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, w.doc_id = min(b) AS kept
        FROM w JOIN reach ON w.doc_id = reach.a LEFT JOIN sizes ON w.doc_id = sizes.doc_id GROUP BY w.doc_id, n
    """,
    "op12_importance_resampling": r"""
        WITH steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab
        ), raw AS (
            SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark
        ), texts AS (
            SELECT side, t, count(*) AS n, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM raw GROUP BY side, t
        ), grams AS (
            SELECT side, t, n, array_to_string(ws[i:i + k - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM texts), (VALUES (1), (2), (3)) AS v(k) WHERE i + k - 1 <= len(ws)
        ), counted AS (SELECT side, t, any_value(n) AS n, g, count(*) AS c FROM grams GROUP BY side, t, g),
        spelt AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)),
        hashed AS (
            SELECT g, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT),
                          lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM spelt, steps
        ), sums AS (
            SELECT bucket, coalesce(sum(n * c) FILTER (side = 'd'), 0) AS s, coalesce(sum(n * c) FILTER (side = 'b'), 0) AS t FROM counted JOIN hashed USING (g) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
        ), weights AS (
            SELECT t, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN hashed USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY t
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weights ON coalesce(text, '') = weights.t
        ), placed AS (SELECT *, n_features >= 57 AS enough, row_number() OVER (PARTITION BY n_features >= 57 ORDER BY score DESC, doc_id) AS r FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= 5 * (SELECT count(*) FROM placed WHERE enough) // 100 THEN r END AS rank FROM placed
    """,
    "op13_va_file_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i]))::BIGINT AS score
            FROM v AS q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
        )
        SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
    """,
}
