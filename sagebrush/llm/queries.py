"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, licenses, line_dedup, minhash, quality, resampling, rules, secrets, token_counts, topk, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The two vocabularies that are aligned.
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches that Python workers get: small ones, so that several stages' workers fit an executor beside its heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    # Python workers must find this package, also where the session was started from another folder.
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, sf_dir, "documents"), inside_lines=True).select("doc_id", "n_lines", "n_deleted", "text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), counts=True).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_quality_classifier,
        op3_byte_bpe,
        op4_decontamination,
        op5_license_scan,
        op6_token_counts,
        op7_exact_topk,
        op8_line_dedup,
        op9_secret_scan,
        op10_toxicity,
        op11_quality_rules,
        op12_importance_resampling,
        op13_tokenizer_alignment,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    # All pairs that share a shingle, so only for small tables.
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) e ON e.a = r.other),
        components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM components c LEFT JOIN sizes USING (doc_id)""",
    "op7_exact_topk": """
        WITH fine AS (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS place, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scores AS (
            SELECT q.place AS place, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM fine q JOIN fine c ON c.place <> q.place AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS r FROM scores)
        WHERE r <= 5""",
    # In the counts of signs and in the rules, what Facts and RULES tell.
    "op11_quality_rules": r"""
        WITH split AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        runs AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM split, unnest(range(1, len(w) - 3)) t(i)),
        again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM runs) WHERE n > 1),
        repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) t(k) GROUP BY r),
        facts AS (
            SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
                   length(t) - length(replace(t, '!', '')) AS n_exclaims, len(list_filter(w, lambda x: regexp_full_match(x, '[!-/:-@\[-`{-~]+'))) AS n_bare,
                   coalesce(list_max(map_values(list_histogram(w))), 0) AS top_word
            FROM split LEFT JOIN repeats USING (r)),
        based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_upper > 30 * (n_upper + n_lower) OR 10 * n_exclaims > n_words
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_bare > n_words OR 2 * n_dup_lines > n_lines OR 100 * top_word > 30 * n_words) AS kept
        FROM based""",
    # DuckDB has no CRC of its own, so the table of the 256 bytes is made by its rule.
    "op12_importance_resampling": r"""
        WITH bytes AS (
            SELECT list(c ORDER BY i) AS crc_of FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
        texts AS (
            SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
            UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
        split AS (
            SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts),
        words AS (SELECT side, r, unnest(w) AS word FROM split),
        spelled AS (
            SELECT word, list_transform(range(strlen(word)), lambda k: 16 * (strpos('0123456789ABCDEF', hex(word)[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', hex(word)[2 * k + 2]) - 1) AS b
            FROM (SELECT DISTINCT word FROM words)),
        hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM spelled, bytes),
        dealt AS (SELECT side, r, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
        sums AS (
            SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM dealt GROUP BY bucket),
        whole AS (SELECT CAST(sum(s) AS DOUBLE) + 10000 AS n_s, CAST(sum(t) AS DOUBLE) + 10000 AS n_t FROM sums),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * n_s) / (CAST(s + 1 AS DOUBLE) * n_t))) AS BIGINT) AS gain FROM sums, whole),
        weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM dealt JOIN gains USING (bucket) WHERE side = 's' GROUP BY r),
        scored AS (
            SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM split LEFT JOIN weights USING (r) WHERE side = 's'),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank
        FROM placed""",
}
