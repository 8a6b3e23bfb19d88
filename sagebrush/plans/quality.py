"""Data quality: validation errors, referential checks, duplicates, group sizes, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions.text import memo_errors

from .registry import query, table
from .signals import one_of, pick, pick_sql


def error_counts(df: DataFrame, errors: str, *keys: str) -> DataFrame:
    """How often each error stands in the array column ``errors``."""
    return df.select(*keys, F.explode(errors).alias("error")).groupBy(*keys, "error").agg(F.count(F.lit(1)).alias("n"))


def document_errors() -> Column:
    checks = [
        F.when(F.col("text").isNull() | (F.trim("text") == ""), F.lit("empty text")),
        F.when(F.col("n_chars") < 60, F.lit("short text")),
        F.when(~F.col("lang").isin("en", "de", "fr"), F.lit("unknown language")),
        F.when(F.col("text").rlike("[|*]"), F.lit("markup")),
        F.when(F.length("text") != F.col("n_chars"), F.lit("wrong length")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


@query("""WITH e AS (SELECT doc_id, lang, list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty text' END, CASE WHEN n_chars < 60 THEN 'short text' END,
CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown language' END, CASE WHEN regexp_matches(text, '[|*]') THEN 'markup' END, CASE WHEN length(text) <> n_chars THEN 'wrong length' END], lambda x: x IS NOT NULL) AS errors FROM documents)
SELECT lang, error, count(*) AS n FROM (SELECT lang, unnest(errors) AS error FROM e) GROUP BY ALL""")
def q_quality_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_counts(table(spark, sf_dir, "documents").withColumn("errors", document_errors()), "errors", "lang")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY')")
def q_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer isn't in the registry, which holds all segments but one."""
    known = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT source, count(*) AS n, count(*) - count(DISTINCT text) AS n_repeats FROM documents GROUP BY source HAVING count(*) <> 20 OR count(*) <> count(DISTINCT text)")
def q_group_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that break an expected size or hold repeated texts."""
    d = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("content"))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("k"))
    return g.filter((F.col("n") != 20) | (F.col("n") != F.col("k"))).select("source", "n", (F.col("n") - F.col("k")).alias("n_repeats"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id)")
def q_pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a label yet, with parts of their name and text."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    p = table(spark, sf_dir, "pages").join(done, "page_id", "left_anti")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


MEMO = {
    "CATEGORY": ["CATEGORY: crm"],
    "CURRENT TOOL": ["CURRENT TOOL: A (£20)"],
    "COMPETITOR": ["COMPETITOR: B"],
    "DATE": ["DATE: 2026-01-01"],
    "PUSH SIGNALS": ["PUSH SIGNALS:\n  - x", "PUSH SIGNALS:\nnone told", "PUSH SIGNALS:\n  - y\n  - z"],
    "PULL SIGNALS": ["PULL SIGNALS:\n  - y", "PULL SIGNALS:\n- not indented"],
    "FINANCIAL ANALYSIS": ["FINANCIAL ANALYSIS:\nROI threshold met: YES", "FINANCIAL ANALYSIS:\nno figures"],
    "VERDICT": ["VERDICT: HOLD", "**VERDICT:** SWITCH", "VERDICT: MAYBE", "VERDICT: STAY"],
    "EVIDENCE": ['EVIDENCE:\n"q"', "EVIDENCE:\nno quote"],
    "REASSESS CONDITION": ["REASSESS CONDITION: once it ships"],
}


def memo() -> Column:
    """A memo of which each part may be missing and has one of several wordings, by hashes of the document's id."""
    parts = [F.when(pick(f"memo {name}", 6) != 0, one_of(wordings, f"memo {name}?")) for name, wordings in MEMO.items()]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n")


_HAS = lambda name: f"{pick_sql(f'memo {name}', 6)} <> 0"
_IS = lambda name, *which: f"{_HAS(name)} AND {pick_sql(f'memo {name}?', len(MEMO[name]))} IN ({', '.join(map(str, which))})"
# A bold verdict isn't a header, so it lengthens the section before it and counts as missing.
_MISSING = [f"CASE WHEN NOT ({_HAS(n)}){' OR ' + _IS(n, 1) if n == 'VERDICT' else ''} THEN 'missing section {n}' END" for n in MEMO if n != "REASSESS CONDITION"]


@query(f"""SELECT doc_id, array_to_string(list_filter([{", ".join(_MISSING)},
    CASE WHEN {_IS("VERDICT", 2)} THEN 'invalid verdict' END, CASE WHEN {_IS("EVIDENCE", 1)} THEN 'no quote in EVIDENCE' END,
    CASE WHEN {_IS("PUSH SIGNALS", 1)} THEN 'no bullets in PUSH SIGNALS' END, CASE WHEN {_IS("PULL SIGNALS", 1)} THEN 'no bullets in PULL SIGNALS' END,
    CASE WHEN {_IS("FINANCIAL ANALYSIS", 1)} THEN 'no ROI line' END, CASE WHEN {_IS("VERDICT", 0)} AND NOT ({_HAS("REASSESS CONDITION")}) THEN 'HOLD without REASSESS CONDITION' END], lambda x: x IS NOT NULL), '; ') AS errors
    FROM documents""")
def q_memo_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of memos whose parts are missing or worded wrongly, each by itself."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(memo_errors(memo()), "; ").alias("errors"))
