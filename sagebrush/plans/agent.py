"""Batches of signals from end to end: price, return, answer, rules, validation, memo; evaluation and drift checks of the outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.functions import words as W
from sagebrush.functions.compliance import failures, overridden
from sagebrush.functions.finance import annual_saving, inferred_price, roi
from sagebrush.functions.traces import with_verdict

from .evaluation import accuracy
from .gates import PRICES
from .registry import query, table
from .signals import RULES, one_of, one_of_sql, pick, pick_sql, signals, with_rules

Scorer = Callable[[DataFrame], DataFrame]


def rule_scorer(df: DataFrame) -> DataFrame:
    """An answer without a model: SWITCH if the return is met, else STAY. A scorer adds answer and prob; a model's uses mapInPandas."""
    said = F.when(F.col("roi.met"), "SWITCH").otherwise("STAY")
    return df.withColumn("answer", F.concat(F.lit("ANALYSIS: the return decides.\nVERDICT: "), said)).withColumn("prob", F.when(F.col("roi.met"), 0.9).otherwise(0.6))


def decided(df: DataFrame, scorer: Scorer = rule_scorer) -> DataFrame:
    """Signals with context (notes, changes, tool, profile, category, seats, delta, base, current, addon) and the decision on each.

    Adds price, roi, the answer with the verdict that the rules force, its errors, and the verdict, UNKNOWN if none is told.
    """
    c = F.col
    df = df.withColumn("price", inferred_price(c("delta"), c("base"), c("current")))
    df = df.withColumn("roi", roi(annual_saving(c("current"), c("addon"), c("price"))))
    df = scorer(with_rules(df))
    forced = overridden(F.lit(None).cast("string"), c("hold"), c("disqualifier"), failures(c("profile"), c("category"), c("seats")), c("enabler"), c("demand"))
    df = df.withColumn("answer", with_verdict(c("answer"), forced, every=True)).withColumn("errors", X.lean_errors(c("answer")))
    return df.withColumn("verdict", F.coalesce(X.verdict(c("answer")), F.lit("UNKNOWN")))


def live_runs_of(decisions: DataFrame, ts: str) -> DataFrame:
    """Decisions as events of the log."""
    return decisions.select(F.lit(ts).alias("ts"), F.lit("live_run").alias("type"), "category", F.col("slug").alias("competitor"), "verdict", "prob", (F.size("errors") == 0).alias("format_valid"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of documents with prices; the stack's add-on costs are of one category."""
    amount = lambda slot, least, n, step: (least + pick(slot, n) * step).cast("string")
    delta = F.replace(F.replace(one_of(PRICES, "price"), F.lit("{a}"), amount("a", 20, 40, 10)), F.lit("{b}"), amount("b", 300, 8, 30))
    return signals(spark, sf_dir).withColumns({"delta": delta, "base": (5 + pick("base", 90) * 5).cast("double"), "current": (300 + pick("cur", 8) * 30).cast("double"), "addon": F.when(F.col("category") == "analytics", 95.0)})


_NUMBER = "[0-9]+(?:\\.[0-9]+)?"
PRICED = f"""{RULES},
asked AS (SELECT doc_id, replace(replace({one_of_sql(PRICES, "price")}, '{{a}}', CAST(20 + {pick_sql("a", 40)} * 10 AS VARCHAR)), '{{b}}', CAST(300 + {pick_sql("b", 8)} * 30 AS VARCHAR)) AS delta,
    CAST(5 + {pick_sql("base", 90)} * 5 AS DOUBLE) AS base, CAST(300 + {pick_sql("cur", 8)} * 30 AS DOUBLE) AS cur FROM sig),
amounts AS (SELECT *, list_transform(regexp_extract_all(delta, '(?i)(?:£|PS)\\s*({_NUMBER})', 1), lambda x: CAST(x AS DOUBLE)) AS amounts,
    TRY_CAST(regexp_extract(delta, '(?i)from\\s*(?:£|PS)\\s*({_NUMBER})\\s*to\\s*(?:£|PS)\\s*({_NUMBER})', 2) AS DOUBLE) AS target,
    TRY_CAST(regexp_extract(delta, '(?i)reduced\\s+by\\s*£\\s*({_NUMBER})', 1) AS DOUBLE) AS less, TRY_CAST(regexp_extract(delta, '(?i)increased\\s+by\\s*£\\s*({_NUMBER})', 1) AS DOUBLE) AS more FROM asked),
priced AS (SELECT doc_id, cur, CASE WHEN delta = '' OR contains(delta, 'unchanged') OR delta = 'competitive' THEN base WHEN target IS NOT NULL THEN target
    WHEN less IS NOT NULL THEN greatest(0, base - less) WHEN more IS NOT NULL THEN base + more
    WHEN len(amounts) = 1 AND (contains(delta, 'competitor') OR abs(amounts[1] - cur) > 0.01) THEN amounts[1] WHEN len(amounts) = 1 THEN base
    WHEN len(list_filter(amounts, lambda x: abs(x - cur) >= 0.01)) > 0 THEN list_filter(amounts, lambda x: abs(x - cur) >= 0.01)[1]
    WHEN contains(delta, 'slightly reduced') THEN greatest(0, base - 10) WHEN contains(delta, 'slightly increased') THEN base + 10 ELSE base END AS price FROM amounts),
returned AS (SELECT doc_id, price, round((cur + CASE WHEN category = 'analytics' THEN 95 ELSE 0 END - price) * 12, 2) - 240 AS net FROM priced JOIN (SELECT doc_id, category FROM sig) USING (doc_id)),
decided AS (SELECT r.doc_id, r.scenario, r.category, t.price, t.net, CASE WHEN hold <> 'NONE' THEN 'HOLD'
    WHEN disq <> 'NONE' OR NOT soc2_type2 OR (seats > 10 AND NOT sso_saml) OR (NOT uk_residency AND NOT gdpr_eu_residency) OR (r.category IN ('finance', 'hr', 'crm') AND NOT (audit_log AND coalesce(audit_log_exportable, true))) THEN 'STAY'
    WHEN enabler <> 'NONE' AND demand <> 'NONE' THEN 'SWITCH' WHEN t.net >= 1200 THEN 'SWITCH' ELSE 'STAY' END AS verdict FROM ruled r JOIN returned t USING (doc_id))"""


@query(f"WITH {PRICED} SELECT doc_id, price, round(net, 2) AS annual_net, net >= 1200 AS met, verdict, 0 AS n_errors FROM decided")
def q_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, return and verdict of each signal, by the scorer without a model."""
    d = decided(context(spark, sf_dir))
    return d.select("doc_id", "price", "roi.annual_net", "roi.met", "verdict", F.size("errors").alias("n_errors"))


def expected_verdict(scenario: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for s, v in W.EXPECTED_VERDICT.items() if v for x in (s, v))), scenario)


_EXPECTED = "CASE scenario " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in W.EXPECTED_VERDICT.items() if v) + " END"


def evaluated(decisions: DataFrame) -> DataFrame:
    """Decisions as cases: expected and actual verdict, of scenarios that state one."""
    return decisions.select("scenario", expected_verdict(F.col("scenario")).alias("expected"), F.nullif("verdict", F.lit("UNKNOWN")).alias("actual"), "prob").filter("expected is not null")


@query(f"WITH {PRICED}, c AS (SELECT scenario, {_EXPECTED} AS expected, verdict AS actual FROM decided) SELECT scenario, count(*) AS n, count(*) FILTER (expected = actual) AS n_correct, count(actual) AS n_formed, round(avg(CASE WHEN expected = actual THEN 1 ELSE 0 END), 4) AS accuracy FROM c WHERE expected IS NOT NULL GROUP BY scenario")
def q_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the decisions of each scenario that states a verdict."""
    return accuracy(evaluated(decided(context(spark, sf_dir))), "scenario")


def drift_check(cases: DataFrame) -> DataFrame:
    """One accuracy_check: correct, total, accuracy (0 without cases), its band, and whether it passes the gate."""
    right = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    s = cases.agg(F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"))
    share = F.coalesce(F.round(F.try_divide("correct", "total"), 4), F.lit(0.0))
    return s.withColumn("accuracy", share).withColumn("band", F.when(share >= 0.9, "good").when(share >= 0.75, "fair").otherwise("poor")).withColumn("passed", share >= 0.75)


@query(f"""WITH {PRICED}, c AS (SELECT {_EXPECTED} AS expected, verdict AS actual FROM decided), s AS (SELECT count(*) FILTER (expected = actual) AS correct, count(*) AS total FROM c WHERE expected IS NOT NULL),
a AS (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE round(correct / total, 4) END AS accuracy FROM s) SELECT *, CASE WHEN accuracy >= 0.9 THEN 'good' WHEN accuracy >= 0.75 THEN 'fair' ELSE 'poor' END AS band, accuracy >= 0.75 AS passed FROM a""")
def q_drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_check(evaluated(decided(context(spark, sf_dir))))


def sampled_cases(cases: DataFrame, id_column: str, limit: int | None, scenario: str | None = None, seed: int = 42) -> DataFrame:
    """Cases to run: all, or at most ``limit`` of each scenario by a seeded order; of one scenario, if it is given."""
    from sagebrush.operators.sampling import stratified

    some = cases if scenario is None else cases.filter(F.col("scenario") == scenario)
    return some if limit is None else stratified(some, "scenario", limit, seed, id_column).drop("place")


@query(f"""WITH s AS (SELECT doc_id, {one_of_sql(W.SCENARIOS, "scenario")} AS scenario FROM (SELECT DISTINCT doc_id FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5('42|' || doc_id), doc_id) AS place FROM s)
SELECT 'limited' AS mode, doc_id, scenario FROM k WHERE place <= 2 UNION ALL SELECT 'one', doc_id, scenario FROM s WHERE scenario = 'fluff_update'""")
def q_sample_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cases of each scenario, and all of one scenario."""
    s = table(spark, sf_dir, "documents").select("doc_id").distinct().select("doc_id", one_of(W.SCENARIOS, "scenario").alias("scenario"))
    limited = sampled_cases(s, "doc_id", 2).select(F.lit("limited").alias("mode"), "doc_id", "scenario")
    return limited.union(sampled_cases(s, "doc_id", None, "fluff_update").select(F.lit("one"), "doc_id", "scenario"))


@query(f"""WITH s AS (SELECT doc_id, {one_of_sql(W.SCENARIOS, "scenario")} AS scenario FROM (SELECT DISTINCT doc_id FROM documents)), c AS (SELECT doc_id, {_EXPECTED} AS expected FROM s),
d AS (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY md5('7|' || doc_id), doc_id) AS round FROM c WHERE expected IS NOT NULL), n AS (SELECT round, count(*) AS n FROM d GROUP BY round)
SELECT doc_id, expected, CAST(round AS BIGINT) AS batch FROM d JOIN n USING (round) WHERE n = 3""")
def q_reward_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with one case of each expected verdict; what fills no batch is left out."""
    from sagebrush.operators.sampling import interleaved_batches

    s = table(spark, sf_dir, "documents").select("doc_id").distinct().select("doc_id", expected_verdict(one_of(W.SCENARIOS, "scenario")).alias("expected")).filter("expected is not null")
    return interleaved_batches(s, "expected", 3, 7, "doc_id").select("doc_id", "expected", F.col("round").cast("long").alias("batch"))
