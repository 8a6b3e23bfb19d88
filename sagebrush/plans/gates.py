"""Context joins, return on investment, compliance gates, price inference and verdict overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.functions import words as W
from sagebrush.functions.compliance import effective_profile, failures, overridden
from sagebrush.functions.finance import annual_saving, inferred_price, roi, roi_bucket

from .registry import query, table
from .signals import RULES, SIGNALS, SQUEEZED, has_sql, one_of, one_of_sql, pick, pick_sql, signals, with_rules


def signal_context(signals: DataFrame, stack: DataFrame, usage: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Signals (category, slug, ...) with the stack entry of their category, its usage if known, and the competitor.

    ``error`` tells the first thing that a signal lacks: a valid category, a stack entry, a competitor; null if none. If
    ``strict``, reading a signal with an error fails with it. The three dimensions have a row a category, tool or
    competitor; Spark broadcasts them while they are small.
    """
    told = signals.join(stack.withColumn("_stack", F.lit(True)), "category", "left").join(usage, "tool", "left")
    told = told.join(registry.withColumn("_known", F.lit(True)), ["category", "slug"], "left")
    category = F.coalesce("category", F.lit("null"))
    error = (
        F.when(~F.coalesce(F.col("category").isin(W.CATEGORIES), F.lit(False)), F.concat(F.lit("invalid category: "), category))
        .when(F.col("_stack").isNull(), F.concat(F.lit("no stack entry: "), category))
        .when(F.col("_known").isNull(), F.concat(F.lit("competitor not found: "), category, F.lit("/"), F.coalesce("slug", F.lit("null"))))
    )
    told = told.withColumn("error", error).drop("_stack", "_known")
    return told.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")))) if strict else told


@query("""SELECT l_orderkey, l_linenumber, p_brand, s_name, n_name, r_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def q_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with four dimensions, two of them optional."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("part"), F.expr("l_partkey = p_partkey")).join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
    rows = rows.join(F.broadcast(t("nation").filter("n_nationkey % 5 <> 0")), F.expr("s_nationkey = n_nationkey"), "left").join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "p_brand", "s_name", "n_name", "r_name")


ROI_SQL = """r AS (
    SELECT l_orderkey, l_linenumber, round((p_retailprice + CASE WHEN l_linenumber = 1 THEN 50 ELSE 0 END - floor(l_extendedprice / l_quantity)) * 12, 2) AS saving
    FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, 15 * 48 AS cost, saving - 15 * 48 / 3.0 AS net FROM r)"""


def roi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    saving = annual_saving(F.col("p_retailprice"), F.when(F.col("l_linenumber") == 1, 50.0), F.floor(F.col("l_extendedprice") / F.col("l_quantity")))
    return rows.select("l_orderkey", "l_linenumber", saving.alias("saving")).withColumn("roi", roi(F.col("saving")))


@query(f"WITH {ROI_SQL} SELECT l_orderkey, l_linenumber, round(saving, 2) AS saving, round(net, 2) AS annual_net, net >= 1200 AS met FROM n")
def q_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("saving", 2).alias("saving"), "roi.annual_net", "roi.met")


@query(f"WITH {ROI_SQL} SELECT CASE WHEN net >= 1200 THEN 'met' WHEN round(net, 2) >= 0 THEN 'positive_below_threshold' ELSE 'negative' END AS bucket, count(*) AS n FROM n GROUP BY 1")
def q_roi_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roi_rows(spark, sf_dir).groupBy(roi_bucket(F.col("roi")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


PRICES = [
    "from £{a} to £{b}", "£{a} (competitor) vs £{b} (the tool)", "reduced by £{a}", "increased by £{a}", "unchanged, was £{a}", "competitive", "",
    "PS{a} flat vs PS{a} flat", "slightly reduced", "slightly increased", "now £{b}", "competitor now £{b}", "from PS{a}.50 to PS{b} a month", "apps {a}",
]


@query(rf"""WITH d AS (SELECT doc_id, replace(replace({one_of_sql(PRICES, "price")}, '{{a}}', CAST(20 + {pick_sql("a", 40)} * 10 AS VARCHAR)), '{{b}}', CAST(300 + {pick_sql("b", 8)} * 30 AS VARCHAR)) || CASE WHEN {pick_sql("spoken", 2)} = 0 THEN ' ' || {SQUEEZED} ELSE '' END AS delta,
    CAST(5 + {pick_sql("base", 90)} * 5 AS DOUBLE) AS base, CAST(300 + {pick_sql("cur", 8)} * 30 AS DOUBLE) AS cur FROM documents),
a AS (SELECT *, list_transform(regexp_extract_all(delta, '(?i)(?:£|PS)\s*([0-9]+(?:\.[0-9]+)?)', 1), lambda x: CAST(x AS DOUBLE)) AS amounts,
    TRY_CAST(regexp_extract(delta, '(?i)from\s*(?:£|PS)\s*([0-9.]+)\s*(?:/\w+)?\s*to\s*(?:£|PS)\s*([0-9.]+)', 2) AS DOUBLE) AS target,
    TRY_CAST(regexp_extract(delta, '(?i)(?:reduced|decreased|down)\s+by\s*£\s*([0-9.]+)', 1) AS DOUBLE) AS less,
    TRY_CAST(regexp_extract(delta, '(?i)(?:increased|increase|up)\s+by\s*£\s*([0-9.]+)', 1) AS DOUBLE) AS more FROM d)
SELECT doc_id, CAST(CASE WHEN delta = '' OR contains(delta, 'unchanged') OR delta = 'competitive' THEN base WHEN target IS NOT NULL THEN target
    WHEN less IS NOT NULL THEN greatest(0, base - less) WHEN more IS NOT NULL THEN base + more
    WHEN len(amounts) = 1 AND (contains(delta, 'competitor') OR abs(amounts[1] - cur) > 0.01) THEN amounts[1] WHEN len(amounts) = 1 THEN base
    WHEN len(list_filter(amounts, lambda x: abs(x - cur) >= 0.01)) > 0 THEN list_filter(amounts, lambda x: abs(x - cur) >= 0.01)[1]
    WHEN contains(delta, 'slightly reduced') THEN greatest(0, base - 10) WHEN contains(delta, 'slightly increased') THEN base + 10 ELSE base END AS DOUBLE) AS price FROM a""")
def q_price_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices told in words: wording, amounts, base and current price of each document vary independently."""
    amount = lambda slot, least, n, step: (least + pick(slot, n) * step).cast("string")
    delta = F.replace(F.replace(one_of(PRICES, "price"), F.lit("{a}"), amount("a", 20, 40, 10)), F.lit("{b}"), amount("b", 300, 8, 30))
    delta = F.concat(delta, F.when(pick("spoken", 2) == 0, F.concat(F.lit(" "), X.squeezed(F.col("text")))).otherwise(""))
    price = inferred_price(delta, (5 + pick("base", 90) * 5).cast("double"), (300 + pick("cur", 8) * 30).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", price.alias("price"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as compliance profiles: flags are bits of the key."""
    bit = lambda n: (F.floor(F.col("c_custkey") / n) % 2 == 1)
    flags = F.struct(bit(1).alias("soc2_type2"), bit(2).alias("sso_saml"), bit(4).alias("uk_residency"), bit(8).alias("gdpr_eu_residency"), bit(16).alias("audit_log"), F.when(F.col("c_custkey") % 3 != 0, bit(32)).alias("audit_log_exportable"))
    category = F.element_at(F.array(*map(F.lit, ("finance", "hr", "crm", "analytics", "project_mgmt"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", category.alias("category"), (F.col("c_nationkey") + 1).alias("seats"), flags.alias("profile"))


GATE_SQL = """p AS (SELECT c_custkey, ['finance', 'hr', 'crm', 'analytics', 'project_mgmt'][c_custkey % 5 + 1] AS category, c_nationkey + 1 AS seats,
    c_custkey % 2 = 1 AS soc2, c_custkey // 2 % 2 = 1 AS sso, c_custkey // 4 % 2 = 1 AS uk, c_custkey // 8 % 2 = 1 AS eu, c_custkey // 16 % 2 = 1 AS audit,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey // 32 % 2 = 1 END AS export FROM customer),
g AS (SELECT c_custkey, list_filter([CASE WHEN NOT soc2 THEN 'No SOC2 Type II' END, CASE WHEN seats > 10 AND NOT sso THEN 'No SSO/SAML' END, CASE WHEN NOT uk AND NOT eu THEN 'No UK or EU data residency' END,
    CASE WHEN category IN ('finance', 'hr', 'crm') AND NOT (audit AND coalesce(export, true)) THEN 'No exportable audit log' END], lambda x: x IS NOT NULL) AS f FROM p)"""


@query(f"WITH {GATE_SQL} SELECT c_custkey, len(f) = 0 AS passed, array_to_string(f, '; ') AS failures FROM g")
def q_compliance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on the baseline profile."""
    found = profiles(spark, sf_dir).withColumn("f", failures(F.col("profile"), F.col("category"), F.col("seats")))
    return found.select("c_custkey", (F.size("f") == 0).alias("passed"), F.array_join("f", "; ").alias("failures"))


SAID = [
    "unchanged", "", "SOC2 Type II achieved", "SOC2 in progress", "SOC2 report not certified", "SSO now available", "lacks SAML", "SSO not available, OIDC launched", "acquired UK data residency",
    "UK residency pending", "EU residency now meets GDPR", "exportable audit log now available", "audit log CSV only, added", "lacks audit log", "audit trail export shipped", "no changes to pricing",
    '{"soc2": false}; SOC2 passed', "UK office opened",
]


def said_changes() -> Column:
    """One or two changes told, and the whole text of half of the documents, parted by semicolons."""
    too = F.when(pick("also", 2) == 0, F.concat(F.lit("; "), one_of(SAID, "said too"))).otherwise("")
    return F.concat(one_of(SAID, "said"), too, F.when(pick("spoken", 2) == 0, F.concat(F.lit("; "), X.squeezed(F.col("text")))).otherwise(""))


SAID_SQL = f"""{one_of_sql(SAID, "said")} || CASE WHEN {pick_sql("also", 2)} = 0 THEN '; ' || {one_of_sql(SAID, "said too")} ELSE '' END || CASE WHEN {pick_sql("spoken", 2)} = 0 THEN '; ' || {SQUEEZED} ELSE '' END"""


_PART = lambda *words: f"list_filter(parts, lambda p: {has_sql('p', list(words))})[1]"
_LOST = lambda part: has_sql(part, W.LOST)
_SURE = "|".join(W.GAINED_FOR_SURE)
# What "not" precedes is taken away, since DuckDB's patterns can't look behind.
_GAINED = lambda part: f"(CASE WHEN {_LOST(part)} THEN regexp_matches(regexp_replace({part}, 'not\\s{{1,4}}({_SURE})', '', 'g'), '{_SURE}') ELSE {has_sql(part, W.GAINED)} END)"
_FLIP = lambda flag, part, able: f"CASE WHEN {part} IS NULL THEN {flag} WHEN NOT {flag} AND {able} AND {_GAINED(part)} THEN true WHEN {flag} AND {_LOST(part)} THEN false ELSE {flag} END"
_AUDITED = "category IN ('finance', 'hr', 'crm') AND audit_part IS NOT NULL"
EFFECTIVE = f"""told AS (SELECT sig.*, lower(trim(regexp_replace({SAID_SQL}, '^\\s*\\{{[^{{}}]*\\}}\\s*;?', ''))) AS t FROM sig JOIN (SELECT doc_id, text FROM documents) USING (doc_id)),
split AS (SELECT *, list_transform(string_split(t, ';'), lambda p: trim(p)) AS parts FROM told),
named AS (SELECT *, {_PART("soc2", "soc 2")} AS soc2_part, {_PART("sso", "saml", "oidc")} AS sso_part, {_PART("uk")} AS uk_part, {_PART("eu", "gdpr")} AS eu_part, {_PART("audit log", "audit trail", "exportable audit")} AS audit_part FROM split),
flags AS (SELECT *, t IN ('', 'unchanged', 'no changes', 'none') AS silent, coalesce(contains(uk_part, 'residency'), false) AS home, coalesce(contains(eu_part, 'residency') AND {_GAINED("eu_part")}, false) AS abroad,
    {_AUDITED} AND NOT audit_log AND {_GAINED("audit_part")} AND NOT contains(audit_part, 'csv only') AS win, {_AUDITED} AND audit_log AND {_LOST("audit_part")} AS lose,
    {_AUDITED} AND audit_log AND NOT {_LOST("audit_part")} AND NOT coalesce(audit_log_exportable, false) AND {has_sql("audit_part", ["audit log export", "exportable audit", "audit trail export"])} AND {_GAINED("audit_part")} AS exports FROM named),
effective AS (SELECT doc_id, category, seats, CASE WHEN silent THEN soc2_type2 ELSE {_FLIP("soc2_type2", "soc2_part", "true")} END AS soc2, CASE WHEN silent THEN sso_saml ELSE {_FLIP("sso_saml", "sso_part", "seats > 10")} END AS sso,
    CASE WHEN silent THEN uk_residency WHEN home AND {_GAINED("uk_part")} THEN true WHEN home AND {_LOST("uk_part")} THEN false ELSE uk_residency END AS uk,
    CASE WHEN silent THEN gdpr_eu_residency ELSE (home AND {_GAINED("uk_part")}) OR gdpr_eu_residency OR abroad END AS eu,
    CASE WHEN silent THEN audit_log WHEN coalesce(win, false) THEN true WHEN coalesce(lose, false) THEN false ELSE audit_log END AS audit,
    CASE WHEN silent THEN audit_log_exportable WHEN coalesce(win OR exports, false) THEN true WHEN coalesce(lose, false) THEN false ELSE audit_log_exportable END AS export FROM flags)"""


@query(f"""WITH {SIGNALS}, {EFFECTIVE} SELECT doc_id, soc2, sso, uk, coalesce(eu, false) AS eu, audit, soc2 AND (seats <= 10 OR sso) AND (uk OR coalesce(eu, false)) AND (category NOT IN ('finance', 'hr', 'crm') OR (audit AND coalesce(export, true))) AS passed FROM effective""")
def q_compliance_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile after the changes told in words, and the gate on it."""
    c = F.col
    said = table(spark, sf_dir, "documents").select("doc_id", said_changes().alias("said"))
    p = signals(spark, sf_dir).select("doc_id", "profile", "category", "seats").join(said, "doc_id")
    p = p.withColumn("new", effective_profile(c("profile"), c("said"), c("category"), c("seats")))
    flags = [c(f"new.{f}").alias(n) for f, n in (("soc2_type2", "soc2"), ("sso_saml", "sso"), ("uk_residency", "uk"), ("gdpr_eu_residency", "eu"), ("audit_log", "audit"))]
    return p.select("doc_id", *flags, (F.size(failures(c("new"), c("category"), c("seats"))) == 0).alias("passed"))


@query(f"""WITH {RULES}, b AS (SELECT doc_id, NOT soc2_type2 OR (seats > 10 AND NOT sso_saml) OR (NOT uk_residency AND NOT gdpr_eu_residency)
    OR (category IN ('finance', 'hr', 'crm') AND NOT (audit_log AND coalesce(audit_log_exportable, true))) AS blocked FROM sig)
SELECT doc_id, hold, disq AS disqualifier, CASE WHEN hold <> 'NONE' THEN 'HOLD' WHEN blocked OR disq <> 'NONE' THEN 'STAY' WHEN enabler <> 'NONE' AND demand <> 'NONE' THEN 'SWITCH' ELSE 'UNKNOWN' END AS verdict
FROM ruled JOIN b USING (doc_id)""")
def q_verdict_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict that the rules force on a model's answer; UNKNOWN is the answer that they leave."""
    rows = with_rules(signals(spark, sf_dir))
    blocks = failures(F.col("profile"), F.col("category"), F.col("seats"))
    verdict = overridden(F.lit("UNKNOWN"), F.col("hold"), F.col("disqualifier"), blocks, F.col("enabler"), F.col("demand"))
    return rows.select("doc_id", "hold", "disqualifier", verdict.alias("verdict"))


@query(f"WITH {RULES} SELECT doc_id, unused AS found FROM ruled")
def q_shelfware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("doc_id", X.shelfware(F.col("tool")).alias("found"))
