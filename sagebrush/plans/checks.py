"""Checks of registries, contexts and traces, and labels for display, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import signals as S
from sagebrush.functions import text as X
from sagebrush.functions import traces as T
from sagebrush.functions import words as W

from .curation import sql_list
from .gates import signal_context
from .registry import query, table
from .signals import RULES, SIGNALS, has_sql, one_of_sql, pick, pick_sql, signals, with_rules
from .traces import traces
from .training import prompts


def unless_missing(key: str, value: Column) -> Column:
    """A field that some entries lack, by a hash of the entry's id and the key; JSON leaves nulls out."""
    return F.when(pick(f"has {key}", 6) != 0, value)


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of a registry, as JSON."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "doc_id")
    features = F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    profile = F.struct(*(unless_missing(k, F.col("c_acctbal") > 1000).alias(k) for k in W.COMPLIANCE_KEYS))
    values = {"name": F.col("c_name"), "category": F.col("c_mktsegment"), "monthly_cost_gbp": F.col("c_acctbal"), "compliance": profile, "features": features}
    fields = [unless_missing(k, values.get(k, F.col("c_mktsegment"))).alias(k) for k in W.COMPETITOR_KEYS]
    return c.select("doc_id", F.to_json(F.struct(*fields)).alias("payload"))


def missing_sql(keys: list[str], prefix: str = "") -> str:
    """Those of the keys that an entry lacks, sorted."""
    each = ", ".join(f"CASE WHEN {pick_sql(f'has {prefix}{k}', 6)} = 0 THEN '{k}' END" for k in sorted(keys))
    return f"list_filter([{each}], lambda x: x IS NOT NULL)"


@query(f"""WITH c AS (SELECT c_custkey AS doc_id, c_acctbal FROM customer), m AS (SELECT doc_id, c_acctbal, {missing_sql(W.COMPETITOR_KEYS)} AS keys,
CASE WHEN {pick_sql("has compliance", 6)} = 0 THEN {sql_list(sorted(W.COMPLIANCE_KEYS))} ELSE {missing_sql(W.COMPLIANCE_KEYS)} END AS profile, {pick_sql("has features", 6)} <> 0 AND c_acctbal > 0 AS featured FROM c)
SELECT doc_id AS c_custkey, array_to_string(list_filter([CASE WHEN len(keys) > 0 THEN 'missing keys: ' || array_to_string(keys, ', ') END,
    CASE WHEN len(profile) > 0 THEN 'compliance missing keys: ' || array_to_string(profile, ', ') END, CASE WHEN NOT featured THEN 'features list is empty or missing' END], lambda x: x IS NOT NULL), '; ') AS errors FROM m""")
def q_registry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry of a registry lacks: keys, keys of its profile, features."""
    found = registry_entries(spark, sf_dir).select("doc_id", S.competitor_errors(F.try_parse_json("payload")).alias("e"))
    return found.select(F.col("doc_id").alias("c_custkey"), F.array_join("e", "; ").alias("errors"))


@query(f"""WITH s AS (SELECT s_suppkey AS doc_id FROM supplier)
SELECT doc_id AS s_suppkey, array_to_string(list_filter([{", ".join(f"CASE WHEN {pick_sql(f'has {c}', 6)} = 0 THEN 'missing category: {c}' WHEN len({missing_sql(W.STACK_KEYS, c + '.')}) > 0 THEN '{c} missing keys: ' || array_to_string({missing_sql(W.STACK_KEYS, c + '.')}, ', ') END" for c in W.CATEGORIES)}], lambda x: x IS NOT NULL), '; ') AS errors FROM s""")
def q_stack_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's stack lacks: categories, or keys of their entries."""
    entry = lambda c: F.struct(*(unless_missing(f"{c}.{k}", F.col("s_name")).alias(k) for k in W.STACK_KEYS))
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "doc_id")
    payload = F.to_json(F.struct(*(unless_missing(c, entry(c)).alias(c) for c in W.CATEGORIES)))
    return s.select(F.col("doc_id").alias("s_suppkey"), F.array_join(S.stack_errors(F.try_parse_json(payload)), "; ").alias("errors"))


@query(f"""WITH {SIGNALS}, stack AS (SELECT DISTINCT category, 'Tool ' || category AS tool FROM sig WHERE category <> 'hr'), usage AS (SELECT stack.tool AS tool, count(*) AS uses FROM stack JOIN sig USING (category) WHERE seats > 20 AND category <> 'crm' GROUP BY ALL),
known AS (SELECT category, slug, min(doc_id) AS first_seen FROM sig GROUP BY ALL HAVING (length(category) + length(slug)) % 3 <> 0),
asked AS (SELECT doc_id, CASE WHEN {pick_sql("asked", 9)} = 0 THEN 'other' ELSE category END AS category, slug FROM sig)
SELECT doc_id, stack.tool, coalesce(uses, 0) AS uses, coalesce(first_seen, -1) AS first_seen, CASE WHEN category = 'other' THEN 'invalid category: other' WHEN stack.tool IS NULL THEN 'no stack entry: ' || category WHEN first_seen IS NULL THEN 'competitor not found: ' || category || '/' || slug END AS error
FROM asked LEFT JOIN stack USING (category) LEFT JOIN usage ON usage.tool = stack.tool LEFT JOIN known USING (category, slug)""")
def q_context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with their context, and what is missing of it."""
    s = signals(spark, sf_dir).select("doc_id", "category", "slug", "seats")
    stack = s.filter("category <> 'hr'").select("category", F.concat(F.lit("Tool "), "category").alias("tool")).distinct()
    usage = s.filter("seats > 20 and category not in ('crm', 'hr')").groupBy(F.concat(F.lit("Tool "), "category").alias("tool")).agg(F.count(F.lit(1)).alias("uses"))
    known = s.groupBy("category", "slug").agg(F.min("doc_id").alias("first_seen")).filter((F.length("category") + F.length("slug")) % 3 != 0)
    asked = s.select("doc_id", F.when(pick("asked", 9) == 0, "other").otherwise(F.col("category")).alias("category"), "slug")
    found = signal_context(asked, stack, usage, known)
    return found.select("doc_id", "tool", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("first_seen", F.lit(-1)).alias("first_seen"), "error")


_LINES = f"list_filter(tool, lambda x: NOT list_contains({sql_list(W.NO_CHANGE)}, lower(trim(x))))"


@query(f"""WITH {RULES} SELECT doc_id, coalesce(previous = 'HOLD', false) AS held_before, {one_of_sql(["NONE", "until renewal"], "cond")} <> 'NONE' AS hold, disq <> 'NONE' AS disqualifier, unused <> 'NONE' AS shelfware,
len({_LINES}) > 0 AS changed, ['CONCRETE', 'VAGUE', 'UNKNOWN'][{pick_sql("pull", 3)} + 1] AS pull_substance, len(list_filter(issues, lambda x: {has_sql("x", T.SEVERE_ISSUE)})) AS n_severe FROM ruled""")
def q_trace_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompt and the answer of each trace tell, and how many of its issues are severe."""
    asked = prompts(with_rules(signals(spark, sf_dir))).select("doc_id", T.parsed_prompt(F.col("prompt")).alias("p"))
    said = traces(spark, sf_dir).select("doc_id", T.parsed_answer(F.col("answer")).alias("a"))
    both = asked.join(said, "doc_id").withColumn("f", T.flags(F.col("p"), F.col("a")))
    severe = F.size(F.filter("p.issues", lambda x: T.severe_issue(x, F.col("a.push_lines"))))
    return both.select("doc_id", "f.*", severe.cast("long").alias("n_severe"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '"([^"\n]+)"', 1)[1:6], '|') AS quoted FROM pages""")
def q_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quoted strings of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.quotes(F.col("html")), "|").alias("quoted"))


@query("""WITH t AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN '' WHEN user_id % 5 = 1 THEN strftime(ts, '%Y-%m-%dT00:00:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS m FROM events)
SELECT event_id, CASE WHEN m = '' THEN '—' WHEN m[12:16] = '00:00' THEN m[1:10] ELSE m[1:10] || ' ' || m[12:16] END AS moment, CASE WHEN m <> '' THEN 'v' || m[3:4] || '.' || m[6:7] END AS version FROM t""")
def q_moment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of events as they are shown, and the version that a day stands for; some are unknown or days only."""
    group = F.col("user_id") % 5
    at = F.when(group == 0, "").when(group == 1, F.date_format("ts", "yyyy-MM-dd'T'00:00:00")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    e = table(spark, sf_dir, "events").select("event_id", at.alias("at"))
    return e.select("event_id", X.moment_label(F.col("at")).alias("moment"), X.version_label(F.col("at")).alias("version"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g') AS slug, upper(p_type[1]) || lower(p_type[2:]) AS kind FROM part""")
def q_name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as slugs, kinds in sentence case."""
    return table(spark, sf_dir, "part").select("p_partkey", X.slugified(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.sentence_case(F.col("p_type")).alias("kind"))
