"""Monitoring with memos and summaries: recent runs, rankings, reviews, holds, history, feedback; views of the list pages.

``memos`` has memo and text, ``summaries`` has memo and summary. The registered queries make a memo and a summary of each
document, called m<doc_id>.md as the events' memos are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions.signals import stripped
from sagebrush.operators.latest import last_value
from sagebrush.operators.order import ranked

from .monitoring import ACCURACY_GATE, LATEST, LOG, REVIEW_BELOW, corrections, events_as_log, latest_runs, live_runs, rankings, recent, review_queue
from .registry import query, table

EXCERPT = 300


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("VERDICT: HOLD\nEVIDENCE:\n"), "text", F.lit("\nREASSESS CONDITION:  once "), "lang", F.lit(" ships \nREVIEW BY: 2026-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-01 or later"))
    return d.select(F.concat(F.lit("m"), "doc_id", F.lit(".md")).alias("memo"), F.when(F.col("source") != "web", text).otherwise(F.col("text")).alias("text"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), "doc_id", F.lit(".md")).alias("memo"), F.concat_ws(" / ", "lang", "source", "n_chars").alias("summary"))


_TRIM = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
MEMOS = f"""{LOG}, memos AS (SELECT 'm' || doc_id || '.md' AS memo, CASE WHEN source <> 'web' THEN 'VERDICT: HOLD' || chr(10) || 'EVIDENCE:' || chr(10) || text || chr(10) || 'REASSESS CONDITION:  once ' || lang || ' ships ' || chr(10) || 'REVIEW BY: 2026-0' || (doc_id % 9 + 1) || '-01 or later' ELSE text END AS text FROM documents),
parts AS (SELECT memo, left({_TRIM("regexp_extract(text, 'EVIDENCE:[ \\t\\n\\r\\f\\v]*((?s:.+?))(?:\\n[A-Z][A-Z \\t\\n\\r\\f\\v]+:|$)', 1)")}, {EXCERPT}) AS excerpt,
    {_TRIM("regexp_extract(text, 'REASSESS CONDITION:[ \\t\\n\\r\\f\\v]*([^\\n]+)', 1)")} AS reassess, regexp_extract(text, 'REVIEW BY:[ \\t\\n\\r\\f\\v]*([^ \\t\\n\\r\\f\\v]+)', 1) AS review_by FROM memos),
sums AS (SELECT 'm' || doc_id || '.md' AS memo, concat_ws(' / ', lang, source, n_chars) AS summary FROM documents)"""


def evidence(text: Column) -> Column:
    """The start of what stands below EVIDENCE up to the next header; empty if there is none."""
    return F.left(stripped(F.regexp_extract(text, r"(?s)EVIDENCE:\s*(.+?)(?=\n[A-Z][A-Z\s]+:|$)", 1)), F.lit(EXCERPT))


def reassess_condition(text: Column) -> Column:
    return stripped(F.regexp_extract(text, r"REASSESS CONDITION:\s*(.+)", 1))


def review_by(text: Column) -> Column:
    return F.regexp_extract(text, r"REVIEW BY:\s*(\S+)", 1)


def with_summary(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """The summary of each run's memo, or null."""
    return runs.join(summaries.select("memo", "summary"), "memo", "left")


def with_memo(runs: DataFrame, memos: DataFrame, **fields) -> DataFrame:
    """A column of each run's memo for each of ``fields`` (name: expression of the text); empty without a memo.

    Only memos of these runs are read through the expressions.
    """
    found = runs.join(memos, "memo", "left")
    return found.select(*runs.columns, *(F.coalesce(of(F.col("text")), F.lit("")).alias(name) for name, of in fields.items()))


@query(f"WITH {MEMOS}, last AS (SELECT * FROM live ORDER BY ts DESC, seq DESC LIMIT 40) SELECT seq, competitor, verdict, memo, coalesce(excerpt, '') AS memo_excerpt, summary FROM last LEFT JOIN parts USING (memo) LEFT JOIN sums USING (memo)")
def q_recent_memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last runs with an excerpt of their memo and its summary."""
    runs = recent(events_as_log(spark, sf_dir), 40).select("seq", "competitor", "verdict", "memo")
    return with_summary(with_memo(runs, memos(spark, sf_dir), memo_excerpt=evidence), summaries(spark, sf_dir)).select("seq", "competitor", "verdict", "memo", "memo_excerpt", "summary")


@query(f"WITH {MEMOS}, {LATEST} SELECT CAST(row_number() OVER (ORDER BY coalesce(prob, 0) DESC, first_seq) AS BIGINT) AS rank, competitor, memo, prob, summary FROM latest LEFT JOIN sums USING (memo) WHERE verdict = 'SWITCH'")
def q_rankings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_summary(rankings(events_as_log(spark, sf_dir)), summaries(spark, sf_dir)).select("rank", "competitor", "memo", "prob", "summary")


@query(f"""WITH {MEMOS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memo ORDER BY ts DESC, seq) AS r FROM live) WHERE r = 1)
SELECT n.memo, seq, competitor, prob, summary FROM newest n LEFT JOIN sums USING (memo) WHERE prob < {REVIEW_BELOW} AND NOT EXISTS (SELECT 1 FROM log f WHERE f.type = 'human_feedback' AND f.memo_filename = n.memo)""")
def q_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_summary(review_queue(events_as_log(spark, sf_dir)), summaries(spark, sf_dir)).select("memo", "seq", "competitor", "prob", "summary")


@query(f"WITH {MEMOS}, {LATEST} SELECT competitor, category, prob AS confidence, ts, memo, summary, coalesce(reassess, '') AS reassess_condition, coalesce(review_by, '') AS review_by FROM latest LEFT JOIN parts USING (memo) LEFT JOIN sums USING (memo) WHERE verdict = 'HOLD'")
def q_holds_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds with the condition and the day on which to look at them again, as their memos tell."""
    holds = latest_runs(events_as_log(spark, sf_dir)).filter("verdict = 'HOLD'").select("competitor", "category", F.col("prob").alias("confidence"), "ts", "memo", "first_seq")
    found = with_summary(with_memo(holds, memos(spark, sf_dir), reassess_condition=reassess_condition, review_by=review_by), summaries(spark, sf_dir))
    return found.orderBy(F.desc("ts"), "first_seq").select("competitor", "category", "confidence", "ts", "memo", "summary", "reassess_condition", "review_by")


@query(f"WITH {MEMOS} SELECT seq, ts, category, competitor, verdict, memo, summary FROM live LEFT JOIN sums USING (memo)")
def q_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs with their memo's summary, newest first."""
    return with_summary(live_runs(events_as_log(spark, sf_dir)), summaries(spark, sf_dir)).select("seq", "ts", "category", "competitor", "verdict", "memo", "summary").orderBy(F.desc("ts"), "seq")


def checks(log: DataFrame) -> DataFrame:
    """Accuracy checks with nested results (status, file, correct), made of the check's number: some fail, some tell no outcome."""
    n = F.col("seq")
    result = lambda i: F.struct(F.when((n + i) % 5 == 0, "error").otherwise("ok").alias("status"), F.concat(F.lit("f"), ((n + i) % 13).cast("string")).alias("file"), F.when((n + 2 * i) % 7 != 0, (n * 3 + i) % 4 != 0).alias("correct"))
    return log.filter("type = 'accuracy_check'").select("seq", "ts", F.transform(F.sequence(F.lit(0), (n % 6).cast("int")), result).alias("results"))


CHECKS = """checks AS (SELECT seq, ts, list_transform(range(0, seq % 6 + 1), lambda i: {'status': CASE WHEN (seq + i) % 5 = 0 THEN 'error' ELSE 'ok' END, 'file': 'f' || ((seq + i) % 13),
    'correct': CASE WHEN (seq + 2 * i) % 7 <> 0 THEN (seq * 3 + i) % 4 <> 0 END}) AS results FROM log WHERE type = 'accuracy_check')"""


def failures(results: Column) -> Column:
    """Results that ran and were wrong; one that tells no outcome was right."""
    return F.size(F.filter(results, lambda r: (r["status"] == "ok") & ~F.coalesce(r["correct"], F.lit(True))))


def feedback_counts(log: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: corrections by memo since the last checkpoint, failures of the last check if it is later, and whether there is something to train on.

    The checkpoint is the last to arrive, its ts the cutoff; so is the last check among those after it.
    """
    cutoff = F.broadcast(last_value(log, "ts", F.col("type") == "dpo_checkpoint").withColumnRenamed("ts", "cutoff"))
    later = F.coalesce(F.col("ts") > F.col("cutoff"), F.lit(True))
    human = corrections(log).join(cutoff, later).agg(F.count_distinct("memo_filename").alias("human_corrections"))
    canary = checks.join(cutoff, later).agg(F.coalesce(failures(F.max_by("results", "seq")), F.lit(0)).cast("long").alias("canary_failures"))
    both = human.join(F.broadcast(canary))
    total = F.col("human_corrections") + F.col("canary_failures")
    return both.withColumn("total_corrections", total).withColumn("ready_to_train", total >= 1)


@query(f"""WITH {LOG}, {CHECKS}, cut AS (SELECT arg_max(ts, seq) AS cutoff FROM log WHERE type = 'dpo_checkpoint'),
h AS (SELECT count(DISTINCT memo_filename) AS human_corrections FROM log, cut WHERE type = 'human_feedback' AND NOT coalesce(correct, true) AND stated_verdict IS DISTINCT FROM actual_verdict AND coalesce(ts > cutoff, true)),
l AS (SELECT arg_max(results, seq) AS results FROM checks, cut WHERE coalesce(ts > cutoff, true)),
c AS (SELECT coalesce(len(list_filter(results, lambda r: r.status = 'ok' AND NOT coalesce(r.correct, true))), 0) AS canary_failures FROM l)
SELECT human_corrections, canary_failures, human_corrections + canary_failures AS total_corrections, human_corrections + canary_failures >= 1 AS ready_to_train FROM h, c""")
def q_feedback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_as_log(spark, sf_dir)
    return feedback_counts(log, checks(log))


def still_wrong(checks: DataFrame) -> DataFrame:
    """The latest result of each file, of equal times the last to arrive, as far as it is wrong. A later right result clears a file."""
    each = checks.select("seq", "ts", F.posexplode("results").alias("pos", "r")).filter("r.status = 'ok'")
    last = each.groupBy(F.col("r.file").alias("file")).agg(F.max_by(F.struct("seq", "ts", "r"), F.struct("ts", "seq", "pos")).alias("x"))
    return last.filter(~F.coalesce("x.r.correct", F.lit(True))).select("file", "x.seq", "x.ts")


@query(f"""WITH {LOG}, {CHECKS}, e AS (SELECT seq, ts, unnest(results) AS r, generate_subscripts(results, 1) AS pos FROM checks)
SELECT file, seq, ts FROM (SELECT r.file AS file, seq, ts, r.correct AS correct, row_number() OVER (PARTITION BY r.file ORDER BY ts DESC, seq DESC, pos DESC) AS place FROM e WHERE r.status = 'ok') WHERE place = 1 AND NOT coalesce(correct, true)""")
def q_still_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return still_wrong(checks(events_as_log(spark, sf_dir)))


def training_gate(checks: DataFrame, least: float = ACCURACY_GATE) -> DataFrame:
    """One row: accuracy of the last check to arrive and whether training may go on; without a check it may not."""
    right = F.size(F.filter("results", lambda r: (r["status"] == "ok") & F.coalesce(r["correct"], F.lit(True))))
    ran = F.size(F.filter("results", lambda r: r["status"] == "ok"))
    last = checks.agg(F.max_by(F.struct(right.alias("right"), ran.alias("ran")), "seq").alias("x"))
    accuracy = F.coalesce(F.round(F.try_divide("x.right", "x.ran"), 4), F.lit(0.0))
    return last.select(accuracy.alias("accuracy"), (accuracy >= least).alias("passed"))


@query(f"""WITH {LOG}, {CHECKS}, l AS (SELECT arg_max(results, seq) AS r FROM checks), n AS (SELECT len(list_filter(r, lambda x: x.status = 'ok')) AS ran, len(list_filter(r, lambda x: x.status = 'ok' AND coalesce(x.correct, true))) AS good FROM l),
a AS (SELECT CASE WHEN coalesce(ran, 0) = 0 THEN 0.0 ELSE round(good / ran, 4) END AS accuracy FROM n) SELECT accuracy, accuracy >= {ACCURACY_GATE} AS passed FROM a""")
def q_training_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_gate(checks(events_as_log(spark, sf_dir)))


def filtered_history(runs: DataFrame, verdict: str = "all", category: str = "all", competitor: str = "all") -> DataFrame:
    """Runs of a verdict, a category and a competitor; ``all`` lets any pass."""
    for name, wanted in (("verdict", verdict), ("category", category), ("competitor", competitor)):
        if wanted != "all":
            runs = runs.filter(F.col(name) == wanted)
    return runs


@query(f"WITH {LOG} SELECT 'verdict' AS filter, count(*) AS n FROM live WHERE verdict = 'HOLD' UNION ALL SELECT 'both', count(*) FROM live WHERE verdict = 'STAY' AND category = 'crm' UNION ALL SELECT 'all', count(*) FROM live")
def q_history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs pass some settings of the history's filters."""
    runs = live_runs(events_as_log(spark, sf_dir))
    settings = {"verdict": {"verdict": "HOLD"}, "both": {"verdict": "STAY", "category": "crm"}, "all": {}}
    found = [filtered_history(runs, **s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n") for name, s in settings.items()]
    return found[0].union(found[1]).union(found[2])


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't empty, in order."""
    return df.select(column).filter(F.col(column) != "").distinct().orderBy(column)


@query(f"WITH {LOG} SELECT DISTINCT category FROM live WHERE category <> ''")
def q_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options(live_runs(events_as_log(spark, sf_dir)), "category")


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "SWITCH", 0).when(verdict == "HOLD", 1).when(verdict == "STAY", 2).otherwise(3)


RANK = "CASE verdict WHEN 'SWITCH' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'STAY' THEN 2 ELSE 3 END"


@query(f"WITH {LOG}, {LATEST} SELECT CAST(row_number() OVER (ORDER BY {RANK}, coalesce(prob, 0) DESC, competitor) AS BIGINT) AS place, competitor, verdict, prob FROM latest")
def q_verdict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest verdicts, SWITCH before HOLD before STAY, the surest first."""
    rows = latest_runs(events_as_log(spark, sf_dir)).select("competitor", "verdict", "prob")
    return ranked(rows, "place", verdict_rank(F.col("verdict")), F.coalesce("prob", F.lit(0.0)).desc(), F.asc("competitor"))


SORTS = ["name", "cost_desc", "cost_asc", "last_verdict", "last_run_desc"]


def competitor_order(mode: str) -> list[Column]:
    """Order of the registry (name, cost, verdict, ts) in each mode of the list; unknown costs come last, ties by name."""
    name = F.asc("name")
    return {
        "name": [name],
        "cost_desc": [F.coalesce("cost", F.lit(-1.0)).desc(), name],
        "cost_asc": [F.coalesce("cost", F.lit(float("inf"))).asc(), name],
        "last_verdict": [verdict_rank(F.col("verdict")).asc(), F.desc_nulls_last("ts"), name],
        "last_run_desc": [F.desc_nulls_last("ts"), name],
    }[mode]


@query(f"""WITH {LOG}, {LATEST}, c AS (SELECT s_name AS name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS cost, verdict, ts FROM supplier LEFT JOIN latest ON competitor = 'c' || s_suppkey)
SELECT 'name' AS mode, name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS place FROM c UNION ALL SELECT 'cost_desc', name, row_number() OVER (ORDER BY coalesce(cost, -1) DESC, name) FROM c
UNION ALL SELECT 'cost_asc', name, row_number() OVER (ORDER BY cost ASC NULLS LAST, name) FROM c UNION ALL SELECT 'last_verdict', name, row_number() OVER (ORDER BY {RANK}, ts DESC NULLS LAST, name) FROM c
UNION ALL SELECT 'last_run_desc', name, row_number() OVER (ORDER BY ts DESC NULLS LAST, name) FROM c""")
def q_registry_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry in all five orders of its list."""
    latest = latest_runs(events_as_log(spark, sf_dir)).select("competitor", "verdict", "ts")
    c = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("double")).alias("cost"), F.concat(F.lit("c"), "s_suppkey").alias("competitor")).join(latest, "competitor", "left")
    found = [ranked(c, "place", *competitor_order(m)).select(F.lit(m).alias("mode"), "name", "place") for m in SORTS]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def filtered_registry(registry: DataFrame, search: str = "", category: str = "all", verdict: str = "all") -> DataFrame:
    """Entries (name, slug, category, verdict or null) in whose fields a text stands, of a category and a last verdict; NONE is no run."""
    told = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("slug", F.lit("")), F.coalesce("category", F.lit(""))))
    found = registry.filter(F.contains(told, F.lit(search.strip().lower())))
    found = found if category == "all" else found.filter(F.col("category") == category)
    return found if verdict == "all" else found.filter(F.coalesce("verdict", F.lit("NONE")) == verdict)


@query(f"""WITH {LOG}, {LATEST}, c AS (SELECT s_name AS name, 'c' || s_suppkey AS slug, n_name AS category, verdict FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN latest ON competitor = 'c' || s_suppkey)
SELECT name, slug, category, coalesce(verdict, 'NONE') AS verdict FROM c WHERE contains(lower(concat_ws(' ', name, slug, category)), '1') AND coalesce(verdict, 'NONE') = 'STAY'""")
def q_registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = latest_runs(events_as_log(spark, sf_dir)).select(F.col("competitor").alias("slug"), "verdict")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.expr("s_nationkey = n_nationkey"))
    registry = s.select(F.col("s_name").alias("name"), F.concat(F.lit("c"), "s_suppkey").alias("slug"), F.col("n_name").alias("category")).join(latest, "slug", "left")
    return filtered_registry(registry, " 1", verdict="STAY").select("name", "slug", "category", F.coalesce("verdict", F.lit("NONE")).alias("verdict"))


def display_keys(memos: DataFrame, slugs: DataFrame) -> DataFrame:
    """category and slug that a memo's name (column memo) shows: the longest known slug that the name goes on with, else all the rest of the name.

    A known slug is found by the prefixes of the name that end at a dash, each looked up by equality: no join by prefix.
    """
    bare = F.regexp_replace(F.regexp_replace("memo", r"^\d{4}-\d{2}-\d{2}-", ""), r"\.md$", "")
    split = memos.select("memo", bare.alias("bare")).withColumn("at", F.instr("bare", F.lit("-")))
    named = split.select("memo", F.when(F.col("at") > 0, F.substring("bare", F.lit(1), F.col("at") - 1)).alias("category"), F.when(F.col("at") > 0, F.substring("bare", F.col("at") + 1, F.length("bare"))).otherwise(F.col("bare")).alias("rest"))
    words = F.split("rest", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), "-"))
    found = named.select("memo", F.explode(prefixes).alias("slug")).join(slugs.select("slug").distinct(), "slug").groupBy("memo").agg(F.max_by("slug", F.length("slug")).alias("known"))
    return named.distinct().join(found, "memo", "left").select("memo", "category", F.when(F.col("category").isNull(), F.col("rest")).otherwise(F.coalesce("known", "rest")).alias("slug"))


@query("""WITH s AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) AS slug FROM part UNION SELECT DISTINCT lower(replace(p_brand, '#', '-')) FROM part),
n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN '2026-01-01-crm-' || lower(replace(p_brand, '#', '-')) || '-pull_dominant.md' WHEN 1 THEN '2026-01-01-hr-' || lower(replace(p_brand, '#', '')) || '.md' ELSE lower(p_brand) || '.md' END AS memo FROM part),
b AS (SELECT memo, regexp_replace(regexp_replace(memo, '^[0-9]{4}-[0-9]{2}-[0-9]{2}-', ''), '\\.md$', '') AS bare FROM n),
k AS (SELECT memo, CASE WHEN strpos(bare, '-') > 0 THEN left(bare, strpos(bare, '-') - 1) END AS category, CASE WHEN strpos(bare, '-') > 0 THEN substr(bare, strpos(bare, '-') + 1) ELSE bare END AS rest FROM b),
f AS (SELECT memo, arg_max(slug, len(slug)) AS known FROM k JOIN s ON rest = slug OR starts_with(rest, slug || '-') GROUP BY memo)
SELECT k.memo, category, CASE WHEN category IS NULL THEN rest ELSE coalesce(known, rest) END AS slug FROM k LEFT JOIN f USING (memo)""")
def q_display_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys shown for names of memos, with slugs that hold dashes and scenarios after them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    plain, dashed = F.regexp_replace("brand", "#", ""), F.regexp_replace("brand", "#", "-")
    slugs = p.select(plain.alias("slug")).union(p.select(dashed)).distinct()
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("2026-01-01-crm-"), dashed, F.lit("-pull_dominant.md"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("2026-01-01-hr-"), plain, F.lit(".md"))).otherwise(F.concat("brand", F.lit(".md")))
    return display_keys(p.select(name.alias("memo")).distinct(), slugs)

