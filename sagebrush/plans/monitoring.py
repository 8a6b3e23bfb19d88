"""Monitoring of an event log of live runs, accuracy checks, human feedback and training checkpoints.

Log columns: seq, ts, type, category, competitor, verdict, prob, attempts, memo_filename, correct, stated_verdict,
actual_verdict. The functions take any such log; the registered queries read it from the table events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.operators.latest import last_rows, last_value, latest_per_key, since_marker
from sagebrush.operators.order import ranked

from .registry import query, table

REVIEW_BELOW = 0.65
TREND_ROWS, HISTORY_ROWS = 20, 10
CHECK_EVERY = 10
ACCURACY_GATE = 0.75

LIVE = "live_run"


def events_as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events in the log's shape: views, clicks and purchases are runs, sign-ups feedback, errors checks."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("event_type") == "signup", "human_feedback").when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), "dpo_checkpoint").when(F.col("event_type") == "error", "accuracy_check").otherwise("live_run").alias("type"),
        F.element_at(F.array(*map(F.lit, ("finance", "hr", "crm", "analytics", "project_mgmt"))), (F.col("user_id") % 5 + 1).cast("int")).alias("category"),
        F.concat(F.lit("c"), "user_id").alias("competitor"),
        F.when(F.col("event_type") == "purchase", "SWITCH").when(F.col("event_type") == "view", "STAY").when(F.col("event_type") == "click", "HOLD").alias("verdict"),
        F.when(F.col("value") >= 5, F.round(F.col("value") / 500, 6)).alias("prob"),
        (F.col("event_id") % 3 + 1).alias("attempts"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("m"), F.col("event_id") % 997, F.lit(".md"))).alias("memo_filename"),
        (F.col("event_id") % 3 != 0).alias("correct"),
        F.element_at(F.array(*map(F.lit, ("SWITCH", "STAY", "HOLD"))), (F.col("event_id") % 3 + 1).cast("int")).alias("stated_verdict"),
        F.element_at(F.array(*map(F.lit, ("SWITCH", "STAY", "HOLD"))), (F.col("user_id") % 3 + 1).cast("int")).alias("actual_verdict"),
    )


LOG = """log AS (
    SELECT event_id AS seq, ts,
           CASE WHEN event_type = 'signup' THEN 'human_feedback' WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'dpo_checkpoint'
                WHEN event_type = 'error' THEN 'accuracy_check' ELSE 'live_run' END AS type,
           ['finance', 'hr', 'crm', 'analytics', 'project_mgmt'][user_id % 5 + 1] AS category,
           'c' || user_id AS competitor,
           CASE event_type WHEN 'purchase' THEN 'SWITCH' WHEN 'view' THEN 'STAY' WHEN 'click' THEN 'HOLD' END AS verdict,
           CASE WHEN value >= 5 THEN round(value / 500, 6) END AS prob,
           event_id % 3 + 1 AS attempts,
           CASE WHEN event_id % 4 = 0 THEN '' ELSE 'm' || (event_id % 997) || '.md' END AS memo_filename,
           event_id % 3 <> 0 AS correct,
           ['SWITCH', 'STAY', 'HOLD'][event_id % 3 + 1] AS stated_verdict,
           ['SWITCH', 'STAY', 'HOLD'][user_id % 3 + 1] AS actual_verdict
    FROM events),
live AS (
    SELECT *, coalesce(nullif(memo_filename, ''), strftime(ts, '%Y-%m-%d') || '-' || category || '-' || competitor || '.md') AS memo
    FROM log WHERE type = 'live_run')"""


def memo_key() -> Column:
    """The memo's name: as logged, or built from day, category and competitor."""
    built = F.concat(F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), "category", "competitor"), F.lit(".md"))
    return F.coalesce(F.nullif(F.col("memo_filename"), F.lit("")), built)


def live_runs(log: DataFrame) -> DataFrame:
    return log.filter(F.col("type") == LIVE).withColumn("memo", memo_key())


def stats(log: DataFrame) -> DataFrame:
    """Runs by verdict; a verdict outside the domain counts in the total only."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return live_runs(log).agg(count("SWITCH"), count("STAY"), count("HOLD"), F.count(F.lit(1)).alias("n_total"))


@query(f"WITH {LOG} SELECT count(*) FILTER (verdict = 'SWITCH') AS n_switch, count(*) FILTER (verdict = 'STAY') AS n_stay, count(*) FILTER (verdict = 'HOLD') AS n_hold, count(*) AS n_total FROM live")
def q_stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(events_as_log(spark, sf_dir))


@query(f"""WITH {LOG}, s AS (SELECT count(*) FILTER (verdict = 'SWITCH') AS a, count(*) FILTER (verdict = 'STAY') AS b, greatest(count(*), 1) AS n FROM live)
SELECT CAST(round(100.0 * a / n) AS BIGINT) AS switch_pct, CAST(round(100.0 * b / n) AS BIGINT) AS stay_pct, CAST(100 - round(100.0 * a / n) - round(100.0 * b / n) AS BIGINT) AS hold_pct FROM s""")
def q_share_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in percent that add up to 100: the last is what the others leave."""
    s = stats(events_as_log(spark, sf_dir))
    pct = lambda c: F.round(100 * F.col(c) / F.greatest("n_total", F.lit(1)))
    return s.select(pct("n_switch").cast("long").alias("switch_pct"), pct("n_stay").cast("long").alias("stay_pct"), (100 - pct("n_switch") - pct("n_stay")).cast("long").alias("hold_pct"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    """The last n runs by time, newest first; of equal times the last to arrive comes first."""
    return last_rows(live_runs(log), n, F.desc("ts"), F.desc("seq"))


@query(f"WITH {LOG} SELECT seq, ts, competitor, verdict, memo FROM live ORDER BY ts DESC, seq DESC LIMIT 20")
def q_recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(events_as_log(spark, sf_dir)).select("seq", "ts", "competitor", "verdict", "memo")


@query(f"WITH {LOG} SELECT seq, ts, category, competitor, verdict, prob, memo FROM live")
def q_history_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, newest first; of equal times the first to arrive comes first."""
    return live_runs(events_as_log(spark, sf_dir)).select("seq", "ts", "category", "competitor", "verdict", "prob", "memo").orderBy(F.desc("ts"), "seq")


LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY competitor ORDER BY ts DESC, seq) AS r, min(seq) OVER (PARTITION BY competitor) AS first_seq FROM live WHERE competitor <> '') WHERE r = 1)"""


def latest_runs(log: DataFrame) -> DataFrame:
    """The latest run of each competitor, with the place of its first run; runs without a competitor don't count."""
    runs = live_runs(log).filter(F.col("competitor") != "")
    rest = [c for c in runs.columns if c != "competitor"]
    found = runs.groupBy("competitor").agg(F.max_by(F.struct(*rest), F.struct("ts", -F.col("seq"))).alias("_row"), F.min("seq").alias("first_seq"))
    return found.select("competitor", *(F.col("_row")[c].alias(c) for c in rest), "first_seq")


@query(f"WITH {LOG}, {LATEST} SELECT competitor, seq, ts, verdict, prob, first_seq FROM latest")
def q_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_runs(events_as_log(spark, sf_dir)).select("competitor", "seq", "ts", "verdict", "prob", "first_seq")


def rankings(log: DataFrame) -> DataFrame:
    """Competitors whose latest run says SWITCH, by its probability; a missing one counts as 0."""
    switches = latest_runs(log).filter(F.col("verdict") == "SWITCH")
    return ranked(switches, "rank", F.coalesce("prob", F.lit(0.0)).desc(), F.asc("first_seq")).select("rank", "competitor", "category", "prob", "memo", "ts")


@query(f"WITH {LOG}, {LATEST} SELECT CAST(row_number() OVER (ORDER BY coalesce(prob, 0) DESC, first_seq) AS BIGINT) AS rank, competitor, category, prob, memo, ts FROM latest WHERE verdict = 'SWITCH'")
def q_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings(events_as_log(spark, sf_dir))


def review_queue(log: DataFrame, below: float = REVIEW_BELOW) -> DataFrame:
    """Latest runs of memos under ``below`` that nobody has reviewed, least certain first; 0 sorts as 1."""
    newest = latest_per_key(live_runs(log), "memo").filter(F.col("prob") < below)
    reviewed = log.filter(F.col("type") == "human_feedback").select(F.col("memo_filename").alias("memo")).distinct()
    return newest.join(reviewed, "memo", "left_anti").select("memo", "seq", "competitor", "verdict", "prob").orderBy(F.when(F.col("prob") == 0, 1.0).otherwise(F.col("prob")), "seq")


@query(f"""WITH {LOG}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memo ORDER BY ts DESC, seq) AS r FROM live) WHERE r = 1)
SELECT memo, seq, competitor, verdict, prob FROM newest n WHERE prob < {REVIEW_BELOW}
AND NOT EXISTS (SELECT 1 FROM log f WHERE f.type = 'human_feedback' AND f.memo_filename = n.memo)""")
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queue(events_as_log(spark, sf_dir))


def active_holds(log: DataFrame, notes: DataFrame) -> DataFrame:
    """Competitors whose latest run says HOLD, newest first, with the note (category, note) of their category."""
    holds = latest_runs(log).filter(F.col("verdict") == "HOLD")
    return holds.join(notes, "category", "left").select("competitor", "category", "ts", "memo", "note", "first_seq").orderBy(F.desc("ts"), "first_seq")


@query(f"""WITH {LOG}, {LATEST}, notes AS (SELECT lower(r_name) AS note, ['finance', 'hr', 'crm', 'analytics', 'other'][r_regionkey + 1] AS category FROM region)
SELECT competitor, category, ts, memo, note, first_seq FROM latest LEFT JOIN notes USING (category) WHERE verdict = 'HOLD'""")
def q_active_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("finance", "hr", "crm", "analytics", "other")))
    notes = table(spark, sf_dir, "region").select(F.lower("r_name").alias("note"), F.element_at(names, F.col("r_regionkey") + 1).alias("category"))
    return active_holds(events_as_log(spark, sf_dir), notes)


def accuracy_due(log: DataFrame, every: int = CHECK_EVERY) -> DataFrame:
    """Runs since the last accuracy check, by arrival, and whether a check is due."""
    runs = since_marker(log, F.col("type") == "accuracy_check").filter(F.col("type") == LIVE)
    return runs.agg(F.count(F.lit(1)).alias("n_since")).withColumn("due", F.col("n_since") >= every)


@query(f"""WITH {LOG} SELECT count(*) AS n_since, count(*) >= {CHECK_EVERY} AS due FROM live
WHERE seq > coalesce((SELECT max(seq) FROM log WHERE type = 'accuracy_check'), -1)""")
def q_since_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_due(events_as_log(spark, sf_dir))


def corrections(log: DataFrame) -> DataFrame:
    """Feedback that corrects a verdict; ``correct`` missing counts as true."""
    wrong = ~F.coalesce("correct", F.lit(True)) & ~F.col("stated_verdict").eqNullSafe(F.col("actual_verdict"))
    return log.filter((F.col("type") == "human_feedback") & wrong)


def feedback_queue(log: DataFrame) -> DataFrame:
    """Latest correction of each memo after the last checkpoint: the checkpoint is the last to arrive, its ts the cutoff."""
    cutoff = last_value(log, "ts", F.col("type") == "dpo_checkpoint").withColumnRenamed("ts", "cutoff")
    new = corrections(log).join(F.broadcast(cutoff), F.coalesce(F.col("ts") > F.col("cutoff"), F.lit(True)))
    return latest_per_key(new.filter(F.col("memo_filename") != ""), "memo_filename").select("memo_filename", "seq", "stated_verdict", "actual_verdict")


@query(f"""WITH {LOG}, cut AS (SELECT arg_max(ts, seq) AS cutoff FROM log WHERE type = 'dpo_checkpoint'),
new AS (SELECT log.* FROM log, cut WHERE type = 'human_feedback' AND NOT coalesce(correct, true) AND stated_verdict IS DISTINCT FROM actual_verdict AND memo_filename <> '' AND coalesce(ts > cutoff, true))
SELECT memo_filename, seq, stated_verdict, actual_verdict FROM (SELECT *, row_number() OVER (PARTITION BY memo_filename ORDER BY ts DESC, seq) AS r FROM new) WHERE r = 1""")
def q_feedback_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_queue(events_as_log(spark, sf_dir))


def confidence_trend(log: DataFrame, n: int = TREND_ROWS) -> DataFrame:
    """The last n runs by arrival, and of these the ones with a probability."""
    return last_rows(live_runs(log), n, F.desc("seq")).filter(F.col("prob").isNotNull()).select("seq", "ts", "prob").orderBy("seq")


@query(f"WITH {LOG} SELECT seq, ts, prob FROM (SELECT * FROM live ORDER BY seq DESC LIMIT {TREND_ROWS}) WHERE prob IS NOT NULL")
def q_health_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence_trend(events_as_log(spark, sf_dir))


def health(log: DataFrame) -> DataFrame:
    """Attempts at first pass, low and mean confidence of the last 100 runs by arrival."""
    last = last_rows(live_runs(log), 100, F.desc("seq"))
    return last.agg(F.round(F.avg("prob"), 6).alias("mean_prob"), F.count_if(F.col("prob") < REVIEW_BELOW).alias("n_low"), F.count_if(F.col("attempts") == 1).alias("n_first_pass"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT round(avg(prob), 6) AS mean_prob, count(*) FILTER (prob < {REVIEW_BELOW}) AS n_low, count(*) FILTER (attempts = 1) AS n_first_pass, count(*) AS n FROM (SELECT * FROM live ORDER BY seq DESC LIMIT 100)")
def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(events_as_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT seq, ts, type FROM log WHERE type IN ('accuracy_check') ORDER BY seq DESC LIMIT {HISTORY_ROWS}")
def q_accuracy_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last accuracy checks by arrival, oldest first."""
    checks = events_as_log(spark, sf_dir).filter(F.col("type") == "accuracy_check")
    return last_rows(checks, HISTORY_ROWS, F.desc("seq")).select("seq", "ts", "type").orderBy("seq")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def q_json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON payload; text that isn't JSON gives null."""
    e = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH s AS (SELECT s_suppkey, s_name, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
last AS (SELECT l_suppkey, l_returnflag AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1)
SELECT s_suppkey, s_name, n_name, coalesce(verdict, 'NONE') AS verdict, CAST(row_number() OVER (ORDER BY CASE coalesce(verdict, 'NONE') WHEN 'R' THEN 0 WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, coalesce(s_acctbal, -1) DESC, s_suppkey) AS BIGINT) AS place
FROM s LEFT JOIN last ON s_suppkey = l_suppkey""")
def q_registry_left_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with each entry's latest verdict, or NONE, in the order of the list view."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    runs = table(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", -F.col("l_orderkey"), -F.col("l_linenumber"))
    last = runs.groupBy("l_suppkey").agg(F.max_by("l_returnflag", order).alias("verdict"))
    rows = s.join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("verdict", F.coalesce("verdict", F.lit("NONE")))
    kind = F.when(F.col("verdict") == "R", 0).when(F.col("verdict") == "N", 1).when(F.col("verdict") == "A", 2).otherwise(3)
    return ranked(rows, "place", kind, F.coalesce("s_acctbal", F.lit(-1.0)).desc(), F.asc("s_suppkey")).select("s_suppkey", "s_name", "n_name", "verdict", "place")


@query("SELECT count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM events WHERE event_type = 'purchase' AND lower(concat_ws(' ', event_type, user_id, props)) LIKE '%1%'")
def q_registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one kind in whose fields a text occurs."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return e.filter(F.contains(F.lower(F.concat_ws(" ", "event_type", "user_id", "props")), F.lit("1"))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))
