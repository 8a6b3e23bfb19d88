"""Training data from end to end: prompts, memos, analyses by template, attempts that pass, harvested pairs, held-out sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import render
from sagebrush.functions import signals as S
from sagebrush.functions import text as X
from sagebrush.functions import traces as T
from sagebrush.functions import words as W
from sagebrush.operators.sampling import diverse_rounds

from .agent import PRICED, context, decided
from .memos import CHECKS, checks, still_wrong
from .monitoring import LOG, events_as_log, feedback_queue
from .registry import query, table
from .signals import RULES, SIGNALS, one_of, one_of_sql, pick, pick_sql, signals, with_rules
from .traces import ANALYSIS, VERDICTS, answers, flipped_pairs

_IDS = "(SELECT DISTINCT doc_id FROM documents)"
DAY = "2026-01-15"


def prompts(df: DataFrame) -> DataFrame:
    """``prompt`` of signals with their rules, net and seats."""
    c = F.col
    fields = {n: c(n) for n in ("category", "issues", "tool", "changes", "notes", "net", "hold", "shelfware", "disqualifier")}
    return df.withColumn("prompt", render.prompt(fields | {"tool_name": F.concat(F.lit("Tool "), c("seats").cast("string")), "saving": c("net") + 240, "met": c("net") >= W.ROI_THRESHOLD, "previous": F.coalesce("previous", F.lit("none"))}))


@query(f"""WITH {RULES} SELECT doc_id, category, 'Tool ' || seats AS tool, array_to_string(issues, '|') AS issues, array_to_string(sig_tool, '|') AS tool_lines, array_to_string(changes, '|') AS competitor_lines, array_to_string(notes, '|') AS notes,
hold, unused AS shelfware, disq AS disqualifier, coalesce(previous, 'none') AS previous_verdict, net + 240 AS annual_saving, net, net >= 1200 AS threshold_met FROM (SELECT *, tool AS sig_tool FROM ruled)""")
def q_prompt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as prompts and read back."""
    df = prompts(with_rules(signals(spark, sf_dir))).select("doc_id", T.parsed_prompt(F.col("prompt")).alias("p"), T.prompt_roi(F.col("prompt")).alias("r"))
    joined = lambda c: F.array_join(f"p.{c}", "|").alias(c)
    return df.select(
        "doc_id", "p.category", "p.tool", joined("issues"), joined("tool_lines"), joined("competitor_lines"), joined("notes"), "p.hold", "p.shelfware", "p.disqualifier", "p.previous_verdict",
        "r.annual_saving", "r.net", "r.threshold_met",
    )


def memos_of(decisions: DataFrame, date: Column) -> DataFrame:
    """``memo`` of each decision."""
    c = F.col
    fields = {n: c(n) for n in ("category", "price", "roi", "verdict")}
    fields |= {"tool_name": F.lit("Tool"), "cost": c("current"), "competitor": c("slug"), "date": date, "push": c("tool"), "pull": c("changes"), "evidence": F.coalesce(F.get("changes", 0), F.get("notes", 0), F.lit("none")), "condition": c("hold")}
    return decisions.withColumn("memo", render.memo(fields))


@query(f"WITH {PRICED} SELECT d.doc_id, 0 AS n_errors, d.verdict, CASE WHEN d.verdict = 'HOLD' THEN r.hold END AS reassess_condition, CASE WHEN d.verdict = 'HOLD' THEN '2026-04-17' END AS review_by FROM decided d JOIN ruled r USING (doc_id)")
def q_memos_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos of decisions: their errors, and the verdict and hold that are read from them."""
    m = memos_of(decided(context(spark, sf_dir)), F.to_date(F.lit(DAY)))
    held = X.hold_metadata(F.col("memo"))
    return m.select("doc_id", F.size(X.memo_errors(F.col("memo"))).alias("n_errors"), X.verdict(F.col("memo")).alias("verdict"), held["reassess_condition"].alias("reassess_condition"), held["review_by"].alias("review_by"))


#: Analyses of this library's own; a caller brings its own table.
TEMPLATES = [
    ("STAY", 0, "Stay with the tool: {scenario} with {seats} seats gives no case."), ("STAY", 1, "No case for a change in {category}."), ("STAY", 2, "{scenario}: stay, net {net}."),
    ("SWITCH", 0, "Switch in {category}: net {net}."), ("SWITCH", 1, "{scenario} calls for a switch."), ("HOLD", 0, "Hold until the condition of {scenario} is met."),
]
_TEMPLATE_SQL = "CASE verdict " + " ".join(f"WHEN '{v}' THEN [{', '.join(chr(39) + t + chr(39) for k, _, t in TEMPLATES if k == v)}][doc_id % {sum(k == v for k, _, _ in TEMPLATES)} + 1]" for v in VERDICTS) + " END"


@query(f"WITH {SIGNALS}, v AS (SELECT *, {one_of_sql([*VERDICTS, 'NONE'], 'verdict')} AS verdict FROM sig) SELECT doc_id, verdict, replace(replace(replace(replace({_TEMPLATE_SQL}, '{{scenario}}', scenario), '{{seats}}', CAST(seats AS VARCHAR)), '{{category}}', category), '{{net}}', CAST(net AS VARCHAR)) AS text FROM v")
def q_templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses by template, taken in turn."""
    df = signals(spark, sf_dir).withColumn("verdict", one_of([*VERDICTS, "NONE"], "verdict"))
    templates = spark.createDataFrame(TEMPLATES, "verdict string, variant int, template string")
    return render.templated(df, templates, "verdict", "doc_id", ["scenario", "seats", "category", "net"]).select("doc_id", "verdict", "text")


def first_valid(attempts: DataFrame, *key: str) -> DataFrame:
    """Of each case the first attempt (attempt, errors) without errors, else the last one; ``retried`` tells of more than one."""
    order = F.struct((F.size("errors") > 0).alias("bad"), F.when(F.size("errors") > 0, -F.col("attempt")).otherwise(F.col("attempt")).alias("at"))
    rest = [c for c in attempts.columns if c not in key]
    found = attempts.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return found.select(*key, "r.*").withColumn("retried", F.col("attempt") > 1)


def attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three attempts at a signal as noisy JSON; some lack fields or close their braces wrongly."""
    s = signals(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(1), 1 + pick("tries", 3))).alias("attempt"), "scenario", "notes")
    body = F.to_json(F.struct(F.lit("x").alias("category"), F.lit("c").alias("competitor"), F.lit("t").alias("current_tool"), "notes"))
    kind = (pick("kind", 4) + F.col("attempt")) % 4
    text = F.when(kind == 0, "no object").when(kind == 1, F.concat(F.lit("so: "), F.regexp_replace(body, r"\}$", ",}"), F.lit(" end"))).when(kind == 2, F.lit('{"category": "x", "notes": 3}')).otherwise(body)
    return s.select("doc_id", "attempt", "scenario", text.alias("text"))


def generated(attempts: DataFrame, *key: str) -> DataFrame:
    """Of each key the first attempt whose text holds a signal that is whole once defaults are filled in; keys without one are left out.

    The defaults are a date, empty lists and unchanged terms; the scenario is the one asked for.
    """
    payload = X.json_between(F.col("text"))
    wrong = S.type_errors(payload)
    filled = ["scenario_type", *W.SIGNAL_DEFAULTS, "competitor_changes", "current_tool_status", "notes"]
    serious = F.filter(wrong, lambda e: ~e.isin(*(f"Missing field: {n}" for n in filled)))
    made = attempts.withColumn("payload", payload).withColumn("errors", F.when(F.col("payload").isNull(), F.array(F.lit("No JSON object"))).otherwise(serious))
    found = first_valid(made, *key).filter(F.size("errors") == 0)
    text = lambda n: F.coalesce(S.string(S.field(F.col("payload"), n)), F.lit(W.SIGNAL_DEFAULTS.get(n)))
    fields = [F.col("scenario").alias("scenario_type"), *(text(n).alias(n) for n, of in W.SIGNAL_FIELDS.items() if of == "str" and n != "scenario_type"), *(S.lines(S.field(F.col("payload"), n)).alias(n) for n, of in W.SIGNAL_FIELDS.items() if of == "list")]
    return found.select(*key, "attempt", F.struct(*fields).alias("signal"))


@query(f"""WITH {SIGNALS}, a AS (SELECT doc_id, notes, unnest(range(1, 2 + {pick_sql("tries", 3)})) AS attempt, {pick_sql("kind", 4)} AS k FROM sig), g AS (SELECT doc_id, scenario, min(attempt) AS attempt FROM a JOIN (SELECT doc_id, scenario FROM sig) USING (doc_id) WHERE (k + attempt) % 4 IN (1, 3) GROUP BY ALL)
SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, scenario AS scenario_type, '2025-01-15' AS date, len(notes) AS n_notes FROM g JOIN (SELECT doc_id, notes FROM sig) USING (doc_id)""")
def q_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first attempt at each signal that passes."""
    return generated(attempted(spark, sf_dir), "doc_id").select("doc_id", "attempt", "signal.scenario_type", "signal.date", F.size("signal.notes").alias("n_notes"))


@query(f"""WITH a AS (SELECT doc_id, unnest(range(1, 3)) AS attempt, {pick_sql("first", 3)} AS k FROM {_IDS}), e AS (SELECT *, CASE WHEN attempt = 1 THEN k <> 0 ELSE k = 2 END AS bad FROM a)
SELECT doc_id, CAST(attempt AS INTEGER) AS attempt, NOT bad AS valid, attempt > 1 AS retried FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bad, CASE WHEN bad THEN -attempt ELSE attempt END) AS r FROM e) WHERE r = 1""")
def q_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which the first may be malformed, and the second too."""
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct()
    a = ids.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), pick("first", 3).alias("k"))
    bad = F.when(F.col("attempt") == 1, F.col("k") != 0).otherwise(F.col("k") == 2)
    answer = F.when(bad, "no verdict").otherwise("ANALYSIS: x\nVERDICT: STAY")
    return first_valid(a.select("doc_id", "attempt", X.lean_errors(answer).alias("errors")), "doc_id").select("doc_id", "attempt", (F.size("errors") == 0).alias("valid"), "retried")


def harvested(corrections: DataFrame, failures: DataFrame, samples: DataFrame) -> DataFrame:
    """Preference pairs of all sources: source, id, wrong_verdict, correct_verdict, chosen, rejected (null where a model has to write them)."""
    human = corrections.select(F.lit("human_feedback").alias("source"), F.col("memo_filename").alias("id"), F.col("stated_verdict").alias("wrong_verdict"), F.col("actual_verdict").alias("correct_verdict"))
    canary = failures.select(F.lit("canary").alias("source"), F.col("file").alias("id"))
    sample = samples.select(F.lit("sample").alias("source"), F.col("doc_id").cast("string").alias("id"), "wrong_verdict", "correct_verdict", "chosen", "rejected")
    return human.unionByName(canary, allowMissingColumns=True).unionByName(sample, allowMissingColumns=True)


@query(f"""WITH {LOG}, {CHECKS}, cut AS (SELECT arg_max(ts, seq) AS cutoff FROM log WHERE type = 'dpo_checkpoint'),
new AS (SELECT log.* FROM log, cut WHERE type = 'human_feedback' AND NOT coalesce(correct, true) AND stated_verdict IS DISTINCT FROM actual_verdict AND memo_filename <> '' AND coalesce(ts > cutoff, true)),
h AS (SELECT 'human_feedback' AS source, memo_filename AS id, stated_verdict AS wrong_verdict, actual_verdict AS correct_verdict FROM (SELECT *, row_number() OVER (PARTITION BY memo_filename ORDER BY ts DESC, seq) AS r FROM new) WHERE r = 1),
e AS (SELECT seq, ts, unnest(results) AS r, generate_subscripts(results, 1) AS pos FROM checks),
c AS (SELECT 'canary' AS source, file AS id, NULL AS wrong_verdict, NULL AS correct_verdict FROM (SELECT r.file AS file, r.correct AS correct, row_number() OVER (PARTITION BY r.file ORDER BY ts DESC, seq DESC, pos DESC) AS place FROM e WHERE r.status = 'ok') WHERE place = 1 AND NOT coalesce(correct, true)),
t AS (SELECT doc_id, {ANALYSIS} AS a, {one_of_sql(VERDICTS, "verdict")} AS v FROM documents), u AS (SELECT min(doc_id) AS doc_id, v FROM t GROUP BY a, v),
s AS (SELECT 'sample' AS source, CAST(doc_id AS VARCHAR) AS id, CASE v WHEN 'SWITCH' THEN 'STAY' ELSE 'SWITCH' END AS wrong_verdict, v AS correct_verdict FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY md5('42|' || doc_id), doc_id) AS place FROM u) WHERE place <= 10)
SELECT * FROM h UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s""")
def q_harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from feedback, failing canaries and traces."""
    log = events_as_log(spark, sf_dir)
    return harvested(feedback_queue(log), still_wrong(checks(log)), flipped_pairs(answers(spark, sf_dir), 30, 42, "doc_id")).select("source", "id", "wrong_verdict", "correct_verdict")


def held_out(cases: DataFrame, registry: DataFrame, per_verdict: int) -> DataFrame:
    """Cases (case_id, category, slug, expected) with their competitor's name; reading them fails if ids repeat or a verdict has another number of cases."""
    n = cases.groupBy("expected").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    ids = cases.agg((F.count(F.lit(1)) == F.count_distinct("case_id")).alias("unique"))
    sound = F.broadcast(n.join(ids).select((F.col("unique") & (F.col("low") == per_verdict) & (F.col("high") == per_verdict)).alias("sound")))
    named = cases.join(registry.select("category", "slug", "name"), ["category", "slug"]).join(sound)
    return named.withColumn("name", F.when(F.col("sound"), F.col("name")).otherwise(F.raise_error(F.lit("the held-out set isn't balanced, or its ids repeat")))).drop("sound")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) AS e0 FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_type ORDER BY e0, p_partkey) AS e1 FROM a)
SELECT p_partkey, p_size, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_size ORDER BY e1, e0, p_partkey) AS BIGINT) AS place FROM b) WHERE place <= 10""")
def q_diverse_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each size spread over brands and types, without a sequential task."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return diverse_rounds(p, "p_size", ["p_brand", "p_type"], 10, "p_partkey").select("p_partkey", "p_size", "place")
