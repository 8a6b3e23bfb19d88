"""Evaluation of verdicts: accuracy, confidence, order statistics, distributions, rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebrush.functions.confidence import entropy_bits, margin, normalised
from sagebrush.functions.text import numbered_verdicts, reward
from sagebrush.operators.sampling import order_statistics, stratified

from .registry import query, table

CASES = """cases AS (
    SELECT d.doc_id, d.lang AS scenario, d.source, l.quality AS expected,
           CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS actual,
           CASE WHEN d.doc_id % 5 <> 0 THEN (d.n_chars % 1000) / 1000.0 END AS prob
    FROM documents d JOIN labels l USING (doc_id) WHERE d.lang <> 'ambiguous')"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluated cases: scenario, expected and actual class, confidence."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.filter("lang <> 'ambiguous'").join(labels, "doc_id").select(
        "doc_id",
        F.col("lang").alias("scenario"),
        "source",
        F.col("quality").alias("expected"),
        F.when(F.col("doc_id") % 11 == 0, None).when(F.col("n_chars") >= 400, 1).otherwise(0).alias("actual"),
        F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") % 1000) / 1000.0).alias("prob"),
    )


def accuracy(df: DataFrame, *keys: str) -> DataFrame:
    """Cases, correct ones, well-formed ones and their share; a missing verdict is wrong."""
    right = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_correct"), F.count("actual").alias("n_formed"), F.round(F.avg(right.cast("int")), 4).alias("accuracy"))


@query(f"WITH {CASES} SELECT scenario, count(*) AS n, count(*) FILTER (expected = actual) AS n_correct, count(actual) AS n_formed, round(avg(CASE WHEN expected = actual THEN 1 ELSE 0 END), 4) AS accuracy FROM cases GROUP BY scenario")
def q_accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(cases(spark, sf_dir), "scenario")


@query(f"WITH {CASES}, s AS (SELECT count(*) AS n, count(*) FILTER (expected = actual) AS c FROM cases) SELECT n, c AS n_correct, CASE WHEN n = 0 THEN 0.0 ELSE round(c / n, 4) END AS accuracy, CASE WHEN c >= 0.9 * n THEN 'good' WHEN c >= 0.75 * n THEN 'fair' ELSE 'poor' END AS band FROM s")
def q_canary_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall accuracy, 0 without cases, and its band."""
    s = accuracy(cases(spark, sf_dir)).select("n", "n_correct", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    return s.withColumn("band", F.when(F.col("n_correct") >= 0.9 * F.col("n"), "good").when(F.col("n_correct") >= 0.75 * F.col("n"), "fair").otherwise("poor"))


@query(f"WITH {CASES} SELECT round(avg(prob * 100), 4) AS mean_pct, round(avg(prob * 100) FILTER (expected = actual), 4) AS mean_correct_pct, round(avg(prob * 100) FILTER (expected IS DISTINCT FROM actual), 4) AS mean_wrong_pct FROM cases")
def q_confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of all, of correct and of wrong cases, without those that have none."""
    right = F.col("expected").eqNullSafe(F.col("actual"))
    mean = lambda c: F.round(F.avg(c), 4)
    pct = F.col("prob") * 100
    return cases(spark, sf_dir).agg(mean(pct).alias("mean_pct"), mean(F.when(right, pct)).alias("mean_correct_pct"), mean(F.when(~right, pct)).alias("mean_wrong_pct"))


@query("WITH s AS (SELECT list_sort(list(n_chars // 4)) AS v, count(*) AS n, min(n_chars // 4) AS min_value, max(n_chars // 4) AS max_value FROM documents) SELECT n, min_value, v[n // 2 + 1] AS median, v[CAST(least(n - 1, floor(n * 0.95)) AS BIGINT) + 1] AS p95, max_value FROM s")
def q_order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_statistics(table(spark, sf_dir, "documents").select(F.floor(F.col("n_chars") / 4).alias("n_tokens")), "n_tokens")


@query("WITH s AS (SELECT count(*) AS n_over, list_sort(list(doc_id))[1:5] AS first_ids FROM documents WHERE n_chars // 4 > 1000) SELECT n_over, array_to_string(first_ids, ',') AS first_ids FROM s")
def q_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over a token limit and the first five of them."""
    over = table(spark, sf_dir, "documents").filter(F.floor(F.col("n_chars") / 4) > 1000)
    first = over.select("doc_id").orderBy("doc_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_ids"))
    return over.agg(F.count(F.lit(1)).alias("n_over")).join(F.broadcast(first))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id),
p AS (SELECT user_id, list_transform([a, b, c], lambda x: x / (a + b + c)) AS p FROM c WHERE a + b + c > 0)
SELECT user_id, round(list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END)), 6) AS bits, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS margin FROM p""")
def q_entropy_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy and margin of each user's distribution over three kinds of event."""
    n = lambda t: F.count_if(F.col("event_type") == t).cast("double")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array(n("purchase"), n("view"), n("click")).alias("w"))
    p = c.filter(F.aggregate("w", F.lit(0.0), lambda a, x: a + x) > 0).select("user_id", normalised(F.col("w")).alias("p"))
    return p.select("user_id", F.round(entropy_bits(F.col("p")), 6).alias("bits"), F.round(margin(F.col("p")), 6).alias("margin"))


@query("""SELECT doc_id, lang, place FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS BIGINT) AS place FROM documents) WHERE place <= 25""")
def q_stratified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 25, 42, "doc_id")


@query("""WITH s AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN 'SWITCH' WHEN 'view' THEN 'STAY' ELSE 'HOLD' END ORDER BY event_id) AS said FROM events GROUP BY user_id)
SELECT user_id, CAST(len(said) AS BIGINT) AS n, round(len(list_filter(said[1:4], lambda x: x = 'SWITCH')) / 4.0, 6) AS reward FROM s""")
def q_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of four expected verdicts that a numbered answer meets."""
    said = F.when(F.col("event_type") == "purchase", "SWITCH").when(F.col("event_type") == "view", "STAY").otherwise("HOLD")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", said.alias("v"))
    # The reward reads four verdicts; of a user with many more, no task keeps more than these.
    first = e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("place <= 4")
    first = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).alias("s"))
    e = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(first, "user_id")
    answer = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] because.\n**VERDICT:** "), x["v"])), "\n")
    expected = F.array(*[F.lit("SWITCH")] * 4)
    return e.select("user_id", "n", F.round(reward(numbered_verdicts(answer, 4), expected), 6).alias("reward"))
