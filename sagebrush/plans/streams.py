"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.operators.latest import runs_of_marker
from sagebrush.operators.order import checkpoint_folder, until_exit
from sagebrush.sources.arrival import arrived_jsonl
from sagebrush.streaming import live

from .registry import query, table


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream: a folder's files, or the one file by its name."""
    return live.read_log(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def q_stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that the watermark has closed."""
    return live.drained(live.daily(events_stream(spark, sf_dir))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def q_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.latest_per_key(events_stream(spark, sf_dir), "user_id"), complete=True).select("user_id", "event_id", "event_type", "value")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start FROM events, range(2) r(k))
SELECT start, count(*) AS n FROM w WHERE start + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY start""")
def q_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours every six that the watermark has closed."""
    return live.drained(live.sliding(events_stream(spark, sf_dir), "12 hours", "6 hours")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM (SELECT DISTINCT event_id FROM events)")
def q_stream_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stream read twice leaves, once replays are dropped."""
    twice = events_stream(spark, sf_dir).select("event_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return live.drained(live.without_replays(twice, "event_id").select("event_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("""WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, closed after six hours without an event."""
    s = live.drained(live.sessions(events_stream(spark, sf_dir), "user_id", "6 hours"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH m AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS marker_seq FROM events GROUP BY user_id)
SELECT e.user_id, any_value(marker_seq) AS marker_seq, count(*) FILTER (event_type <> 'purchase' AND event_id > coalesce(marker_seq, -1)) AS n_since,
    count(*) FILTER (event_type <> 'purchase' AND event_id > coalesce(marker_seq, -1)) >= 10 AS due FROM events e JOIN m ON m.user_id IS NOT DISTINCT FROM e.user_id GROUP BY e.user_id""")
def q_stream_since_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user since the last purchase, and whether ten have come, kept by a stream in one row a user."""
    folder = f"{checkpoint_folder(spark)}/since-{uuid.uuid4().hex}"
    until_exit(spark, folder)
    log = events_stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "event_type")
    live.counted_since(log, "user_id", F.col("event_type") == "purchase", F.col("event_type") != "purchase", folder, f"{folder}/state").awaitTermination()
    return live.counts_store(spark, folder, "user_id", "bigint").read().withColumn("due", F.col("n_since") >= 10)


@query("SELECT event_id, user_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM events")
def q_sessions_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many purchases of its user have come up to each event."""
    log = table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    return runs_of_marker(log, F.col("event_type") == "purchase", "user_id").select(F.col("seq").alias("event_id"), "user_id", "session")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events")
def q_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of JSON lines in many files, read with the number of each line."""
    folder = f"{checkpoint_folder(spark)}/log-{uuid.uuid4().hex}"
    until_exit(spark, folder)
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.repartitionByRange(F.asc("event_id")).sortWithinPartitions("event_id").write.json(folder)
    return arrived_jsonl(spark, folder, "event_id long, event_type string").select("event_id", "seq")
