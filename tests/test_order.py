"""Numbers along a global order over many parts, with hot and null keys; counters of a stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sagebrush.operators.order import rank_within, ranked, running_total
from sagebrush.streaming import live


def test_ranks(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(7)
    order = [F.desc("v"), F.asc("id")]
    key = lambda r: (-r[2], r[0])
    assert {r.id: r.n for r in ranked(df, "n", *order).collect()} == {r[0]: i for i, r in enumerate(sorted(data, key=key), 1)}
    wanted, seen = {}, {}
    for r in sorted(data, key=key):
        seen[r[1]] = seen.get(r[1], 0) + 1
        wanted[r[0]] = seen[r[1]]
    assert {r.id: r.n for r in rank_within(df, "n", ["k"], *order).collect()} == wanted
    totals, at = {}, 0
    for r in sorted(data, key=key):
        at += r[2]
        totals[r[0]] = at
    assert {r.id: r.n for r in running_total(df, "n", F.col("v"), *order).collect()} == totals
    assert ranked(df.limit(0), "n", *order).count() == 0


def test_due_checks(spark, tmp_path):
    rows = [(i, "accuracy_check" if i in (3, 20) else "live_run", "crm" if i < 25 else "hr") for i in range(40)]
    schema = "seq long, type string, category string"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    run = live.due_checks(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        last[r.category] = (r.n_since, r.due)
    assert last == {"crm": (4, False), "hr": (15, True)}
