"""Ties, nulls and invariants of the log, matching and sampling operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sagebrush.operators.latest import latest_per_key, since_marker
from sagebrush.operators.matching import best_match, first_of_each
from sagebrush.operators.sampling import balanced, diverse, diverse_rounds, grouped_split, interleaved_batches, order_statistics, stratified
from sagebrush.plans import monitoring as M

LOG = "seq long, ts timestamp_ntz, type string, category string, competitor string, verdict string, prob double, attempts long, memo_filename string, correct boolean, stated_verdict string, actual_verdict string"


def at(hour):
    return datetime(2026, 4, 12, hour)


def log(spark, *rows):
    made = [(i, at(h), kind, *rest, *[None] * (9 - len(rest))) for i, (h, kind, *rest) in enumerate(rows)]
    return spark.createDataFrame(made, LOG)


def test_monitoring_log(spark):
    runs = log(
        spark,
        (10, "live_run", "finance", "acme", "SWITCH", 0.91, 1, "a.md"),
        (11, "live_run", "hr", "bolt", "HOLD", 0.78, 1, "b.md"),
        (12, "live_run", "crm", "comet", "STAY", 0.55, 1, ""),
        (13, "accuracy_check"),
    )
    assert M.stats(runs).first().asDict() == {"n_switch": 1, "n_stay": 1, "n_hold": 1, "n_total": 3}
    assert [r.competitor for r in M.recent(runs).collect()] == ["comet", "bolt", "acme"]
    assert M.recent(runs, 2).count() == 2
    assert [r.competitor for r in M.rankings(runs).collect()] == ["acme"]
    assert [r.memo for r in M.review_queue(runs).collect()] == ["2026-04-12-crm-comet.md"]
    assert M.accuracy_due(runs).first().n_since == 0
    assert M.stats(runs.limit(0)).first().n_total == 0
    assert M.feedback_queue(runs).count() == 0


def test_feedback(spark):
    f = ("human_feedback", None, None, None, None, None)
    rows = log(spark, (1, *f, "m", False, "SWITCH", "STAY"), (2, *f, "n", True, "STAY", "STAY"), (3, *f, "o", False, "STAY", "STAY"), (4, *f, "p", None, "STAY", "HOLD"))
    assert [r.memo_filename for r in M.feedback_queue(rows).collect()] == ["m"]
    later = log(spark, (1, *f, "m", False, "SWITCH", "STAY"), (2, "dpo_checkpoint"), (3, *f, "q", False, "SWITCH", "STAY"))
    assert [r.memo_filename for r in M.feedback_queue(later).collect()] == ["q"]


def test_ties(spark):
    rows = spark.createDataFrame([(0, "a", at(1), 1), (1, "a", at(1), 2), (2, "b", at(1), 3)], "seq long, k string, ts timestamp_ntz, v int")
    assert {r.k: r.v for r in latest_per_key(rows, "k").collect()} == {"a": 1, "b": 3}
    assert {r.k: r.v for r in latest_per_key(rows, "k", last_wins=True).collect()} == {"a": 2, "b": 3}
    assert since_marker(rows, F.col("v") == 2).count() == 1
    assert since_marker(rows, F.col("v") == 9).count() == 3


def test_best_match(spark):
    issues = spark.createDataFrame([(1, 0, "export of audit log missing"), (1, 1, "slack sync fails")], "k int, pos int, text string")
    changes = spark.createDataFrame([(1, 0, "audit log export added"), (1, 1, "api sync to slack"), (2, 0, "x")], "k int, pos int, text string")
    r = best_match(issues, changes, "k").first()
    assert (r.k, r.issue_pos, r.change_pos) == (1, 1, 1)


def test_first_of_each(spark):
    rows = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "i int, t string")
    assert sorted(r.i for r in first_of_each(rows, "t", "i").collect()) == [1, 3]


def test_sampling(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("s"))
    assert {r["count"] for r in stratified(rows, "g", 5, 1, "id").groupBy("g").count().collect()} == {5}
    assert {r["count"] for r in balanced(rows, "g", 1, "id").groupBy("g").count().collect()} == {33}
    split = grouped_split(rows, ["g"], "s", 0.15, 1)
    assert split.count() == 100
    assert split.groupBy("g", "s").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r.n for r in split.filter("split = 'val'").groupBy("g").agg(F.count_distinct("s").alias("n")).collect()} == {1}
    batches = interleaved_batches(rows, "s", 3, 1, "id").groupBy("round", "part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("k")).collect()
    assert batches and all((b.n, b.k) == (3, 3) for b in batches)
    for few in (1, 2):
        small = rows.filter(F.col("s") < few)
        assert grouped_split(small, ["g"], "s", 0.15, 1).filter("split = 'val'").count() == 0


def test_diverse(spark):
    rows = spark.createDataFrame([(i, 0, "a" if i < 8 else "b", i % 2) for i in range(10)], "id int, g int, x string, y int")
    for choose in (diverse, diverse_rounds):
        taken = choose(rows, "g", ["x", "y"], 4, "id").collect()
        assert len(taken) == 4 and sum(r.x == "b" for r in taken) == 2


def test_diverse_reads_bounded_groups(spark):
    """A hot group is cut to a few rows of each combination before it goes to one task, and the choice stays exact."""
    rows = [(i, 0, "abc"[i * i % 3], i % 5 // 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, x string, y int")
    chosen = diverse(df, "g", ["x", "y"], 7, "id")
    assert "WindowGroupLimit" in chosen._jdf.queryExecution().executedPlan().toString()
    used, wanted = {}, []
    while len(wanted) < 7:
        best = min((r for r in rows if r not in wanted), key=lambda r: (used.get(("x", r[2]), 0), used.get(("y", r[3]), 0), r[0]))
        wanted.append(best)
        for k in (("x", best[2]), ("y", best[3])):
            used[k] = used.get(k, 0) + 1
    assert sorted(map(tuple, chosen.collect())) == sorted(wanted)


def test_order_statistics(spark):
    r = order_statistics(spark.range(1, 101).toDF("v"), "v").first()
    assert (r.n, r.p95, r.max_value) == (100, 96, 100)
