"""Round trips of the sinks, done twice where that must change nothing."""

from __future__ import annotations

import json

from pyspark.sql import Row

from sagebrush.sources import logs, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_summaries(spark, tmp_path):
    store = sinks.Store(spark, f"{tmp_path}/s", sinks.SUMMARIES)
    assert store.read().count() == 0
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], sinks.SUMMARIES)
    for _ in range(2):
        store.insert_absent(new, "memo")
        assert rows(store.read()) == [("a", "1"), ("b", "2")]
    store.insert_absent(spark.createDataFrame([("a", "other"), ("c", "3")], sinks.SUMMARIES), "memo")
    assert rows(store.read()) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert store.delete(new, "memo") == 2 and store.delete(new, "memo") == 0
    assert store.clear() == 1 and store.read().count() == 0
    assert len(store.versions()) <= 2


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    store = sinks.Store(spark, f"{tmp_path}/s", sinks.SUMMARIES)
    store.replace(spark.createDataFrame([("a", "1")], sinks.SUMMARIES))
    (tmp_path / "s/v=00000002").mkdir()
    (tmp_path / "s/v=00000002/part-0.parquet").write_text("not whole")
    assert rows(store.read()) == [("a", "1")]
    store.replace(spark.createDataFrame([("b", "2")], sinks.SUMMARIES))
    assert rows(store.read()) == [("b", "2")]


def test_holds_and_registry(spark, tmp_path):
    holds = sinks.Store(spark, f"{tmp_path}/h", sinks.HOLDS)
    one = spark.createDataFrame([Row(category="crm", current_tool="t", competitor="c", hold_reason="r", reassess_condition="q", review_by="2026-05-01")])
    sinks.append_holds(holds, one, "2026-02-01"), sinks.append_holds(holds, one, "2026-02-02")
    assert [r.issued_date for r in holds.read().orderBy("issued_date").collect()] == ["2026-02-01", "2026-02-02"]
    registry = sinks.Store(spark, f"{tmp_path}/r", sinks.COMPETITORS)
    entry = spark.createDataFrame([("crm", "acme", "Acme", 10.0, None)], "category string, slug string, name string, monthly_cost_gbp double, scraper_url string")
    for _ in range(2):
        sinks.add_competitors(registry, entry, "2026-02-01")
    assert [(r.slug, r.based_on, r.scraper_url, r.last_updated) for r in registry.read().collect()] == [("acme", "user-added", "", "2026-02-01")]
    assert registry.delete(entry, "category", "slug") == 1 and registry.read().count() == 0


def test_memos_and_reports(spark, tmp_path):
    memo = lambda text, slug="a_b": spark.createDataFrame([("2026-01-02", "crm", slug, text)], "date string, category string, slug string, text string")
    store = sinks.Store(spark, f"{tmp_path}/m", sinks.MEMOS, "date", "category")
    for m in (memo("one"), memo("other", "c"), memo("two")):
        sinks.write_memos(store, m)
    assert sorted((r.memo, r.date, r.text) for r in store.read().collect()) == [("2026-01-02-crm-a_b.md", "2026-01-02", "two"), ("2026-01-02-crm-c.md", "2026-01-02", "other")]
    sinks.overwrite_lines(memo("x"), f"{tmp_path}/j"), sinks.overwrite_lines(memo("y"), f"{tmp_path}/j"), sinks.report(memo("z"), f"{tmp_path}/k")
    assert spark.read.json(f"{tmp_path}/j").first().text == "y" and len(list((tmp_path / "k").glob("part-*"))) == 1
    tier, flags = "array<struct<name:string,monthly_cost_gbp:double>>", "struct<sso_saml:boolean,soc2_type2:boolean,uk_residency:boolean>"
    schema = f"category string, slug string, name string, monthly_cost_gbp double, cost_per_seat_gbp double, pricing_tiers {tier}, features array<string>, known_limitations array<string>, integration_compatibility array<string>, compliance {flags}, recent_trajectory string"
    registry = spark.createDataFrame([("crm", "a", "A", 10.0, None, [("Pro", 20.0)], ["f"], [], None, (True, None, False), None), ("hr", "b", None, None, None, None, None, None, None, None, None)], schema)
    written = spark.createDataFrame([("hr_b.md",)], "name string")
    (r,) = sinks.inbox_reports(registry, written).collect()
    assert r.name == "crm_a.md" and r.text.startswith("# A\n## Pricing\n- **Base**: £10/mo\n- **Pro**: £20/mo\n## Features\n- f\n## Limitations\n- None noted")
    assert "SSO**: Yes\n- **SOC2 Type II**: Unknown\n- **UK residency**: No" in r.text and r.text.endswith("stable")
    assert sinks.inbox_reports(registry, written.limit(0)).count() == 2


def test_feedback_requests(spark):
    df = spark.createDataFrame([("m", True, "STAY", "HOLD"), ("", None, "STAY", None)], "memo_filename string, correct boolean, stated_verdict string, actual_verdict string")
    assert [r.missing for r in sinks.feedback_events(df, "2026-01-01").collect()] == [[], ["memo_filename", "correct", "actual_verdict"]]


def test_more_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = {"messages": [{"role": r, "content": "c"} for r in ("system", "user", "assistant")]}
    (tmp_path / "a/traces.jsonl").write_text("\n".join([json.dumps(good), "bad", json.dumps({"messages": []})]))
    assert tuple(logs.trace_counts(spark, f"{tmp_path}/a").first()) == (3, 1, 1, 1)
    assert logs.json_map(spark, f"{tmp_path}/none.json").count() == 0
    (tmp_path / "rule.md").write_text("# R\n\ntext")
    assert [tuple(r) for r in logs.whole_texts(spark, f"{tmp_path}/rule.md").collect()] == [("rule.md", "# R\n\ntext")]
    entries = spark.createDataFrame([("crm", "1")], "key string, value string")
    assert logs.slice_of(entries, "crm").first().value == "1" and logs.slice_of(entries, "hr", required=False).first().value is None
    try:
        logs.slice_of(entries, "hr").collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "no entry hr" in str(e)
    inbox = spark.createDataFrame([("k", "z", "inbox")], "key string, file string, text string")
    made = spark.createDataFrame([("k", "a", "x"), ("l", "b", "second"), ("l", "a", "first")], "key string, file string, text string")
    assert sorted((r.key, r.text, r.tier) for r in logs.first_source(["key"], "file", inbox, made).collect()) == [("k", "inbox", 0), ("l", "first", 1)]
