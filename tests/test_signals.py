"""Names, payloads and validation of signals; parsing of traces."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sagebrush.functions import signals as S
from sagebrush.functions import text as X
from sagebrush.functions import traces as T
from sagebrush.functions import words as W
from sagebrush.operators.matching import best_match, semantic_view


def told(spark, column, *rows, schema="x string"):
    return [r.y for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column(F.col("x")).alias("y")).collect()]


def test_names(spark):
    found = told(spark, S.generated_name, "crm_acme_pull_dominant", "project_mgmt_a_b_both_signals", "finance_both_signals_both_signals", "crm_pull_dominant", "x_acme_pull_dominant", None)
    assert [f and tuple(f) for f in found] == [("crm", "acme", "pull_dominant"), ("project_mgmt", "a_b", "both_signals"), ("finance", "both_signals", "both_signals"), None, None, None]
    found = told(spark, S.inbox_name, "/in/finance_acme.md", "project_mgmt_boards.md", "finance_.md", "other_x.md")
    assert [f and tuple(f) for f in found] == [("finance", "acme"), ("project_mgmt", "boards"), None, None]
    with pytest.raises(Exception, match="no category"):
        told(spark, lambda c: S.inbox_name(c, strict=True), "other_x.md")


def test_loose_values(spark):
    values = [None, "null", '"  a "', '" "', '[" a", 1, "", null, "b"]', "{}", "3"]
    assert told(spark, lambda c: S.lines(F.try_parse_json(c)), *values) == [[], [], ["a"], [], ["a", "b"], [], []]
    told_compliance = ['" SOC2 met "', '[{"name": "SSO", "status": "live"}, " x ", {"a": 1}, 2]', '{"a": 1}', "null", "7"]
    assert told(spark, lambda c: S.compliance_text(F.try_parse_json(c)), *told_compliance) == ["SOC2 met", 'SSO: live; x; {"a":1}', '{"a":1}', "", ""]


def test_coercion(spark):
    rows = [
        {"compliance_changes": ["a", "", None, 2], "notes": " one ", "date": "2026-01-02"},
        {"compliance_changes": {"k": True, "l": "m"}, "notes": None, "date": "soon"},
        {"compliance_changes": "x", "notes": ["a"], "date": "2026-01-02"},
        {},
    ]
    found = told(spark, lambda c: S.coerced(F.try_parse_json(c)), *map(json.dumps, rows))
    assert [tuple(f) for f in found] == [("a; 2", ["one"], "2026-01-02", True), ("k: true; l: m", [], "2026-03-01", True), ("x", ["a"], "2026-01-02", False), (None, [], "2026-03-01", True)]


GOOD = {"scenario_type": "push_dominant", "category": "crm", "competitor": "A", "current_tool": "B", "date": "2026-01-01", "competitor_changes": ["x"], "current_tool_status": ["slow"], "pricing_delta": "unchanged", "compliance_changes": "unchanged", "notes": []}


def test_signal_errors(spark):
    errors = lambda stem, text: spark.createDataFrame([(stem, text)], "s string, t string").select(S.signal_errors(F.col("s"), F.col("t")).alias("e")).first().e
    name = "crm_a_push_dominant"
    assert errors(name, json.dumps(GOOD)) == []
    assert errors("nothing", json.dumps(GOOD)) == ["Cannot parse filename"]
    assert errors(name, "{") == errors(name, json.dumps(GOOD) + "}") == ["Invalid JSON"]
    assert errors(name, "[1]") == ["Root is not a JSON object"]
    assert errors(name, json.dumps({k: v for k, v in GOOD.items() if k != "notes"} | {"date": 3})) == ["Wrong type for date: expected str, got int", "Missing field: notes"]
    assert errors(name, json.dumps(GOOD | {"notes": {}, "category": None})) == ["Wrong type for category: expected str, got NoneType", "Wrong type for notes: expected list, got dict"]
    assert errors(name, json.dumps(GOOD | {"current_tool_status": ["Stable", "no change"]})) == ["push_dominant: current_tool_status shows no degradation"]
    assert errors(name, json.dumps(GOOD | {"notes": ["Note 3"]})) == ["Placeholder value detected: 'Note 3'"]
    assert errors("crm_a_pilot_in_progress_hold", json.dumps(GOOD | {"scenario_type": "pilot_in_progress_hold", "notes": ["x"]})) == ["pilot_in_progress_hold: notes should explain the hold condition"]


def test_cases_and_registry(spark):
    case = lambda stem, payload: spark.createDataFrame([(stem, json.dumps(payload))], "s string, t string").select(S.signal_case(F.col("s"), F.col("t")).alias("c")).select("c.category", "c.competitor", "c.scenario", "c.expected", F.to_json("c.signal").alias("signal")).first()
    assert tuple(case("crm_a_pull_dominant", {"a": 1})) == ("crm", "a", "pull_dominant", "SWITCH", '{"a":1}')
    assert tuple(case("case1", {"category": "hr", "competitor_slug": "b", "signal": {"c": 2}, "expected_verdict": " stay "})) == ("hr", "b", "case1", "STAY", '{"c":2}')
    assert tuple(case("crm_a_both_signals", {"category": "hr", "expected_verdict": "maybe"}))[:4] == ("hr", "a", "both_signals", None)
    assert tuple(case("case1", {"category": "hr"})) == (None,) * 5
    whole = {k: 1 for k in W.COMPETITOR_KEYS} | {"features": ["f"], "compliance": {k: True for k in W.COMPLIANCE_KEYS}}
    entries = [whole, whole | {"features": [], "compliance": {"audit_log": True}}, {}]
    assert told(spark, lambda c: S.competitor_errors(F.try_parse_json(c)), *map(json.dumps, entries)) == [
        [],
        ["compliance missing keys: gdpr_eu_residency, soc2_type2, sso_saml", "features list is empty or missing"],
        ["missing keys: " + ", ".join(sorted(W.COMPETITOR_KEYS)), "compliance missing keys: " + ", ".join(sorted(W.COMPLIANCE_KEYS)), "features list is empty or missing"],
    ]
    stack = {c: {k: 1 for k in W.STACK_KEYS} for c in W.CATEGORIES if c != "hr"}
    del stack["crm"]["tool"]
    assert sorted(told(spark, lambda c: S.stack_errors(F.try_parse_json(c)), json.dumps(stack))[0]) == ["crm missing keys: tool", "missing category: hr"]


def test_matches_of_a_polarity(spark):
    """A pending change that overlaps most doesn't count as a positive one."""
    issues = spark.createDataFrame([(1, 0, "audit log export missing")], "k int, pos int, text string")
    changes = spark.createDataFrame([(1, 0, "audit log export in beta"), (1, 1, "audit log added ")], "k int, pos int, text string")
    assert best_match(issues, changes, "k").first().change_pos == 0
    assert best_match(issues, changes, "k", ["positive"]).first().change_pos == 1
    assert best_match(issues, changes, "k", ["negative"]).count() == 0
    df = spark.createDataFrame([(1, ["audit log export missing"], ["audit log export in beta", "audit log added "], ["stable"]), (2, [], [], [])], "k int, i array<string>, c array<string>, t array<string>")
    one, two = semantic_view(df, "i", "c", "t").orderBy("k").collect()
    assert (one.positive_pull.change, one.pending_pull.change, one.positive_tool, one.primary_pull, one.primary_tool_change) == ("audit log added", "audit log export in beta", None, "audit log added", "stable")
    assert (two.primary_issue, two.positive_pull, two.has_pending_pull) == (None, None, False)


def test_trace_parts(spark):
    assert told(spark, T.high_signals, '1. **"Sync is broken daily"**: HIGH\n2. **Slow export of data —**: HIGH x\n3. **short**: HIGH') == [["Sync is broken daily", "Slow export of data"]]
    assert told(spark, lambda c: T.strength(c, "pull"), "Overall pull: weak", "HIGH HIGH high", "HIGH", "") == ["WEAK", "STRONG", "MODERATE", "WEAK"]
    assert told(spark, T.compliance_said, "passed, then FAILED", "is compliant", "unclear\nx") == ["FAIL", "PASS", "unclear"]
    assert told(spark, T.compliance_reason, "a **No SOC2 report** b", "x\n- fails the gate -", "fine") == ["No SOC2 report", "fails the gate", "a hard compliance requirement is not met"]
    assert [tuple(r) for r in told(spark, T.answer_roi, "ROI: Migration £1,200 | Annual net £-3,450 | NOT MET", "MET £", "")] == [(1200, -3450, False), (0, 0, True), (0, 0, False)]
    assert told(spark, T.quotes, 'a "b" and "c d"') == [["b", "c d"]]
    assert told(spark, lambda c: T.with_verdict(c, F.lit("STAY")), "x\nVERDICT: HOLD now\nVERDICT: HOLD", "x \n", "VERDICT: STAY") == ["x\nVERDICT: STAY\nVERDICT: HOLD", "x\nVERDICT: STAY", "VERDICT: STAY\nVERDICT: STAY"]
    assert told(spark, lambda c: T.with_verdict(c, F.lit(None).cast("string"), every=True), " x ") == ["x"]


def test_labels(spark):
    assert told(spark, X.category_label, "project_mgmt", "crm", "finance", "") == ["Project Management", "CRM", "Finance", ""]
    assert told(spark, X.version_label, "2024-10-20", "", None) == ["v24.10", None, None]
    assert told(spark, X.moment_label, "2024-10-20T09:30:00", "2024-10-20T00:00:01", "2024-10-20", None) == ["2024-10-20 09:30", "2024-10-20", "2024-10-20", "—"]
    assert told(spark, X.confidence_label, (0.5,), (None,), schema="x double") == ["0.5000", "—"]


def test_attempts_and_held_out_sets(spark):
    from sagebrush.plans import training

    rows = [("a", 1, ["x"]), ("a", 2, []), ("a", 3, []), ("b", 1, ["x"]), ("b", 2, ["y"]), ("c", 1, [])]
    found = {r.k: (r.attempt, r.retried) for r in training.first_valid(spark.createDataFrame(rows, "k string, attempt int, errors array<string>"), "k").collect()}
    assert found == {"a": (2, True), "b": (2, True), "c": (1, False)}
    registry = spark.createDataFrame([("crm", "s", "Name")], "category string, slug string, name string")
    cases = lambda *ids: spark.createDataFrame([(i, "crm", "s", v) for i, v in ids], "case_id string, category string, slug string, expected string")
    assert [r.name for r in training.held_out(cases(("1", "STAY"), ("2", "HOLD")), registry, 1).collect()] == ["Name", "Name"]
    for bad in (cases(("1", "STAY"), ("1", "HOLD")), cases(("1", "STAY"), ("2", "STAY"), ("3", "HOLD"))):
        with pytest.raises(Exception, match="held-out set"):
            training.held_out(bad, registry, 1).collect()


def test_templates(spark):
    from sagebrush.functions.render import templated

    df = spark.createDataFrame([(0, "a", "x"), (1, "a", None), (2, "a", "y"), (3, "b", "z")], "i int, k string, f string")
    table = spark.createDataFrame([("a", 1, "second {f}"), ("a", 0, "first {f}, {f}")], "k string, variant int, template string")
    assert {r.i: r.text for r in templated(df, table, "k", "i", ["f"]).collect()} == {0: "first x, x", 1: "second ", 2: "first y, y", 3: None}
