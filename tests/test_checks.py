"""Contexts that lack something, views told within a row, and signals of null and empty texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.functions import traces as T
from sagebrush.operators.matching import semantic_view
from sagebrush.operators.sampling import balanced
from sagebrush.plans import checks as K
from sagebrush.plans import quality as Q
from sagebrush.plans import signals as P
from sagebrush.plans.gates import signal_context


def context(spark, signals, strict=False):
    stack = spark.createDataFrame([("crm", "Old")], "category string, tool string")
    usage = spark.createDataFrame([("Old", 3)], "tool string, uses int")
    registry = spark.createDataFrame([("crm", "acme", "Acme")], "category string, slug string, name string")
    return signal_context(spark.createDataFrame(signals, "category string, slug string"), stack, usage, registry, strict)


def test_context_errors(spark):
    rows = context(spark, [("crm", "acme"), ("crm", "none"), ("hr", "acme"), ("zoo", "acme"), (None, "acme"), ("crm", None)]).collect()
    found = {(r.category, r.slug): r.error for r in rows}
    assert found == {
        ("crm", "acme"): None, ("crm", "none"): "competitor not found: crm/none", ("hr", "acme"): "no stack entry: hr",
        ("zoo", "acme"): "invalid category: zoo", (None, "acme"): "invalid category: null", ("crm", None): "competitor not found: crm/null",
    }
    assert [r.uses for r in rows if r.slug == "acme" and r.category == "crm"] == [3]


def test_strict_context(spark):
    assert context(spark, [("crm", "acme")], strict=True).count() == 1
    with pytest.raises(Exception, match="competitor not found: crm/none"):
        context(spark, [("crm", "acme"), ("crm", "none")], strict=True).count()


def test_words(spark):
    df = spark.createDataFrame([("a+b and c",), ("",), (None,)], "t string")
    rows = df.select(X.any_in(F.col("t"), ["a+b", "x"]).alias("any"), X.hits_in(F.col("t"), ["a+b", "c", "x", "a+b"]).alias("n")).collect()
    assert [(r.any, r.n) for r in rows[:2]] == [(True, 3), (False, 0)]
    assert rows[2].any is None


def test_view_of_long_and_empty_lists(spark):
    long = [f"plain line {i}" for i in range(2000)] + ["Added native API sync", "native API sync added"]
    data = [(1, ["API sync fails"], long, []), (2, [], ["Added native API sync"], []), (3, None, None, None)]
    rows = {r.k: r for r in semantic_view(spark.createDataFrame(data, "k int, i array<string>, c array<string>, t array<string>"), "i", "c", "t").collect()}
    assert rows[1].positive_pull.change == "Added native API sync" and rows[1].has_positive_pull and not rows[1].has_positive_tool
    assert rows[2].positive_pull is None and rows[2].primary_pull == "Added native API sync" and rows[2].primary_issue is None
    assert rows[3].positive_pull is None and rows[3].primary_pull is None


def test_signals_of_odd_texts(spark, tmp_path):
    data = [(1, None), (2, ""), (3, "one\n\n  two  words\r\nthree"), (4, "x " * 50_000)]
    spark.createDataFrame(data, "doc_id long, text string").withColumn("notes", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: [*r.notes, *r.changes, *r.tool] for r in P.signals(spark, str(tmp_path)).collect()}
    literal = {*P.NOTES, *P.CHANGES, *P.TOOLS}
    assert set(rows[1]) <= literal and set(rows[2]) <= literal
    assert [x for x in rows[3] if x not in literal] == ["one", "two words", "three"]
    assert [x for x in rows[4] if x not in literal] == [("x " * 50_000).strip()]


def test_balanced_makes_rows_once(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 10 else None) for i in range(12)], "id int, g string")
    rows = balanced(df, "g", 1, "id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in rows} == {"a": 2, "b": 2, None: 2}


def times(df, what):
    """How often an expression stands in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toJSON().count(what)


def test_texts_are_made_once(spark, sf):
    """Payloads and memos that checks are made of stand in the plan once, however many fields and sections are asked for."""
    alone = Q.table(spark, sf, "documents").select(Q.memo())
    assert times(Q.q_memo_validation(spark, sf), "expressions.Md5") == times(alone, "expressions.Md5")
    for found in (K.q_stack_errors(spark, sf), K.q_registry_errors(spark, sf)):
        assert times(found, '"parseJson"') == 1 and times(found, "expressions.StructsToJson") <= 1


def test_signals_of_a_curated_set_are_judged_once(spark, sf, monkeypatch):
    asked, real = spark.sparkContext.accumulator(0), P.judged

    def same(failure):
        asked.add(1)
        return failure

    counted = F.udf(same, "string").asNondeterministic()
    monkeypatch.setattr(P, "judged", lambda df: real(df).withColumn("failure", counted("failure")))
    assert P.q_curated_set(spark, sf).count() > 0
    assert asked.value == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_patterns_of_many_words():
    """One pattern finds a word exactly where one of the words stands."""
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.choices("ab.| ", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        pattern = re.compile(X.alternation(words))
        for _ in range(20):
            text = "".join(rng.choices("ab.| ", k=rng.randint(0, 8)))
            assert bool(pattern.search(text)) == any(w in text for w in words)


def test_traces_are_parsed_once(spark, sf):
    """What several fields of a parsed trace read stands in the plan once: one search a label."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert times(d.select(T.parsed_answer(F.col("text"))), "expressions.RegExpExtractAll") == 5
    assert times(d.select(T.parsed_prompt(F.col("text"))), "expressions.RegExpExtractAll") == 6
