"""Changes after whole versions, and batches of several tables that count together or not at all."""

from __future__ import annotations

import os

import pytest

from sagebrush.sources.store import MOST_CHANGES, Ledger, Store

SCHEMA = "k string, n int, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_changes_are_merged(spark, tmp_path):
    """Appends, upserts and deletes in turn, with null keys, against a plain list; compaction changes nothing."""
    store, plain = Store(spark, f"{tmp_path}/s", SCHEMA), []
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    steps = [("append", [("a", 1, "x"), ("b", 1, "x"), (None, 1, "x")]), ("upsert", [("a", 1, "y"), ("c", 1, "y")]), ("append", [("a", 1, "again")]), ("delete", [("b", 1, "")]),
             ("upsert", [(None, 1, "z"), ("b", 2, "z"), ("b", 2, "twice")]), ("delete", [("a", 1, ""), ("nobody", 1, "")]), ("append", [("a", 1, "last")])]
    for kind, some in steps:
        if kind == "append":
            store.append(frame(some))
        elif kind == "upsert":
            store.upsert(frame(some), "k", "n")
        else:
            assert store.delete(frame(some), "k", "n") == sum((r[0], r[1]) in {(s[0], s[1]) for s in some} for r in plain)
        if kind != "append":
            plain = [r for r in plain if (r[0], r[1]) not in {(s[0], s[1]) for s in some}]
        plain += some if kind != "delete" else []
        assert sorted(map(str, rows(store.read().fillna("-")))) == sorted(str(tuple("-" if x is None else x for x in r)) for r in plain)
    before = [tuple("-" if x is None else x for x in r) for r in plain]
    store.compact()
    assert not store.changes() and rows(store.read().fillna("-")) == sorted(before)


def test_another_key_compacts_first(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA)
    store.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], SCHEMA), "k")
    store.upsert(spark.createDataFrame([("c", 1, "y")], SCHEMA), "n")
    assert rows(store.read()) == [("c", 1, "y")]


def test_an_upsert_writes_its_rows_only(spark, tmp_path):
    """Bytes in proportion to the change; old changes go in time, and so do old versions."""
    store = Store(spark, f"{tmp_path}/s", SCHEMA)
    big = spark.range(200_000).selectExpr("cast(id as string) k", "cast(id as int) n", "md5(cast(id as string)) v")
    store.replace(big)
    whole = size(f"{tmp_path}/s")
    store.upsert(spark.createDataFrame([("7", 7, "new")], SCHEMA), "k")
    assert size(f"{tmp_path}/s") - whole < whole / 100
    assert store.read().count() == 200_000 and store.read().filter("k = '7'").first().v == "new"
    small = Store(spark, f"{tmp_path}/t", SCHEMA)
    for i in range(MOST_CHANGES + 2):
        small.upsert(spark.createDataFrame([(str(i % 3), i, "x")], SCHEMA), "k")
    assert len(small.changes()) < MOST_CHANGES and len(small.versions()) >= 1
    assert sorted(r.n for r in small.read().collect()) == [15, 16, 17]


def test_an_unfinished_change_does_not_count(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA)
    store.append(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    (tmp_path / "s/d=00000002").mkdir()
    (tmp_path / "s/d=00000002/part-0.parquet").write_text("not whole")
    assert rows(store.read()) == [("a", 1, "x")]
    store.upsert(spark.createDataFrame([("a", 2, "y")], SCHEMA), "k")
    assert rows(store.read()) == [("a", 2, "y")]


def test_batches_count_together_and_once(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    one, two = (Store(spark, f"{tmp_path}/{n}", SCHEMA, ledger=ledger) for n in ("one", "two"))
    frame = lambda v: spark.createDataFrame([("a", 1, v)], SCHEMA)

    def bad(k: str) -> int:
        raise RuntimeError(k)

    from pyspark.sql.functions import udf

    broken = frame("x").withColumn("n", udf(bad, "int")("k"))
    for _ in range(2):
        with pytest.raises(Exception, match="RuntimeError"):
            ledger.commit("b1", [(one, "upsert", frame("x"), ("k",)), (two, "append", broken, ())])
        assert one.read().count() == two.read().count() == 0
    assert ledger.commit("b1", [(one, "upsert", frame("x"), ("k",)), (two, "append", frame("x"), ())])
    assert not ledger.commit("b1", [(one, "upsert", frame("never"), ("k",)), (two, "append", frame("never"), ())])
    assert rows(one.read()) == rows(two.read()) == [("a", 1, "x")]
    assert ledger.commit("b2", [(one, "upsert", frame("y"), ("k",)), (two, "append", frame("y"), ())])
    assert rows(one.read()) == [("a", 1, "y")] and two.read().count() == 2
    one.compact(), two.compact()
    assert rows(one.read()) == [("a", 1, "y")] and two.read().count() == 2
    with pytest.raises(ValueError, match="named by"):
        ledger.commit("a;b", [])
