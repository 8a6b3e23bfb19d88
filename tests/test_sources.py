from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sagebrush.sources import logs


def test_jsonl(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in logs.tolerant_jsonl(spark, f"{tmp_path}/log.jsonl", "a int").collect()) == [1, 2]
    assert logs.tolerant_jsonl(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.strict_jsonl(spark, f"{tmp_path}/log.jsonl", "a int").collect()


def test_traces_maps_and_registry(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    rows = [[{"role": r, "content": "c"} for r in roles] for roles in (("system", "user", "assistant"), ("user", "assistant"))]
    (tmp_path / "x/y/traces.jsonl").write_text("\n".join(json.dumps({"messages": m}) for m in rows))
    assert logs.chat_traces(spark, f"{tmp_path}/x").count() == 1
    (tmp_path / "map.json").write_text('{\n"k": "v"}')
    assert [tuple(r) for r in logs.json_map(spark, f"{tmp_path}/map.json").collect()] == [("k", "v")]
    (tmp_path / "r/crm").mkdir(parents=True)
    (tmp_path / "r/crm/acme.json").write_text('{"name": "Acme"}')
    (tmp_path / "r/crm/bad.json").write_text("{")
    assert [tuple(r) for r in logs.registry(spark, f"{tmp_path}/r").collect()] == [("crm", "acme", "Acme", "")]


def test_names_and_repair(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-02-crm-a-b.md", 'so: {"a": [1, 2,],} end'), ("memo.md", "none")], "name string, text string")
    found = df.select(logs.memo_key(F.col("name")).alias("k"), logs.repaired_json(F.col("text"), "a array<int>").alias("j")).collect()
    assert tuple(found[0].k) == ("2026-01-02", "crm", "a-b") and found[0].j.a == [1, 2]
    assert found[1].k is None and found[1].j is None
    logs.append(df, f"{tmp_path}/log"), logs.append(df, f"{tmp_path}/log")
    there = spark.read.parquet(f"{tmp_path}/log")
    assert there.count() == 4 and logs.absent_from(df, there, "name").count() == 0
