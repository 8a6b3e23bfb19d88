"""Numbers of lines over many files and pieces of files, and split files told by their names."""

from __future__ import annotations

import json
import os

import pytest

from sagebrush.sources import arrival, splits


@pytest.fixture
def small_pieces(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_follow_the_files(spark, tmp_path, small_pieces):
    """Files of other sizes, with blank and malformed lines, lines longer than a piece, and no end of line at the end."""
    wanted, n = [], 0
    for f in range(7):
        lines = []
        for i in range(137 * f % 211):
            kind = (i * 7 + f) % 11
            lines.append("" if kind == 0 else "{bad" if kind == 1 else json.dumps({"a": i, "f": f, "pad": "é" * (3000 if kind == 2 and i % 5 == 0 else i % 40)}))
            if kind > 1:
                wanted.append((n + i, i, f))
        # Without an end of line the last line counts, unless it is blank.
        ended = f % 2 == 1
        (tmp_path / f"part-{f}.jsonl").write_text("\n".join(lines) + ("\n" if lines and ended else ""))
        n += len(lines) - (not ended and bool(lines) and lines[-1] == "")
    assert spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 20
    assert sorted(r.seq for r in arrival.numbered_lines(spark, f"{tmp_path}/*.jsonl").collect()) == list(range(n))
    assert sorted((r.seq, r.a, r.f) for r in arrival.arrived_jsonl(spark, f"{tmp_path}/*.jsonl", "a int, f int").collect()) == wanted


def test_files_by_time(spark, tmp_path):
    for i, name in enumerate("cab"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"n": name}))
        os.utime(tmp_path / f"{name}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    read = lambda **x: [r.n for r in arrival.arrived_jsonl(spark, f"{tmp_path}/*.jsonl", "n string", **x).orderBy("seq").collect()]
    assert read(by_time=True) == list("cab") and read() == list("abc")
    assert arrival.arrived_jsonl(spark, f"{tmp_path}/none*", "n string").count() == 0


@pytest.mark.parametrize(
    ("there", "asked", "train", "val"),
    [
        (["x.jsonl"], "x.jsonl", "x.jsonl", None),
        (["x.jsonl", "x.train.jsonl"], "x.jsonl", "x.jsonl", None),
        (["x.jsonl", "x.train.jsonl", "x.val.jsonl"], "x.jsonl", "x.train.jsonl", "x.val.jsonl"),
        (["x.train.jsonl", "x.val.jsonl"], "x.jsonl", "x.train.jsonl", "x.val.jsonl"),
        (["x.train.jsonl", "x.val.jsonl"], "x.train.jsonl", "x.train.jsonl", "x.val.jsonl"),
        (["x.train.jsonl"], "x.train.jsonl", "x.train.jsonl", None),
        (["a.b.jsonl", "a.b.train.jsonl", "a.b.val.jsonl"], "a.b.jsonl", "a.b.train.jsonl", "a.b.val.jsonl"),
        (["plain", "plain.train", "plain.val"], "plain", "plain.train", "plain.val"),
    ],
)
def test_split_files(spark, tmp_path, there, asked, train, val):
    for name in there:
        (tmp_path / name).write_text(json.dumps({"from": name}) + "\n")
    at = lambda n: n and f"{tmp_path}/{n}"
    assert splits.resolved(spark, at(asked)) == (at(train), at(val))
    rows, held = splits.training_rows(spark, at(asked), "from string")
    assert [r["from"] for r in rows.collect()] == [train] and held is None
    _, held = splits.training_rows(spark, at(asked), "from string", evaluate=True)
    assert (held and [r["from"] for r in held.collect()]) == (val and [val])
    _, held = splits.training_rows(spark, at(asked), "from string", evaluate=True, given=at(there[0]))
    assert [r["from"] for r in held.collect()] == [there[0]]


def test_written_splits_are_found_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "train")], "n int, split string")
    splits.write_split(rows, f"{tmp_path}/d.jsonl")
    train, val = splits.training_rows(spark, f"{tmp_path}/d.jsonl", "n int", evaluate=True)
    assert sorted(r.n for r in train.collect()) == [1, 3] and [r.n for r in val.collect()] == [2]
