"""Runs that are committed as a whole, votes behind a gate, and counters of a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sagebrush.operators import scoring
from sagebrush.operators.latest import counts_since_marker, runs_of_marker
from sagebrush.operators.sampling import diverse_balanced, grouped_split, greedy_counts, shuffled
from sagebrush.plans.runs import FAILED, run_batch, tables
from sagebrush.sources.store import Store
from sagebrush.streaming import live

GOOD = "ANALYSIS: one reason.\nVERDICT: {}"


def decide(df):
    """HOLD for the first product, SWITCH for others; one signal's answer has errors at any time."""
    verdict = F.when(F.col("slug") == "a", "HOLD").otherwise("SWITCH")
    bad = F.col("doc_id") == 5
    answer = F.when(bad, "no verdict").otherwise(F.concat(F.lit("ANALYSIS: one reason.\nVERDICT: "), verdict))
    return df.withColumns({"answer": answer, "verdict": F.when(bad, "UNKNOWN").otherwise(verdict), "prob": F.rand(), "errors": F.when(bad, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))})


def told(to):
    return {n: sorted(map(str, getattr(to, n).read().collect())) for n in ("memos", "holds", "log", "outcomes")}


def test_a_run_that_is_stopped_and_repeated(spark, tmp_path, monkeypatch):
    """Stopped before each of its writes, a run leaves nothing; repeated, it leaves what one run leaves, once."""
    signals = spark.createDataFrame([Row(doc_id=i, category="crm", slug="abc"[i % 3], current_tool="T") for i in range(6)])
    to = tables(spark, f"{tmp_path}/t")
    stage = Store.stage
    for stop in range(4):
        left = [stop]

        def stopping(self, *a, left=left, **b):
            if not left[0]:
                raise RuntimeError("stopped")
            left[0] -= 1
            return stage(self, *a, **b)

        monkeypatch.setattr(Store, "stage", stopping)
        with pytest.raises(RuntimeError, match="stopped"):
            run_batch(signals, "b1", "2026-02-01", to, decide)
        assert all(x == [] for x in told(to).values())
    monkeypatch.setattr(Store, "stage", stage)
    assert run_batch(signals, "b1", "2026-02-01", to, decide).count() == 6
    first = told(to)
    run_batch(signals, "b1", "2026-02-01", to, decide)
    assert told(to) == first and {k: len(v) for k, v in first.items()} == {"memos": 3, "holds": 2, "log": 6, "outcomes": 6}
    memos = {r.memo: r.text for r in to.memos.read().collect()}
    assert memos["2026-02-01-crm-c.md"].startswith(FAILED) and memos["2026-02-01-crm-a.md"] == GOOD.format("HOLD")
    assert sorted((r.seq, r.attempts, r.format_valid) for r in to.log.read().collect()) == [(i, 2 if i == 5 else 1, i != 5) for i in range(6)]
    holds = to.holds.read().collect()
    assert {(h.category, h.competitor, h.current_tool, h.review_by) for h in holds} == {("crm", "a", "T", "2026-05-04")}
    run_batch(signals.filter("doc_id = 0"), "b2", "2026-02-01", to, decide)
    assert to.memos.read().count() == 3 and to.holds.read().count() == 3 and to.log.read().agg(F.max("seq")).first()[0] == 6


def test_votes_behind_a_gate(spark, tmp_path):
    """Stopped rows never reach Python, each task loads the scorer once, and the verdict reads the votes."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"load-{uuid.uuid4().hex}"), "w").close()

        def score(prompts):
            with open(os.path.join(folder, f"asked-{uuid.uuid4().hex}"), "w") as f:
                f.write("\n".join(prompts))
            return [(f"[{p}]", 0.5) for p in prompts]

        return score

    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)] + [(99, None)], "id int, text string").repartition(2)
    text = F.coalesce("text", F.lit("?"))
    prompts = {n: F.concat(F.lit(f"{n}:"), text) for n in ("compliance", "push", "pull")}
    found = {r.id: r for r in scoring.four_votes(df, load, prompts, F.concat_ws("/", "compliance", "push", "pull"), F.when(F.col("id") < 90, F.col("id") % 4 == 0), F.lit("why")).collect()}
    assert len(found) == 41
    assert found[0].verdict == "VERDICT: STAY\nwhy" and found[0].verdict_prob == 1.0 and found[0].push is None and found[0].margin == 1.0
    assert found[1].push == "[push:t1]" and found[1].verdict == "[[compliance:t1]/[push:t1]/[pull:t1]]"
    assert found[99].pull == "[pull:?]" and (found[1].entropy_bits, found[1].margin) == (1.5, 0.25)
    asked = "\n".join(p.read_text() for p in tmp_path.glob("asked-*")).split("\n")
    assert len(asked) == 4 * 31 and not any(f":t{i}" == a[-len(f":t{i}") :] for a in asked for i in range(0, 40, 4))
    assert len(list(tmp_path.glob("load-*"))) <= 2 * 2 * 2


def test_answers_that_follow_each_other(spark):
    load = lambda: lambda prompts: [(f"<{len(p)}>", 1.0) for p in prompts]
    df = spark.createDataFrame([(1, "abc"), (2, "")], "id int, text string")
    found = {r.id: r for r in scoring.two_pass(df, load, F.col("text"), lambda a: F.concat(F.lit("x"), a)).collect()}
    assert (found[1].variables, found[1].memo) == ("<3>", "<4>") and found[2].variables == "<0>"
    found = {r.id: r for r in scoring.three_step(df, load, ("one", F.col("text")), ("two", F.lit("q")), ("three", F.lit("r"))).collect()}
    assert (found[1].one, found[1].two, found[1].three) == ("<3>", f"<{len('abc') + 1 + 3 + 1 + 1}>", f"<{len('abc') + 1 + 3 + 1 + 1 + 1 + 3 + 1 + 1}>")


def test_markers_of_hot_keys(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["hot"] * 8 + ["a", None, "b"]), rng.random() < 0.2) for i in range(1500)]
    log = spark.createDataFrame(data, "seq long, k string, m boolean").repartition(9)
    wanted, n = {}, {}
    for s, k, m in data:
        n[k] = n.get(k, 0) + m
        wanted[s] = n[k]
    assert {r.seq: r.session for r in runs_of_marker(log, F.col("m"), "k").collect()} == wanted
    found = {r.k: (r.marker_seq, r.n_since) for r in counts_since_marker(log, F.col("m"), ~F.col("m"), "k").collect()}
    last = {k: max((s for s, j, m in data if j == k and m), default=None) for k in n}
    assert found == {k: (last[k], sum(j == k and s > (-1 if last[k] is None else last[k]) for s, j, m in data)) for k in n}


def test_a_counting_stream(spark, tmp_path):
    """Counts over many batches, a batch done again, and a stream that goes on later; one row a key."""
    rng = random.Random(5)
    data = [(i, rng.choice(["hot"] * 5 + ["a", None]), rng.random() < 0.05) for i in range(600)]
    schema = "seq long, k string, m boolean"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        live.counted_since(stream, "k", F.col("m"), ~F.col("m"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.k: (r.marker_seq, r.n_since) for r in live.counts_store(spark, f"{tmp_path}/out", "k", "string").read().collect()}

    def wanted(rows):
        last = {k: max((s for s, j, m in rows if j == k and m), default=None) for k in {r[1] for r in rows}}
        return {k: (v, sum(j == k and s > (-1 if v is None else v) for s, j, _ in rows)) for k, v in last.items()}

    def write(rows):
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")

    write(data[:200]), write(data[200:400])
    assert run() == wanted(data[:400])
    write(data[400:])
    assert run() == wanted(data)
    # The stream forgets that its last batch was done; the ledger doesn't.
    newest = max((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink(), (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert run() == wanted(data)


def test_diverse_balanced(spark):
    """The choice of the plain greedy over all rows, with null values and a hot combination."""
    rng = random.Random(6)
    rows = [(i, "g" if i < 300 else "h", rng.choice(["hot"] * 6 + ["p", "q", None]), rng.randrange(4)) for i in range(360)]
    df = spark.createDataFrame(rows, "id int, g string, x string, y int").repartition(5)
    places = {r.id: (r.o, r.c) for r in df.select("id", shuffled(9, "id").alias("o"), F.md5(F.concat_ws("|", F.lit("9"), F.coalesce("x", F.lit("")), F.col("y").cast("string"))).alias("c")).collect()}
    for target in (None, 7, 1000):
        found = sorted(r.id for r in diverse_balanced(df, "g", ["x", "y"], 9, "id", target).collect())
        wanted = []
        for g in "gh":
            own = [r for r in rows if r[1] == g]
            in_order, pool = {}, []
            for r in sorted(own, key=lambda r: (places[r[0]][0], r[0])):
                k = in_order[r[2:]] = in_order.get(r[2:], -1) + 1
                pool.append((k, places[r[0]][1], r))
            pool = [r for *_, r in sorted(pool, key=lambda x: x[:2])]
            used, taken = {}, []
            while len(taken) < min(60 if target is None else target, len(own)):
                best = min((r for r in pool if r not in taken), key=lambda r: (used.get(("x", r[2]), 0), used.get(("y", r[3]), 0)))
                taken.append(best)
                for k in (("x", best[2]), ("y", best[3])):
                    used[k] = used.get(k, 0) + 1
            wanted += [r[0] for r in taken]
        assert found == sorted(wanted)
    assert greedy_counts([], [], 5) == [] and greedy_counts([("a",), ("b",)], [1, 9], 6) == [1, 5]


def test_split_keeps_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "b", None if i % 5 == 0 else str(i % 5)) for i in range(100)], "id int, b string, g string")
    found = grouped_split(rows, ["b"], "g", 0.3, 1)
    assert found.count() == 100 and found.filter("g is null").select("b", "split").distinct().count() == 2
    assert found.groupBy("b", "g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_decisions_of_chance_are_made_once(spark, tmp_path):
    """Of answers that fail by chance none is told twice and none is lost: both halves read the same first decisions."""
    asked = spark.sparkContext.accumulator(0)

    def fails(_):
        asked.add(1)
        return random.random() < 0.5

    chance = F.udf(fails, "boolean").asNondeterministic()

    def decide(df):
        df = df.withColumn("bad", chance("doc_id"))
        return df.withColumns({"answer": F.lit("VERDICT: STAY"), "verdict": F.lit("STAY"), "prob": F.lit(0.5), "errors": F.when(F.col("bad"), F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))})

    signals = spark.createDataFrame([Row(doc_id=i, category=None if i == 7 else "crm", slug="abc"[i % 3], current_tool="T") for i in range(64)])
    found = run_batch(signals, "b1", "2026-02-01", tables(spark, f"{tmp_path}/t"), decide).collect()
    assert sorted(r.doc_id for r in found) == list(range(64))
    assert 64 < asked.value < 2 * 64
