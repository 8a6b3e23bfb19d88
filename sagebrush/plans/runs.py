"""A batch of signals from inbox to memo, hold and log, as one committed run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.operators.order import checkpoint_folder, ranked, until_exit, written
from sagebrush.sources.sinks import HOLDS, MEMOS, memo_name
from sagebrush.sources.store import Ledger, Store

from .agent import PRICED, context, decided
from .registry import query

LOG = "seq long, ts string, type string, category string, competitor string, verdict string, prob double, format_valid boolean, attempts int, memo string"
OUTCOMES = "doc_id long, memo string, verdict string, hold_registered boolean, errors array<string>"
#: What marks a memo that failed twice, and a hold whose memo doesn't tell its terms; days until its review.
FAILED = "[VALIDATION FAILED — manual review required]\n\n"
HOLD_REASON, HOLD_CONDITION, REVIEW_DAYS = "See verdict memo for push signal details.", "Review memo for stated reassessment condition.", 92


class Tables(NamedTuple):
    """The tables that a run changes together."""

    ledger: Ledger
    memos: Store
    holds: Store
    log: Store
    outcomes: Store


def tables(spark: SparkSession, folder: str) -> Tables:
    ledger = Ledger(spark, f"{folder}/ledger")
    store = lambda name, schema: Store(spark, f"{folder}/{name}", schema, ledger=ledger)
    return Tables(ledger, store("memos", MEMOS), store("holds", HOLDS), store("log", LOG), store("outcomes", OUTCOMES))


Decide = Callable[[DataFrame], DataFrame]


def with_retry(signals: DataFrame, decide: Decide) -> DataFrame:
    """Decisions on signals, those with errors decided once more; attempts, and answers that fail again marked as such.

    The first decisions are written with their signals, so that both halves below read the same ones and none is made twice.
    """
    kept = dict.fromkeys([*signals.columns, "answer", "verdict", "prob", "errors"])
    first = written(decide(signals).select(*kept), "first").withColumn("attempts", F.lit(1))
    bad = F.size("errors") > 0
    again = decide(first.filter(bad).select(*signals.columns)).select(*kept).withColumn("attempts", F.lit(2))
    again = again.withColumn("answer", F.when(bad, F.concat(F.lit(FAILED), F.col("answer"))).otherwise(F.col("answer")))
    return first.filter(~bad).unionByName(again)


def run_batch(signals: DataFrame, batch: str, today: str, to: Tables, decide: Decide = decided) -> DataFrame:
    """Decide on a batch of signals and write memos, holds, log and outcomes together; the batch's outcomes so far are returned.

    Signals have doc_id, category, slug, current_tool and what ``decide`` reads. Decisions are written once and the four
    tables made from them, so that an answer of chance is the same in all. Of memos with one name the one of the largest
    doc_id stays. A batch that has been committed is not decided again.
    """
    if batch in to.ledger.batches():
        return to.outcomes.read()
    c = F.col
    made = with_retry(signals, decide).select("doc_id", "category", "slug", "current_tool", "answer", "verdict", "prob", "errors", "attempts")
    made = written(made.withColumn("date", F.lit(today)), "decisions")
    named = made.withColumn("memo", memo_name(made))
    rest = ["date", "category", "slug", F.col("answer").alias("text")]
    last = named.groupBy("memo").agg(F.max_by(F.struct(*rest), "doc_id").alias("r")).select("memo", "r.*")

    held, told = named.filter("verdict = 'HOLD'").withColumn("told", X.hold_metadata(c("answer"))), c("told")
    plain = {"category": c("category"), "current_tool": c("current_tool"), "competitor": c("slug"), "hold_reason": F.lit(HOLD_REASON), "reassess_condition": F.lit(HOLD_CONDITION), "review_by": F.date_format(F.date_add(F.lit(today), REVIEW_DAYS), "yyyy-MM-dd")}
    holds = held.select(*(F.when(told.isNotNull(), told[n]).otherwise(v).alias(n) for n, v in plain.items()), F.lit(today).alias("issued_date"))

    after = to.log.read().agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    placed = ranked(named, "place", F.asc("doc_id"), F.asc("memo"), F.asc("verdict"))
    log = placed.join(F.broadcast(after)).select(
        (c("last") + c("place")).alias("seq"), F.lit(today).alias("ts"), F.lit("live_run").alias("type"), "category", c("slug").alias("competitor"), "verdict", "prob",
        (F.size("errors") == 0).alias("format_valid"), "attempts", "memo",
    )
    outcomes = named.select("doc_id", "memo", "verdict", (c("verdict") == "HOLD").alias("hold_registered"), "errors")
    to.ledger.commit(batch, [(to.memos, "upsert", last, ("memo",)), (to.holds, "append", holds, ()), (to.log, "append", log, ()), (to.outcomes, "append", outcomes, ())])
    return to.outcomes.read()


@query(f"""WITH {PRICED}, o AS (SELECT d.doc_id, d.category, s.slug, d.verdict, row_number() OVER (ORDER BY d.doc_id) - 1 AS seq FROM decided d JOIN (SELECT doc_id, slug FROM sig) s USING (doc_id))
SELECT '2026-02-01-' || category || '-' || slug || '.md' AS memo, arg_max(verdict, doc_id) AS verdict, count(*) FILTER (verdict = 'HOLD') AS n_holds, count(*) AS n_runs, CAST(max(seq) AS BIGINT) AS last_seq, max(doc_id) AS doc_id FROM o GROUP BY category, slug""")
def q_run_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs of one batch leave: each memo's verdict, the holds and log events of its product, as told by the tables."""
    folder = f"{checkpoint_folder(spark)}/runs-{uuid.uuid4().hex}"
    until_exit(spark, folder)
    to = tables(spark, folder)
    signals = context(spark, sf_dir).withColumn("current_tool", F.lit("Tool"))
    for _ in range(2):
        run_batch(signals, "2026-02-01.1", "2026-02-01", to)
    memos = to.memos.read().select("memo", "category", "slug", F.coalesce(X.verdict(F.col("text")), F.lit("UNKNOWN")).alias("verdict"))
    holds = to.holds.read().groupBy("category", F.col("competitor").alias("slug")).agg(F.count(F.lit(1)).alias("n_holds"))
    runs = to.log.read().groupBy("memo").agg(F.count(F.lit(1)).alias("n_runs"), F.max("seq").alias("last_seq"))
    ids = to.outcomes.read().groupBy("memo").agg(F.max("doc_id").alias("doc_id"))
    found = memos.join(holds, ["category", "slug"], "left").join(runs, "memo").join(ids, "memo")
    return found.select("memo", "verdict", F.coalesce("n_holds", F.lit(0)).alias("n_holds"), "n_runs", "last_seq", "doc_id")
