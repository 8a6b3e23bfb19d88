"""Pipelines of several answers over the texts of documents, with a scorer that answers by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.operators.scoring import Scorer, four_votes, three_step

from .registry import query, table

STRENGTHS = ["STRONG", "MODERATE", "WEAK"]


def counting_scorer() -> Scorer:
    """A model's stand-in: it answers by the number of words of a prompt, and a verdict by the votes that stand in it."""

    def one(prompt: str) -> tuple[str, float]:
        kind, _, rest = prompt.partition("\n")
        n = len([w for w in rest.replace("\n", " ").split(" ") if w])
        if kind == "COMPLIANCE":
            return ("FAIL" if n % 7 == 0 else "PASS"), 0.9
        if kind in ("PUSH", "PULL"):
            return STRENGTHS[n % 3], 0.8
        if "FAIL" in rest:
            return "VERDICT: STAY", 0.9
        weak = rest.count("WEAK")
        return f"VERDICT: {('SWITCH', 'HOLD', 'STAY')[weak]}", (0.8, 0.6, 0.7)[weak]

    return lambda prompts: [one(p) for p in prompts]


_WORDS = "len(list_filter(string_split(replace({}, chr(10), ' '), ' '), lambda x: x <> ''))"
_VOTED = f"""d AS (SELECT doc_id, coalesce(text, '') AS t, contains(coalesce(text, ''), '@') AS stopped, strpos(coalesce(text, ''), chr(10)) AS nl FROM documents),
c AS (SELECT *, {_WORDS.format('t')} AS n, {_WORDS.format("CASE WHEN nl > 0 THEN left(t, nl - 1) ELSE t END")} AS n_push, {_WORDS.format("CASE WHEN nl > 0 THEN substr(t, nl + 1) ELSE '' END")} AS n_pull FROM d),
v AS (SELECT *, CASE WHEN NOT stopped THEN CASE WHEN n % 7 = 0 THEN 'FAIL' ELSE 'PASS' END END AS compliance,
    CASE WHEN NOT stopped THEN ['STRONG', 'MODERATE', 'WEAK'][n_push % 3 + 1] END AS push, CASE WHEN NOT stopped THEN ['STRONG', 'MODERATE', 'WEAK'][n_pull % 3 + 1] END AS pull FROM c),
w AS (SELECT *, CASE WHEN stopped OR compliance = 'FAIL' THEN 'STAY' ELSE ['SWITCH', 'HOLD', 'STAY'][(push = 'WEAK')::INT + (pull = 'WEAK')::INT + 1] END AS verdict,
    CASE WHEN stopped THEN 1.0 WHEN compliance = 'FAIL' THEN 0.9 ELSE [0.8, 0.6, 0.7][(push = 'WEAK')::INT + (pull = 'WEAK')::INT + 1] END::DOUBLE AS p FROM v)"""


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, and what stands before and after the first line's end."""
    text = F.coalesce("text", F.lit(""))
    at = F.instr(text, F.lit("\n"))
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    after = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), before.alias("head"), after.alias("tail"))


def asked(kind: str, *texts) -> F.Column:
    return F.concat(F.lit(f"{kind}\n"), *texts)


@query(f"WITH {_VOTED} SELECT doc_id, compliance, push, pull, verdict, round(p, 6) AS prob, CASE WHEN p = 1 THEN 0.0 ELSE round(-p * log2(p) - (1 - p) * log2((1 - p) / 2), 6) END AS entropy_bits, round(p - (1 - p) / 2, 6) AS margin FROM w")
def q_four_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on each document by four answers; documents with an address in them are stopped before Python."""
    c = F.col
    prompts = {"compliance": asked("COMPLIANCE", c("text")), "push": asked("PUSH", c("head")), "pull": asked("PULL", c("tail"))}
    verdict = asked("VERDICT", F.concat_ws("\n", "compliance", "push", "pull"))
    found = four_votes(halves(spark, sf_dir), counting_scorer, prompts, verdict, F.contains("text", F.lit("@")), F.lit("holds an address"))
    return found.select("doc_id", "compliance", "push", "pull", X.verdict(c("verdict")).alias("verdict"), F.round("verdict_prob", 6).alias("prob"), "entropy_bits", "margin")


@query(f"WITH {_VOTED}, s AS (SELECT doc_id, t, n, CASE WHEN n % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS first FROM c) SELECT doc_id, first, ['STRONG', 'MODERATE', 'WEAK'][(n + 2) % 3 + 1] AS second FROM (SELECT doc_id, first, n FROM s)")
def q_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that follow each other: the second question comes after the first one and its answer."""

    def relabelled() -> Scorer:
        inner = counting_scorer()
        # A question that follows others is of the kind that its own line says, and counts all that was said but the first line.
        return lambda prompts: inner([p if "\nPUSH" not in p else "PUSH\n" + p.partition("\n")[2] for p in prompts])

    steps = ("first", asked("COMPLIANCE", F.col("text"))), ("second", F.lit("PUSH"))
    return three_step(halves(spark, sf_dir), relabelled, *steps).select("doc_id", "first", "second")
