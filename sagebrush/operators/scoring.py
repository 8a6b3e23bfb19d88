"""Scorers (models, or their stand-ins) at the boundary to Python, and the pipelines that ask them several times.

A scorer takes a list of prompts and gives a text and a probability for each. It is loaded once in each task. Prompts are
columns, made by expressions; only they go to Python with their rows, and rows that a gate stops never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

Scorer = Callable[[list[str]], list[tuple[str, float]]]


def answered(df: DataFrame, load: Callable[[], Scorer], *names: str) -> DataFrame:
    """``df`` with name and name_prob for each of ``names``, the scorer's answers to the column name_prompt, which goes.

    The answers of one row don't see each other. All prompts of a row go to Python in one pass, so that the votes are
    united by being in one row, without a join. A null prompt is asked as an empty one.
    """
    kept = [c for c in df.columns if c not in {f"{n}_prompt" for n in names}]
    schema = StructType([*df.select(*kept).schema.fields])
    for n in names:
        schema = schema.add(n, StringType()).add(f"{n}_prob", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or load()
            columns = [batch.column(c) for c in kept]
            for n in names:
                said = scorer([p or "" for p in batch.column(f"{n}_prompt").to_pylist()])
                columns += [pa.array([t for t, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def gated(df: DataFrame, stopped: Column, otherwise: dict[str, Column], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on the rows that the gate lets through; the others get the columns ``otherwise``. Null doesn't stop."""
    stops = F.coalesce(stopped, F.lit(False))
    through = run(df.filter(~stops))
    return through.unionByName(df.filter(stops).withColumns(otherwise).select(*through.columns))


def two_pass(df: DataFrame, load: Callable[[], Scorer], first: Column, second: Callable[[Column], Column]) -> DataFrame:
    """Columns variables and memo: the second prompt is made of the first answer."""
    found = answered(df.withColumn("variables_prompt", first), load, "variables").drop("variables_prob")
    return answered(found.withColumn("memo_prompt", second(F.col("variables"))), load, "memo")


def three_step(df: DataFrame, load: Callable[[], Scorer], *steps: tuple[str, Column | Callable[..., Column]]) -> DataFrame:
    """A column for each step (name, prompt), asked one after another; each prompt follows all earlier prompts and answers."""
    history = F.lit("")
    for name, prompt in steps:
        asked = prompt() if callable(prompt) else prompt
        df = df.withColumn("_said", F.concat(history, asked))
        df = answered(df.withColumn(f"{name}_prompt", F.col("_said")), load, name)
        # What was asked stays in the row until the next step has read it.
        df = df.withColumn("_history", F.concat("_said", F.lit("\n"), F.col(name), F.lit("\n"))).drop("_said")
        history = F.col("_history")
    return df.drop("_history")


#: What a stopped row says of its verdict: certain, without entropy.
STOPPED = {"verdict_prob": 1.0, "entropy_bits": 0.0, "margin": 1.0}


def four_votes(df: DataFrame, load: Callable[[], Scorer], prompts: dict[str, Column], verdict: Column, stopped: Column, reason: Column) -> DataFrame:
    """Columns compliance, push, pull, verdict, verdict_prob, entropy_bits, margin; the verdict's prompt reads the other three.

    Three votes are independent; the fourth is asked for the verdict. Rows that the gate stops say STAY for ``reason``,
    with probability 1. The probability of a verdict is shared out evenly over the other two.
    """

    def vote(rows: DataFrame) -> DataFrame:
        asked = rows.withColumns({f"{n}_prompt": p for n, p in prompts.items()})
        found = answered(asked, load, *prompts).drop(*(f"{n}_prob" for n in prompts))
        found = answered(found.withColumn("verdict_prompt", verdict), load, "verdict")
        p = F.col("verdict_prob")
        rest = (1 - p) / 2
        bits = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
        return found.withColumns({"entropy_bits": F.round(bits(p) + 2 * bits(rest), 6), "margin": F.round(p - rest, 6)})

    none = {n: F.lit(None).cast("string") for n in prompts}
    stay = {"verdict": F.concat(F.lit("VERDICT: STAY\n"), reason)} | {n: F.lit(v) for n, v in STOPPED.items()}
    return gated(df, stopped, none | stay, vote)
