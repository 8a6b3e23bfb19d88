"""Sampling, balancing, splitting and batching of labelled rows."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.operators.order import rank_within, running_total


def shuffled(seed: int, column: str) -> Column:
    """An order that depends on the seed and the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column).cast("string")))


def stratified(df: DataFrame, stratum: str, k: int, seed: int, id_column: str) -> DataFrame:
    """At most k rows of each stratum; each task sends k rows of a stratum at most."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(seed, id_column), id_column))
    return df.withColumn("place", place.cast("long")).filter(F.col("place") <= k)


def balanced(df: DataFrame, group: str, seed: int, id_column: str) -> DataFrame:
    """As many rows of each group as the smallest has."""
    # Places are numbered over a written table, so the rows are made once, also for the sizes.
    placed = rank_within(df, "place", [group], shuffled(seed, id_column), F.col(id_column))
    target = placed.groupBy(group).agg(F.max("place").alias("size")).agg(F.min("size").alias("target"))
    return placed.join(F.broadcast(target), F.col("place") <= F.col("target")).drop("target")


def grouped_split(df: DataFrame, bucket: list[str], group: str, ratio: float, seed: int) -> DataFrame:
    """Column split: train or val, so that no group of rows is in both.

    Of a bucket's n groups, n * ratio go to val, rounded half to even, at least one if n is 3 or more and never all;
    a single group is train. The window is over the distinct groups, not over the rows.
    """
    groups = df.select(*bucket, group).distinct()
    over = Window.partitionBy(*bucket)
    n = F.count(F.lit(1)).over(over)
    want = F.least(F.greatest(F.bround(n * ratio).cast("int"), F.when(n >= 3, 1).otherwise(0)), n - 1)
    place = F.row_number().over(over.orderBy(shuffled(seed, group), group))
    marked = groups.withColumn("split", F.when((n >= 2) & (place <= want), "val").otherwise("train"))
    keys = [*bucket, group]
    same = [F.col(f"_row.{k}").eqNullSafe(F.col(f"_mark.{k}")) for k in keys]
    rest = [c for c in df.columns if c not in keys]
    return df.alias("_row").join(marked.alias("_mark"), same).select(*(F.col(f"_row.{c}").alias(c) for c in (*keys, *rest)), "_mark.split")


def interleaved_batches(df: DataFrame, stratum: str, size: int, seed: int, id_column: str) -> DataFrame:
    """Batches that hold ``size`` different strata, dealt round by round; what fills no batch is dropped.

    A row's round is its place in its stratum. Rounds number rows within themselves, so nothing is ordered as a whole.
    """
    dealt = rank_within(df, "round", [stratum], shuffled(seed, id_column), F.col(id_column))
    placed = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("round").orderBy(stratum)) - 1)
    placed = placed.withColumn("part", F.floor(F.col("slot") / size))
    full = F.count(F.lit(1)).over(Window.partitionBy("round", "part"))
    return placed.withColumn("n", full).filter(F.col("n") == size).drop("n")


def first_of_combinations(df: DataFrame, group: str, dimensions: list[str], n: int, id_column: str) -> DataFrame:
    """The ``n`` smallest ids of each combination of values in each group."""
    place = F.row_number().over(Window.partitionBy(group, *dimensions).orderBy(F.asc_nulls_last(id_column)))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def diverse(df: DataFrame, group: str, dimensions: list[str], target: int, id_column: str) -> DataFrame:
    """Greedy choice of ``target`` rows of each group: always the row whose values have been used least so far.

    Usage is compared dimension by dimension, ties by id. Choices depend on each other, so a group is one task. Rows of
    one combination of values are taken by id, so ``target`` of each are all that it reads: its size is bounded by the
    number of combinations (see :func:`diverse_rounds` where these are many).
    """
    schema = df.schema

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_column)
        values = list(zip(*(rows[d] for d in dimensions), strict=True))
        used = [Counter() for _ in dimensions]
        left, taken = list(range(len(rows))), []
        while left and len(taken) < target:
            best = min(left, key=lambda i: (*(u[v] for u, v in zip(used, values[i], strict=True)), i))
            left.remove(best)
            taken.append(best)
            for u, v in zip(used, values[best], strict=True):
                u[v] += 1
        return rows.iloc[taken]

    return first_of_combinations(df, group, dimensions, target, id_column).groupBy(group).applyInPandas(choose, schema)


def greedy_counts(values: list[tuple], sizes: list[int], target: int) -> list[int]:
    """How many rows of each combination of values a greedy choice of ``target`` rows takes.

    Next is a row whose values have been used least so far, compared dimension by dimension; then one of the combination
    of which the fewest were taken, then the first in the list. Use only grows, so a combination's score in the heap is
    never too high, and one that comes up out of date is put back.
    """
    used = [Counter() for _ in values[0]] if values else []
    taken = [0] * len(values)
    score = lambda i: (*(u[v] for u, v in zip(used, values[i], strict=True)), taken[i], i)
    heap = [score(i) for i in range(len(values)) if sizes[i]]
    heapq.heapify(heap)
    while heap and target:
        seen = heapq.heappop(heap)
        i = seen[-1]
        if score(i) != seen:
            heapq.heappush(heap, score(i))
            continue
        target -= 1
        taken[i] += 1
        for u, v in zip(used, values[i], strict=True):
            u[v] += 1
        if taken[i] < sizes[i]:
            heapq.heappush(heap, score(i))
    return taken


def diverse_balanced(df: DataFrame, group: str, dimensions: list[str], seed: int, id_column: str, target: int | None = None) -> DataFrame:
    """``target`` rows of each group, or as many as the smallest group has, spread over the values of ``dimensions``.

    The greedy choice (:func:`greedy_counts`) needs the counts of combinations of values only: one row a group goes to
    Python, as long as the group has combinations. Which rows of a combination are taken is told by their places in a
    seeded order, numbered over several tasks where a combination is hot. Null values are values.
    """
    keys = [group, *dimensions]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spelled = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dimensions))
    combination = F.struct(F.md5(spelled).alias("_order"), *(F.col(d) for d in dimensions), F.col("_n"))
    groups = counts.groupBy(group).agg(F.sum("_n").alias("_size"), F.sort_array(F.collect_list(combination)).alias("_all"))
    least = groups.agg(F.min("_size").alias("_target")) if target is None else df.sparkSession.range(1).select(F.lit(target).alias("_target"))

    @F.pandas_udf("array<long>")
    def choose(values: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for combinations, n in zip(values, targets, strict=True):
            rows = [tuple(c.values()) for c in combinations]
            out.append(greedy_counts([r[1:-1] for r in rows], [int(r[-1]) for r in rows], int(n)))
        return pd.Series(out)

    chosen = groups.join(F.broadcast(least)).withColumn("_taken", choose("_all", "_target"))
    chosen = chosen.select(F.col(group), F.explode(F.arrays_zip("_all", "_taken")).alias("_c"))
    chosen = chosen.select(F.col(group), *(F.col("_c._all")[d].alias(d) for d in dimensions), F.col("_c._taken").alias("_taken")).filter("_taken > 0")
    placed = rank_within(df, "_place", keys, shuffled(seed, id_column), F.col(id_column))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return placed.alias("p").join(chosen.alias("c"), [*same, F.col("p._place") <= F.col("c._taken")]).select(*(F.col(f"p.{c}") for c in df.columns))


def diverse_rounds(df: DataFrame, group: str, dimensions: list[str], target: int, id_column: str) -> DataFrame:
    """A choice of ``target`` rows of each group without a sequential task: rows that are early within their values of
    each dimension come first. Of one combination of values no more than ``target`` rows are read."""
    df = first_of_combinations(df, group, dimensions, target, id_column)
    for i, d in enumerate(dimensions):
        df = df.withColumn(f"_early_{i}", F.row_number().over(Window.partitionBy(group, d).orderBy(*(f"_early_{j}" for j in range(i)), id_column)))
    early = [f"_early_{i}" for i in range(len(dimensions))]
    place = F.row_number().over(Window.partitionBy(group).orderBy(*reversed(early), id_column))
    return df.withColumn("place", place.cast("long")).filter(F.col("place") <= target).drop(*early)


def order_statistics(df: DataFrame, column: str) -> DataFrame:
    """n, min, median (the element at n // 2 from 0), p95 (at floor(0.95 * n), the last at most) and max, without interpolation.

    Values are counted first, so what is summed along the order is the distinct values' counts.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")).filter("v is not null")
    total = counts.agg(F.sum("c").alias("n"))
    below = running_total(counts, "upto", F.col("c"), F.col("v")).join(F.broadcast(total))
    from_place = lambda at: F.min(F.when(F.col("upto") > at, F.col("v")))
    p95 = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    return below.agg(F.max("n").alias("n"), F.min("v").alias("min_value"), from_place(F.floor(F.col("n") / 2)).alias("median"), from_place(p95).alias("p95"), F.max("v").alias("max_value"))


def with_scores(df: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a scorer (an iterator of pandas frames to the same with verdicts) over partitions; a model is loaded once in each."""
    return df.mapInPandas(scorer, schema)
