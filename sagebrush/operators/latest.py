"""Latest rows, positions since a marker, and other operators on logs with an arrival order.

Logs carry ``seq``, the order of arrival, which breaks ties of ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_within


def latest_per_key(log: DataFrame, *keys: str, last_wins: bool = False) -> DataFrame:
    """The row of each key with the greatest ts.

    Of equal ts the first to arrive stays, or the last one if ``last_wins``. It is an aggregate, combined before the
    shuffle, so a hot key costs each task one row.
    """
    order = F.struct("ts", F.col("seq") if last_wins else -F.col("seq"))
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def last_rows(log: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in ``order``; at most ``n`` rows leave each task."""
    return log.orderBy(*order).limit(n)


def since_marker(log: DataFrame, marker: Column) -> DataFrame:
    """Rows that arrived after the last row for which ``marker`` holds; all rows if there is none.

    The marker's place is one row, so the join with it is a broadcast of one row.
    """
    place = log.filter(marker).agg(F.max("seq").alias("_marker"))
    return log.join(F.broadcast(place), F.coalesce(F.col("seq") > F.col("_marker"), F.lit(True))).drop("_marker")


def last_value(log: DataFrame, value: str, where: Column) -> DataFrame:
    """One row: ``value`` of the last row to arrive for which ``where`` holds, or null."""
    return log.filter(where).agg(F.max_by(value, "seq").alias(value))


def runs_of_marker(log: DataFrame, marker: Column, *keys: str) -> DataFrame:
    """``session``: how many markers of a row's key arrived up to it. A hot key's rows are parted by arrival."""
    return running_within(log, "session", F.when(marker, 1).otherwise(0), list(keys), F.asc("seq"))


def counts_since_marker(log: DataFrame, marker: Column, what: Column, *keys: str) -> DataFrame:
    """marker_seq and n_since of each key: its last marker's place (null without one), and the rows after it for which ``what`` holds.

    Both are aggregates, combined before the shuffle; the markers' places are joined back merged, as they grow with the keys.
    """
    last = log.groupBy(*keys).agg(F.max(F.when(marker, F.col("seq"))).alias("marker_seq"))
    placed = log.alias("l").join(last.alias("m").hint("merge"), [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    after = what & (F.col("seq") > F.coalesce("marker_seq", F.lit(-1)))
    return placed.groupBy(*(F.col(f"m.{k}").alias(k) for k in keys)).agg(F.max("marker_seq").alias("marker_seq"), F.count_if(after).alias("n_since"))
