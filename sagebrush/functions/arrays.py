"""Running values along an array, in time that grows with n log n and not with the square of its length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Neighbours that a round joins; ``WIDTH`` ** ``ROUNDS`` is more than an array can hold.
WIDTH, ROUNDS = 8, 10


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with all before it.

    A fold can't do this: it copies the array it appends to at each step. Here each round joins runs of neighbours to
    runs ``WIDTH`` times as long, and rounds stop at the array's length. ``join`` is associative; it is given the earlier
    value first, which is null before the first element.
    """
    for r in range(ROUNDS):
        values = let(values, one_round(WIDTH**r, join))
    return values


def one_round(step: int, join: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    """Joins each element with those 1, 2 and up to ``WIDTH`` - 1 steps before it; nothing to do in a shorter array."""

    def reach(x: Column) -> Callable[[Column, Column], Column]:
        def joined(v: Column, i: Column) -> Column:
            for k in range(1, WIDTH):
                v = join(F.get(x, i - k * step), v)
            return v

        return joined

    return lambda x: F.when(F.size(x) > step, F.transform(x, reach(x))).otherwise(x)


def running_sum(values: Column) -> Column:
    """The sum of each element and all before it, none of them null."""
    return running(values, lambda before, x: F.coalesce(before, F.lit(0)) + x)


def running_max(values: Column) -> Column:
    return running(values, lambda before, x: F.greatest(before, x))


def running_last(values: Column) -> Column:
    """Each element, or where it is null the last one before it that isn't."""
    return running(values, lambda before, x: F.coalesce(x, before))
