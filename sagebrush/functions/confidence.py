"""Measures of a distribution over verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(weights: Column) -> Column:
    """Weights divided by their sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    return normalised(F.transform(logits, lambda x: F.exp(x - top)))


def entropy_bits(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def margin(p: Column) -> Column:
    """Difference of the two largest probabilities."""
    down = F.sort_array(p, asc=False)
    return F.get(down, 0) - F.coalesce(F.get(down, 1), F.lit(0.0))
