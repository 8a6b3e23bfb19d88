"""Return on investment and price inference as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

AMOUNT = r"(?i)(?:£|PS)\s*([0-9]+(?:\.[0-9]+)?)"


def annual_saving(current: Column, addon: Column, competitor: Column) -> Column:
    return F.round((current + F.coalesce(addon, F.lit(0.0)) - competitor) * 12, 2)


def roi(saving: Column, hours: Column | None = None, rate: Column | None = None, threshold: float = W.ROI_THRESHOLD) -> Column:
    """Struct of migration_cost, amortised, annual_net and met; the threshold is held against the unrounded net."""
    cost = (F.lit(W.MIGRATION_HOURS) if hours is None else hours) * (F.lit(W.STAFF_RATE) if rate is None else rate)
    amortised = cost / W.AMORTISED_YEARS
    net = saving - amortised
    return F.struct(F.round(cost.cast("double"), 2).alias("migration_cost"), F.round(amortised, 2).alias("amortised"), F.round(net, 2).alias("annual_net"), (net >= threshold).alias("met"))


def roi_bucket(result: Column) -> Column:
    return F.when(result["met"], "met").when(result["annual_net"] >= 0, "positive_below_threshold").otherwise("negative")


def inferred_price(delta: Column, baseline: Column, current: Column) -> Column:
    """The competitor's price after a change told in words; ``baseline`` if the words don't tell one."""
    said = F.trim(F.coalesce(delta, F.lit("")))
    low = F.lower(said)
    amounts = F.transform(F.regexp_extract_all(said, F.lit(AMOUNT), F.lit(1)), lambda x: x.cast("double"))
    number = lambda pattern, group: F.try_cast(F.nullif(F.regexp_extract(said, pattern, group), F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(F.regexp_extract(said, pattern, group), F.lit("")).try_cast("double")
    target = number(r"(?i)from\s*(?:£|PS)\s*([0-9]+(?:\.[0-9]+)?)\s*(?:/\w+)?\s*to\s*(?:£|PS)\s*([0-9]+(?:\.[0-9]+)?)", 2)
    less = number(r"(?i)(?:reduced|decreased|down)\s+by\s*£\s*([0-9]+(?:\.[0-9]+)?)", 1)
    more = number(r"(?i)(?:increased|increase|up)\s+by\s*£\s*([0-9]+(?:\.[0-9]+)?)", 1)
    only = F.get(amounts, 0)
    hinted = said.rlike(r"(?i)competitor|challenger|new tool|alternative|candidate")
    other = F.get(F.filter(amounts, lambda a: F.abs(a - current) >= 0.01), 0)
    return (
        F.when((said == "") | F.contains(low, F.lit("unchanged")) | (low == "competitive"), baseline)
        .when(target.isNotNull(), target)
        .when(less.isNotNull(), F.greatest(F.lit(0.0), baseline - less))
        .when(more.isNotNull(), baseline + more)
        .when((F.size(amounts) == 1) & (hinted | (F.abs(only - current) > 0.01)), only)
        .when(F.size(amounts) == 1, baseline)
        .when((F.size(amounts) >= 2) & other.isNotNull(), other)
        .when(F.contains(low, F.lit("slightly reduced")), F.greatest(F.lit(0.0), baseline - 10))
        .when(F.contains(low, F.lit("slightly increased")), baseline + 10)
        .otherwise(baseline)
    )
