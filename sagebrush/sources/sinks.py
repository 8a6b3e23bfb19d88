"""Sinks: registers, maps, memos, registries and reports as folders of Parquet or JSON files.

What is changed in place is a :class:`Store`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

HOLDS = "category string, current_tool string, competitor string, hold_reason string, reassess_condition string, issued_date string, review_by string"
SUMMARIES = "memo string, summary string"
COMPETITORS = "category string, slug string, name string, based_on string, monthly_cost_gbp double, pricing_model string, recent_trajectory string, last_updated string, scraper_url string"
MEMOS = "memo string, date string, category string, slug string, text string"


def append_holds(register: Store, holds: DataFrame, today: str) -> None:
    """Add holds to the register; one without a date of issue gets ``today``."""
    issued = F.coalesce(F.col("issued_date"), F.lit(today)) if "issued_date" in holds.columns else F.lit(today)
    register.append(holds.withColumn("issued_date", issued))


def add_competitors(registry: Store, entries: DataFrame, today: str) -> None:
    """Add entries (category, slug, name, monthly_cost_gbp, scraper_url) with the defaults of a new competitor; known ones are replaced."""
    made = entries.select("category", "slug", "name", F.lit("user-added").alias("based_on"), "monthly_cost_gbp", F.lit("unknown").alias("pricing_model"), F.lit("newly added").alias("recent_trajectory"), F.lit(today).alias("last_updated"), F.coalesce("scraper_url", F.lit("")).alias("scraper_url"))
    registry.upsert(made, "category", "slug")


def memo_name(memos: DataFrame) -> Column:
    """Names of memos (date, category, slug and, where it is known, scenario)."""
    scenario = F.concat(F.lit("-"), F.col("scenario")) if "scenario" in memos.columns else F.lit(None).cast("string")
    return F.concat(F.concat_ws("-", "date", "category", "slug"), F.coalesce(scenario, F.lit("")), F.lit(".md"))


def memo_rows(memos: DataFrame) -> DataFrame:
    """Memos (date, category, slug, text and, where it is known, scenario) under their names."""
    return memos.select(memo_name(memos).alias("memo"), "date", "category", "slug", "text")


def write_memos(store: Store, memos: DataFrame) -> None:
    """Add memos to a store of ``MEMOS``; one with a known name is replaced."""
    store.upsert(memo_rows(memos), "memo")


def overwrite_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, instead of what was there. ``df`` must not be read from ``path``."""
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, path: str) -> None:
    """A small result as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def bullets(items: Column, mark: str, none: str) -> Column:
    told = F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, told).otherwise(none)


def flag(value: Column) -> Column:
    return F.when(value.isNull(), "Unknown").when(value, "Yes").otherwise("No")


def inbox_reports(registry: DataFrame, written: DataFrame) -> DataFrame:
    """name and text of a report on each competitor that has none in ``written`` (name).

    The registry has category, slug, name, monthly_cost_gbp, cost_per_seat_gbp, pricing_tiers (name, monthly_cost_gbp),
    features, known_limitations, integration_compatibility, compliance (sso_saml, soc2_type2, uk_residency), recent_trajectory.
    """
    name = F.concat_ws("", "category", F.lit("_"), "slug", F.lit(".md"))
    price = lambda c: F.concat(F.lit("£"), F.coalesce(c.cast("bigint").cast("string"), F.lit("N/A")), F.lit("/mo"))
    tiers = F.transform("pricing_tiers", lambda t: F.concat(F.lit("- **"), F.coalesce(t["name"], F.lit("Tier")), F.lit("**: "), price(t["monthly_cost_gbp"])))
    pricing = F.concat_ws("\n", F.concat(F.lit("- **Base**: "), price(F.col("monthly_cost_gbp"))), F.concat(F.lit("- **Per seat**: £"), F.col("cost_per_seat_gbp").cast("string"), F.lit("/seat/mo")), F.array_join(tiers, "\n"))
    flags = F.concat_ws("\n", *(F.concat(F.lit(f"- **{label}**: "), flag(F.col("compliance")[key])) for label, key in (("SSO", "sso_saml"), ("SOC2 Type II", "soc2_type2"), ("UK residency", "uk_residency"))))
    parts = [
        F.concat(F.lit("# "), F.coalesce("name", "slug")),
        F.lit("## Pricing"), pricing,
        F.lit("## Features"), bullets(F.col("features"), "- ", "- No notable features listed"),
        F.lit("## Limitations"), bullets(F.col("known_limitations"), "- ", "- None noted"),
        F.lit("## Integrations"), F.coalesce(F.nullif(F.array_join("integration_compatibility", ", "), F.lit("")), F.lit("None listed")),
        F.lit("## Compliance"), flags,
        F.lit("## Trajectory"), F.coalesce("recent_trajectory", F.lit("stable")),
    ]
    made = registry.select(name.alias("name"), F.concat_ws("\n", *parts).alias("text"))
    return made.join(written.select("name").distinct(), "name", "left_anti")


FEEDBACK_FIELDS = ["memo_filename", "correct", "stated_verdict", "actual_verdict"]


def feedback_events(requests: DataFrame, now: str) -> DataFrame:
    """Feedback requests (columns of text and flags) as events of the log; ``missing`` names the fields that a request lacks.

    A request with missing fields is no event: filter on an empty ``missing`` before appending to the log.
    """
    missing = F.filter(F.array(*(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in FEEDBACK_FIELDS)), lambda x: x.isNotNull())
    return requests.select(F.lit(now).alias("ts"), F.lit("human_feedback").alias("type"), *FEEDBACK_FIELDS, missing.alias("missing"))
