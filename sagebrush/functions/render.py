"""Texts made of columns: prompts, memos and templated analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bulleted(lines: Column, none: str = "") -> Column:
    told = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x)), "\n")
    return F.when(F.size(lines) > 0, told).otherwise(none)


def labelled(label: str, value: Column, none: str = "NONE") -> Column:
    return F.concat(F.lit(f"{label} "), F.coalesce(value, F.lit(none)))


def prompt(s: dict[str, Column]) -> Column:
    """A signal as a prompt; ``traces.parsed_prompt`` reads it back.

    ``s`` has category, tool_name, issues, tool, changes, notes, saving, net, met, hold, shelfware, disqualifier, previous.
    """
    number = lambda c: F.format_number(c.cast("bigint"), 0)
    money = F.concat(F.lit("Annual saving: £"), number(s["saving"]), F.lit(", Net: £"), number(s["net"]), F.lit(", Threshold met: "), F.when(s["met"], "YES").otherwise("NO"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Category: "), s["category"], F.lit(" — current tool: "), s["tool_name"]),
        F.lit("Known issues:"), bulleted(s["issues"]),
        F.lit("Changes this period"),
        F.lit("Current tool:"), bulleted(s["tool"], "(unchanged this period)"),
        F.lit("Competitor:"), bulleted(s["changes"], "(unchanged this period)"),
        F.lit("Buried signals / notes:"), bulleted(s["notes"], "(none)"),
        labelled("ROI:", money),
        labelled("Hold signal:", s["hold"]), labelled("Shelfware flag:", s["shelfware"]), labelled("Disqualifier:", s["disqualifier"]),
        F.concat(F.lit("Previous verdict: "), s["previous"]),
    )


def memo(s: dict[str, Column]) -> Column:
    """A memo with every section that a valid one needs; a HOLD also tells its condition and the day of its review.

    ``s`` has category, tool_name, cost, competitor, price, date (a day), push, pull, roi (struct), verdict, evidence,
    condition. The review is 92 days after ``date``.
    """
    pounds = lambda c: F.concat(F.lit(" (£"), F.format_number(c, 2), F.lit(")"))
    hold = s["verdict"] == "HOLD"
    money = F.concat(F.lit("  Annual net: £"), F.format_number(s["roi"]["annual_net"], 2), F.lit("\n  ROI threshold met: "), F.when(s["roi"]["met"], "YES").otherwise("NO"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CATEGORY: "), s["category"]),
        F.concat(F.lit("CURRENT TOOL: "), s["tool_name"], pounds(s["cost"])),
        F.concat(F.lit("COMPETITOR: "), s["competitor"], pounds(s["price"])),
        F.concat(F.lit("DATE: "), s["date"].cast("string")),
        F.lit("PUSH SIGNALS:"), bulleted(s["push"], "  - none"),
        F.lit("PULL SIGNALS:"), bulleted(s["pull"], "  - none"),
        F.lit("FINANCIAL ANALYSIS:"), money,
        F.concat(F.lit("VERDICT: "), s["verdict"]),
        F.lit("EVIDENCE:"), F.concat(F.lit('  "'), F.regexp_replace(s["evidence"], '["\n]', "'"), F.lit('"')),
        F.when(hold, F.concat(F.lit("REASSESS CONDITION: "), s["condition"])),
        F.when(hold, F.concat(F.lit("REVIEW BY: "), F.date_add(s["date"], 92).cast("string"))),
    )


def templated(df: DataFrame, templates: DataFrame, key: str, variant: str, fields: list[str]) -> DataFrame:
    """``text``: the template of each row's key, filled with its ``fields``; null for a key without one.

    ``templates`` has the key, variant (from 0) and template, in which ``{field}`` stands for a field. A key's templates are
    taken in turn by the row's variant. Templates are a parameter of some hundred rows, so they are broadcast as one row a key.
    """
    listed = templates.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "template"))), lambda x: x["template"]).alias("_all"))
    joined = df.join(F.broadcast(listed), key, "left")
    text = F.get("_all", F.pmod(F.col(variant), F.size("_all")).cast("int"))
    for field in fields:
        text = F.replace(text, F.lit("{" + field + "}"), F.coalesce(F.col(field).cast("string"), F.lit("")))
    return joined.withColumn("text", text).drop("_all")
