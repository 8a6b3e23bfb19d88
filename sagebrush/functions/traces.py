"""Reasoning traces: parsing of prompts and answers, classes of reasoning, rebuilt verdicts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .arrays import running_last
from .signals import changed_lines, stripped
from .text import any_of, first_where, let

#: Words that begin like a competitor's name and aren't one.
NOT_NAMES = [
    "SWITCH", "STAY", "HOLD", "CONCRETE", "VAGUE", "None", "Pull", "Push", "Step", "Gate", "ROI", "Compliance", "Migration", "Annual", "Threshold",
    "HIGH", "MEDIUM", "Previously", "BLOCKED", "PASSED", "NONE", "The", "Both", "When", "Decision", "Shelfware",
]
#: Inline remarks that stand for no lines.
NO_LINES = ["(unchanged this period)", "(none)"]


def after_label(text: Column, label: str) -> Column:
    """What stands after ``label`` at the start of its last line; empty if no line begins so."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^{re.escape(label)}(.*)$"), F.lit(1))
    return F.coalesce(stripped(F.try_element_at(found, F.lit(-1))), F.lit(""))


def sections(lines: Column, name) -> Column:
    """Lines with the section that each is in, as structs (section, line).

    ``name`` tells a line's section if it begins one ('' for none), or null; a line is in the last section begun before it.
    """

    def told(x: Column, begun: Column, current: Column) -> Column:
        def entry(line: Column, i: Column) -> Column:
            item = F.get(begun, i).isNull() & F.startswith(line, F.lit("- "))
            return F.struct(F.coalesce(F.get(current, i), F.lit("")).alias("section"), F.substring(line, F.lit(3), F.length(line)).alias("line"), item.alias("item"))

        return F.transform(x, entry)

    entries = let(lines, lambda x: let(F.transform(x, name), lambda begun: let(running_last(begun), lambda current: told(x, begun, current))))
    kept = F.filter(entries, lambda e: e["item"] & (e["section"] != ""))
    return F.transform(kept, lambda e: F.struct(e["section"].alias("section"), e["line"].alias("line")))


def of_section(found: Column, section: str) -> Column:
    return F.transform(F.filter(found, lambda x: x["section"] == section), lambda x: x["line"])


def parsed_prompt(text: Column) -> Column:
    """category, tool, roi, hold, shelfware, disqualifier and previous verdict of a prompt, and its issues, tool lines, competitor lines and notes."""

    def begins(line: Column) -> Column:
        starts = lambda s: F.startswith(line, F.lit(s))
        return (
            F.when(F.contains(F.lower(line), F.lit("known issues:")), "issues")
            .when(starts("Changes this period") | starts("ROI:"), "")
            .when(starts("Buried signals / notes:"), "notes")
            .when(starts("Current tool:"), "tool")
            .when(starts("Competitor:"), "competitor")
        )

    def inline(lines: Column, label: str) -> Column:
        """What stands on the header's own line, where it isn't a remark."""
        told = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(label))), lambda x: stripped(F.substring(x, F.lit(len(label) + 1), F.length(x)))), lambda x: (x != "") & ~x.isin(NO_LINES))
        return F.transform(told, lambda x: F.regexp_replace(x, "^- ", ""))

    def built(lines: Column, halves: Column, found: Column) -> Column:
        return F.struct(
            stripped(F.get(halves, 0)).alias("category"),
            F.coalesce(stripped(F.regexp_replace(F.get(halves, 1), "current tool:", "")), F.lit("")).alias("tool"),
            after_label(text, "ROI:").alias("roi"),
            after_label(text, "Hold signal:").alias("hold"),
            after_label(text, "Shelfware flag:").alias("shelfware"),
            after_label(text, "Disqualifier:").alias("disqualifier"),
            after_label(text, "Previous verdict:").alias("previous_verdict"),
            of_section(found, "issues").alias("issues"),
            F.concat(inline(lines, "Current tool:"), of_section(found, "tool")).alias("tool_lines"),
            F.concat(inline(lines, "Competitor:"), of_section(found, "competitor")).alias("competitor_lines"),
            of_section(found, "notes").alias("notes"),
        )

    # Lines and sections are made once for each row, however many fields read them.
    with_halves = lambda lines, found: let(F.split(after_label(text, "Category:"), "—"), lambda halves: built(lines, halves, found))
    return let(F.transform(F.split(text, "\n"), stripped), lambda lines: let(sections(lines, begins), lambda found: with_halves(lines, found)))


def parsed_answer(text: Column) -> Column:
    """push and pull lines, compliance, roi, hold condition, analysis, verdict and competitor of an answer."""
    lines = F.split(text, "\n")

    def begins(line: Column) -> Column:
        starts = lambda *s: F.coalesce(*(F.when(F.startswith(line, F.lit(x)), True) for x in s), F.lit(False))
        ends = ["COMPLIANCE:", "ROI:", "HOLD CONDITION:", "ANALYSIS:", "VERDICT:"]
        return F.when(starts("PUSH SIGNALS:"), "push").when(starts("PULL SIGNALS:"), "pull").when(starts(*ends), "")

    def built(found: Column, pull: Column, analysis: Column) -> Column:
        delivers = first_where(pull, lambda x: x.rlike(r"^\w[\w\s]*?\s+delivers\s+"))
        named = first_where(F.split(analysis, r"\s+"), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 3) & ~w.isin(NOT_NAMES))
        return F.struct(
            of_section(found, "push").alias("push_lines"),
            pull.alias("pull_lines"),
            after_label(text, "COMPLIANCE:").alias("compliance"),
            after_label(text, "ROI:").alias("roi"),
            after_label(text, "HOLD CONDITION:").alias("hold_condition"),
            analysis.alias("analysis"),
            after_label(text, "VERDICT:").alias("verdict"),
            F.coalesce(stripped(F.regexp_extract(delivers, r"^(\w[\w\s]*?)\s+delivers\s+", 1)), named, F.lit("")).alias("competitor"),
        )

    # Sections, pull lines and the analysis are made once for each row, however many fields read them.
    with_pull = lambda found: let(of_section(found, "pull"), lambda pull: let(after_label(text, "ANALYSIS:"), lambda analysis: built(found, pull, analysis)))
    return let(sections(F.transform(lines, lambda x: F.when(begins(x).isNotNull(), x).otherwise(stripped(x))), begins), with_pull)


#: Classes of reasoning by verdict; the first class of which a group of words stands in the analysis (all of a group's).
PATTERNS: dict[str, list[tuple[str, list[list[str]]]]] = {
    "STAY": [
        ("stay_irrelevant", [["irrelevant"], ["relevance"], ["misses"]]),
        ("stay_fluff", [["vague"], ["substance"], ["marketing"]]),
        ("stay_rally", [["weakening"], ["incumbent"], ["recovering"], ["improving"]]),
        ("stay_disqualifier", [["disqualifier"], ["pre-ga"]]),
        ("stay_price", [["price"], ["pricing"], ["cost"]]),
        ("stay_both", [["both", "insufficient"], ["both", "weak"], ["both", "present"]]),
    ],
    "SWITCH": [
        ("switch_gate_check", [["gate check"]]),
        ("switch_compliance", [["compliance", "previously"], ["compliance", "unblocked"], ["compliance", "cleared"]]),
        ("switch_push_high", [["push signal: high"], ["failing"], ["degrading"]]),
        ("switch_both_aligned", [["aligned"]]),
        ("switch_shelfware", [["shelfware"], ["waste"], ["underutilised"], ["idle"]]),
        ("switch_both_signals", [["both", "pull"]]),
    ],
    "HOLD": [("hold_pilot", [["pilot"]])],
}
OTHERWISE = {"STAY": "stay_generic", "SWITCH": "switch_generic", "HOLD": "hold_confirmed"}


def reasoning_pattern(verdict: Column, analysis: Column, held_before: Column) -> Column:
    """The class of a trace's reasoning; a switch after a hold is its own class and goes before the others."""
    low = F.lower(analysis)
    out = F.when((verdict == "SWITCH") & held_before, "switch_hold_resolved")
    for said, classes in PATTERNS.items():
        for name, groups in classes:
            test = F.lit(False)
            for group in groups:
                every = F.lit(True)
                for word in group:
                    every = every & F.contains(low, F.lit(word))
                test = test | every
            out = out.when((verdict == said) & test, name)
        out = out.when(verdict == said, OTHERWISE[said])
    return out.otherwise("unknown")


def thousands(text: Column, pattern: str) -> Column:
    """The integer that group 1 of ``pattern`` tells with commas and a sign; 0 if there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(text, pattern, 1), "[,+]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def answer_roi(line: Column) -> Column:
    """migration, annual and met of an answer's ROI line."""
    met = F.contains(line, F.lit("MET")) & ~F.contains(line, F.lit("NOT MET"))
    return F.struct(thousands(line, r"Migration £([\d,]+)").alias("migration"), thousands(line, r"Annual net £([+-]?[\d,]+)").alias("annual"), met.alias("met"))


def prompt_roi(text: Column) -> Column:
    """annual_saving, net, threshold_met and roi_line of a prompt."""
    return F.struct(
        thousands(text, r"Annual saving:\s*£(-?[\d,]+)").alias("annual_saving"),
        thousands(text, r"Net:\s*£(-?[\d,]+)").alias("net"),
        (F.regexp_extract(text, r"Threshold met:\s*(YES|NO)", 1) == "YES").alias("threshold_met"),
        stripped(F.regexp_extract(text, r"(ROI:.+)", 1)).alias("roi_line"),
    )


def quotes(text: Column, most: int = 6) -> Column:
    """The first quoted strings of a text."""
    return F.slice(F.regexp_extract_all(text, F.lit(r'"([^"\n]+)"'), F.lit(1)), 1, most)


def rated(text: Column, ratings: str, shortest: int) -> Column:
    """Texts of numbered bold entries with one of the ratings (an alternation), as (text, rating)."""
    pattern = rf'(?i)\d+\.\s+\*\*"?([^*\n"]{{{shortest},120}})"?\*\*[:\s]+({ratings})'
    texts, ratings_found = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(texts, ratings_found, lambda t, r: F.struct(stripped(t).alias("text"), F.upper(r).alias("rating")))


def high_signals(text: Column, most: int = 3) -> Column:
    """Texts rated HIGH, without dashes at their end."""
    bare = F.transform(rated(text, "HIGH", 10), lambda x: stripped(F.regexp_replace(x["text"], r"[\s—–-]+$", "")))
    return F.slice(F.filter(bare, lambda x: x != ""), 1, most)


def rated_bullets(text: Column, most: int = 5) -> Column:
    """Rated entries as a bullet list; ``(none)`` without any."""
    told = F.transform(F.slice(rated(text, "HIGH|MEDIUM|LOW", 5), 1, most), lambda x: F.concat(F.lit("  - "), x["text"], F.lit(" ["), x["rating"], F.lit("]")))
    return F.when(F.size(told) > 0, F.array_join(told, "\n")).otherwise("  (none)")


def strength(text: Column, side: str) -> Column:
    """STRONG, MODERATE or WEAK as labelled, else by how often HIGH stands in the text."""
    said = F.upper(F.regexp_extract(text, rf"(?i)Overall\s+{side}\s*[:\-–]\s*(STRONG|MODERATE|WEAK)", 1))
    n = F.size(F.regexp_extract_all(text, F.lit(r"(?i)\bHIGH\b"), F.lit(0)))
    return F.when(said != "", said).when(n >= 3, "STRONG").when(n >= 1, "MODERATE").otherwise("WEAK")


def compliance_said(text: Column) -> Column:
    """FAIL, PASS or the text's first line; FAIL goes before PASS."""
    up = F.upper(text)
    return F.when(F.contains(up, F.lit("FAIL")), "FAIL").when(F.contains(up, F.lit("PASS")) | F.contains(up, F.lit("COMPLIANT")), "PASS").otherwise(F.get(F.split(text, "\n"), 0))


def compliance_reason(text: Column) -> Column:
    """The first failing requirement of a compliance answer."""
    bold = F.nullif(stripped(F.regexp_extract(text, r"(?i)\*\*(No [^*\n]{5,80}|[^*\n]{5,80}outside[^*\n]{5,60})\*\*", 1)), F.lit(""))
    line = first_where(F.split(text, r"\r?\n"), lambda x: any_of(x, ["fail", "no soc2", "residency"]))
    bare = F.regexp_replace(stripped(line), r"^[*\-]+|[*\-]+$", "")
    return F.coalesce(bold, stripped(bare), F.lit("a hard compliance requirement is not met"))


def header(text: Column) -> Column:
    return stripped(F.get(F.split(text, "\n"), 0))


def rebuilt_verdict(scenario: Column, push: Column, pull: Column, roi_met: Column, blocked: Column | None = None) -> Column:
    """The verdict that a scenario asks for; else STAY if ``blocked``, else by the strengths of both sides and the return."""
    named = {s: v for s, v in W.EXPECTED_VERDICT.items() if v and s in W.PUSH_STRENGTH}
    stated = F.try_element_at(F.create_map(*(F.lit(x) for kv in named.items() for x in kv)), scenario)
    able = lambda x: x.isin("STRONG", "MODERATE")
    return F.coalesce(
        stated,
        F.when(F.lit(False) if blocked is None else blocked, "STAY")
        .when(roi_met & able(push) & able(pull), "SWITCH")
        .when(~roi_met & (push == "STRONG") & (pull == "STRONG"), "SWITCH")
        .when((push == "WEAK") | (pull == "WEAK"), "STAY")
        .otherwise("HOLD"),
    )


def scenario_strength(scenario: Column, side: str) -> Column:
    table = W.PUSH_STRENGTH if side == "push" else W.PULL_STRENGTH
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), scenario), F.lit("MODERATE"))


def tells_roadmap(text: Column) -> Column:
    return any_of(text, W.ROADMAP_WORDS)


def with_verdict(answer: Column, verdict: Column, every: bool = False) -> Column:
    """The answer with its first verdict line (or every verdict, if ``every``) replaced; a verdict is appended where none stands."""
    put = F.concat(F.lit("VERDICT: "), verdict)
    ends = F.regexp_replace(answer, r"\s+$", "")
    if every:
        body, pattern = stripped(answer), r"(?i)\bVERDICT:\s*(SWITCH|STAY|HOLD)\b"
        return F.when(verdict.isNull(), body).when(body.rlike(pattern), F.regexp_replace(body, F.lit(pattern), put)).otherwise(F.concat(body, F.lit("\n"), put))
    line = F.regexp_extract(answer, r"VERDICT:\s*(SWITCH|STAY|HOLD)[^\n]*", 0)
    replaced = F.overlay(answer, put, F.instr(answer, line), F.length(line))
    return F.when((line != "") & (replaced != answer), replaced).otherwise(F.concat(ends, F.lit("\n"), put))


#: Words that make an issue severe.
SEVERE_ISSUE = ["required", "missing", "manual", "outdated", "no ", "cannot", "compliance", "audit", "sso", "gdpr"]


def severe_issue(issue: Column, push_lines: Column) -> Column:
    """Whether a push line rates the issue HIGH, or a word in it does."""
    return F.exists(push_lines, lambda x: F.contains(x, issue) & F.contains(x, F.lit("Severity: HIGH"))) | any_of(issue, SEVERE_ISSUE)


def flags(prompt: Column, answer: Column) -> Column:
    """What a parsed trace tells: a hold before, an active hold, a disqualifier, shelfware, changes of the tool, substance of the pull."""
    told = lambda c: ~c.isin("", "NONE")
    rated_so = lambda kind: F.exists(answer["pull_lines"], lambda x: F.contains(x, F.lit(f"Substance: {kind}")))
    return F.struct(
        (F.upper(prompt["previous_verdict"]) == "HOLD").alias("held_before"),
        told(answer["hold_condition"]).alias("hold"),
        told(prompt["disqualifier"]).alias("disqualifier"),
        told(prompt["shelfware"]).alias("shelfware"),
        (F.size(changed_lines(prompt["tool_lines"])) > 0).alias("changed"),
        F.when(F.size(answer["pull_lines"]) == 0, "NONE").when(rated_so("CONCRETE"), "CONCRETE").when(rated_so("VAGUE"), "VAGUE").otherwise("UNKNOWN").alias("pull_substance"),
    )
