"""Rules over text as column expressions: keywords, classes, signals, polarity, topics, verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def any_of(text: Column, keywords: list[str]) -> Column:
    """Whether a keyword occurs in the text in any case, as a substring."""
    return F.lower(text).rlike(alternation(list(dict.fromkeys(keywords))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def listed(keywords: list[str]) -> Column:
    """The keywords as one constant array, which the optimizer folds, so that a plan stays small whatever the list's length."""
    return F.split(F.lit("\x1f".join(keywords)), "\x1f")


def alternation(words: list[str]) -> str:
    """A pattern that finds any of the words; common beginnings are tried once, so a place without a word costs little."""
    if "" in words or len(words) == 1:
        return "" if "" in words else re.escape(words[0])
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    each = [re.escape(first) + alternation(list(dict.fromkeys(rest))) for first, rest in by_first.items()]
    return each[0] if len(each) == 1 else "(?:" + "|".join(each) + ")"


def finds(low: Column, words: list[str]) -> Column:
    """Whether a word occurs in a text that is in lower case, by one pass over it; for long lists, most of whose words don't occur."""
    return low.rlike(alternation(list(dict.fromkeys(words))))


def any_in(low: Column, keywords: list[str]) -> Column:
    """Whether a keyword occurs in a text that is in lower case."""
    return F.exists(listed(keywords), lambda k: F.contains(low, k))


def hits_in(low: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in a text that is in lower case."""
    return F.size(F.filter(listed(keywords), lambda k: F.contains(low, k)))


def hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the text in any case."""
    return let(F.lower(text), lambda low: hits_in(low, keywords))


def substance(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.when(hits_in(low, W.CONCRETE) > hits_in(low, W.VAGUE), "CONCRETE").otherwise("VAGUE"))


def severity(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.when(any_in(low, W.HIGH_SEVERITY), "HIGH").when(any_in(low, W.MEDIUM_SEVERITY), "MEDIUM").otherwise("LOW"))


def first_where(lines: Column, test) -> Column:
    """The first line that passes, or null."""
    return F.get(F.filter(lines, test), 0)


def advisory(line: Column) -> Column:
    return F.lower(line).rlike("^(?:" + "|".join(map(re.escape, W.ADVISORY)) + ")")


def hold_signal(notes: Column, changes: Column) -> Column:
    """The first note that holds a decision back, else the first such competitor change, else NONE."""
    note = first_where(notes, lambda x: any_of(x, W.HOLD_NOTE) & ~advisory(x) & ~x.rlike(W.NEGATION))
    change = first_where(changes, lambda x: any_of(x, W.HOLD_CHANGE) & ~x.rlike(W.NEGATION))
    return F.coalesce(note, change, F.lit("NONE"))


def disqualifier(notes: Column, hold: Column) -> Column:
    """The first note that rules the competitor out; only asked where nothing holds the decision back."""
    note = first_where(notes, lambda x: any_of(x, W.DISQUALIFIER) & ~advisory(x) & ~x.rlike(W.NEGATION))
    return F.when(hold != "NONE", "NONE").otherwise(F.coalesce(note, F.lit("NONE")))


def largest_int(text: Column, pattern: str) -> Column:
    """The largest integer that group 1 of ``pattern`` finds, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int")))


def shelfware(lines: Column, seats: int = 10, percent: int = 30) -> Column:
    """The first line that tells of unused seats; a line that denies shelfware as a whole silences all others."""

    def tells(x: Column) -> Column:
        many = F.coalesce(largest_int(x, r"(?i)inactive\s+seats?[^\d]*(\d+)") >= seats, F.lit(False)) | F.coalesce(largest_int(x, r"(\d+)%") >= percent, F.lit(False))
        return any_of(x, W.SHELFWARE) & ~x.rlike(W.SHELFWARE_NEGATION) & (any_of(x, W.SHELFWARE_WORDS) | many)

    return F.when(F.exists(lines, lambda x: x.rlike(W.SHELFWARE_DENIED)), "NONE").otherwise(F.coalesce(first_where(lines, tells), F.lit("NONE")))


def migration_enabler(notes: Column) -> Column:
    return F.coalesce(first_where(notes, lambda x: any_of(x, W.MIGRATION_ENABLER)), F.lit("NONE"))


def demand_signal(notes: Column) -> Column:
    return F.coalesce(first_where(notes, lambda x: any_of(x, W.DEMAND) & any_of(x, ["blocker"])), F.lit("NONE"))


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def topics(text: Column) -> Column:
    """Names of the topics whose patterns occur, in the order of the table."""
    known = [p for patterns in W.TOPICS.values() for p in patterns]
    named = lambda low: F.array(*(F.when(any_in(low, patterns), F.lit(name)) for name, patterns in W.TOPICS.items()))
    # Most texts tell of no topic, which one pass shows.
    return let(squeezed(F.lower(text)), lambda low: F.when(finds(low, known), F.filter(named(low), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


def tokens(text: Column) -> Column:
    """Distinct words of three or more ASCII letters and digits that aren't generic."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda x: F.length(x) > 2), F.array(*map(F.lit, W.GENERIC)))


def match_score(topics_a: Column, tokens_a: Column, topics_b: Column, tokens_b: Column) -> Column:
    shared, common = F.size(F.array_intersect(topics_a, topics_b)), F.size(F.array_intersect(tokens_a, tokens_b))
    return 10 * shared + F.when(common >= 2, common).otherwise(0) + F.when(shared > 0, 2).otherwise(0)


def polarity(text: Column, source: str, told: Column | None = None) -> Column:
    """positive, negative, pending or neutral, for a change of the competitor or of the current tool, or an issue.

    ``told`` are the text's topics, where they are known.
    """
    if source == "issue":
        return F.lit("negative")
    padded = F.concat(F.lit(" "), squeezed(F.lower(text)), F.lit(" "))
    weights = [*W.PENDING, *W.POSITIVE_OVERRIDES, *W.POSITIVE, *W.NEGATIVE, *([" no "] if " no " not in W.NEGATIVE else [])]
    silent_name = F.when(F.size(topics(text) if told is None else told) > 0, "positive").otherwise("neutral") if source == "competitor" else F.lit("neutral")

    def weighed(p: Column, over: Column) -> Column:
        good = F.when(over, 3).otherwise(0) + hits_in(p, W.POSITIVE)
        bad = hits_in(p, W.NEGATIVE) + F.when(F.startswith(p, F.lit(" no ")) & ~over, 2).otherwise(0)
        return F.struct(any_in(p, W.PENDING).alias("pending"), good.alias("good"), bad.alias("bad"))

    def named(w: Column) -> Column:
        good, bad = w["good"], w["bad"]
        if source == "competitor":
            silent = (good == 0) & (bad == 0)
            rest = F.when(silent, silent_name).when((bad >= good) & (bad > 0), "negative").otherwise("positive")
        else:
            rest = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
        return F.when(w["pending"], "pending").otherwise(rest)

    # Most texts hold no word that weighs, which one pass shows.
    full = lambda p: let(let(any_in(p, W.POSITIVE_OVERRIDES), lambda over: weighed(p, over)), named)
    return let(padded, lambda p: F.when(finds(p, weights), full(p)).otherwise(silent_name))


VERDICT_LINE = r"(?im)\*{0,2}VERDICT\*{0,2}\s*:[*\s]*(\w+)\*{0,2}"


def verdict(text: Column) -> Column:
    """The verdict line's word if it is valid, else the last bare verdict word, else null."""
    line = F.upper(F.regexp_extract(text, VERDICT_LINE, 1))
    bare = F.regexp_extract_all(text, F.lit(r"(?i)\b(SWITCH|STAY|HOLD)\b"), F.lit(1))
    return F.when(line.isin("SWITCH", "STAY", "HOLD"), line).otherwise(F.upper(F.try_element_at(bare, F.lit(-1))))


def parts_of(text: Column) -> Column:
    """A text cut before each header."""
    return F.split(text, r"\n(?=[A-Z][A-Z\s]+\s*:)")


def section_of(parts: Column, name: str) -> Column:
    own = first_where(parts, lambda p: F.get(F.split(p, "\n", 2), 0).rlike(rf"(?i)^\s*{re.escape(name)}\s*:"))
    return F.coalesce(F.get(F.split(own, "\n", 2), 1), F.lit(""))


def section(text: Column, name: str) -> Column:
    """Text below a section's header up to the next header; empty if there is none."""
    return section_of(parts_of(text), name)


def line_value(text: Column, name: str) -> Column:
    """What stands after ``name:`` on its line, trimmed; null if empty or absent."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{re.escape(name)}\s*:\s*(.+)$", 1)), F.lit(""))


def hold_metadata(memo: Column) -> Column:
    """What a hold register needs, as a struct; null if the memo isn't a HOLD or lacks a field. The memo is made once for each row."""
    names = ["CATEGORY", "CURRENT TOOL", "COMPETITOR", "REASSESS CONDITION", "REVIEW BY"]
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s*\(.*\)", ""))

    def built(m: Column) -> Column:
        bullet = F.nullif(F.trim(F.regexp_extract(section(m, "PUSH SIGNALS"), r"(?m)^\s{2,}-\s(.+)$", 1)), F.lit(""))
        told = lambda values: F.struct(
            F.lower(F.get(values, 0)).alias("category"),
            bare(F.get(values, 1)).alias("current_tool"),
            bare(F.get(values, 2)).alias("competitor"),
            F.coalesce(bullet, F.lit("See push signals in verdict memo.")).alias("hold_reason"),
            F.get(values, 3).alias("reassess_condition"),
            F.get(values, 4).alias("review_by"),
        )
        known = lambda values: F.when(F.forall(values, lambda v: v.isNotNull()), told(values))
        return F.when(verdict(m) == "HOLD", let(F.array(*(line_value(m, n) for n in names)), known))

    return let(memo, built)


def memo_errors(memo: Column) -> Column:
    """Reasons why a memo isn't valid, in order; empty if it is. The memo and its parts are made once for each row."""
    bullet = r"(?m)^\s{2,}-\s"
    lacks = lambda part, pattern, error: let(part, lambda p: F.when((p != "") & ~p.rlike(pattern), F.lit(error)))

    def of_parts(m: Column, word: Column, parts: Column) -> Column:
        has = lambda s: m.rlike(rf"(?im)^\s*{re.escape(s)}\s*:")
        checks = [F.when(~has(s), F.lit(f"missing section {s}")) for s in W.SECTIONS]
        checks += [
            F.when((word != "") & ~word.isin("SWITCH", "STAY", "HOLD"), F.lit("invalid verdict")),
            F.when(has("EVIDENCE") & ~section_of(parts, "EVIDENCE").rlike(r'"[^"\n]+"'), F.lit("no quote in EVIDENCE")),
            lacks(section_of(parts, "PUSH SIGNALS"), bullet, "no bullets in PUSH SIGNALS"),
            lacks(section_of(parts, "PULL SIGNALS"), bullet, "no bullets in PULL SIGNALS"),
            lacks(section_of(parts, "FINANCIAL ANALYSIS"), r"(?i)ROI threshold met\s*:", "no ROI line"),
            F.when((word == "HOLD") & ~has("REASSESS CONDITION"), F.lit("HOLD without REASSESS CONDITION")),
        ]
        return F.filter(F.array(*checks), lambda x: x.isNotNull())

    def of_memo(m: Column) -> Column:
        return let(F.upper(F.regexp_extract(m, VERDICT_LINE, 1)), lambda word: let(parts_of(m), lambda parts: of_parts(m, word, parts)))

    return let(memo, of_memo)


def lean_errors(text: Column) -> Column:
    """Reasons why a short answer (ANALYSIS and VERDICT lines) isn't valid."""
    word = F.upper(F.regexp_extract(text, VERDICT_LINE, 1))
    checks = [
        F.when(~text.rlike(r"(?im)^\s*\*{0,2}ANALYSIS\*{0,2}\s*:"), F.lit("missing ANALYSIS")),
        F.when(word == "", F.lit("missing VERDICT")),
        F.when((word != "") & ~word.isin("SWITCH", "STAY", "HOLD"), F.lit("invalid verdict")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def is_weak(analysis: Column, least_hits: int = 2, least_length: int = 200) -> Column:
    """Reasoning with few connectives, short, with fewer than two boundaries, or with placeholder text."""
    marks = sum((F.contains(analysis, F.lit(b)).cast("int") for b in W.BOUNDARIES), F.lit(0))
    return (hits(analysis, W.CONNECTIVES) < least_hits) | (F.length(analysis) < least_length) | (marks < 2) | any_of(analysis, list(W.PLACEHOLDERS))


def without_placeholders(text: Column) -> Column:
    for found, put in W.PLACEHOLDERS.items():
        text = F.regexp_replace(text, "(?i)" + re.escape(found), put)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"\.\.+", "."))


def replace_first(text: Column, found: str, put: str) -> Column:
    """Replace the first occurrence only."""
    at = F.instr(text, F.lit(found))
    return F.when(at > 0, F.overlay(text, F.lit(put), at, F.lit(len(found)))).otherwise(text)


def numbered_verdicts(text: Column, n: int) -> Column:
    """Verdicts of cases 1..n: tagged [k] ones first, the others by the order in which verdicts stand."""
    tags = F.regexp_extract_all(text, F.lit(r"(?is)\[(\d+)\][^\[]*?VERDICT\b[^A-Z\n]{0,10}(SWITCH|STAY|HOLD)"), F.lit(1))
    said = F.regexp_extract_all(text, F.lit(r"(?is)\[(\d+)\][^\[]*?VERDICT\b[^A-Z\n]{0,10}(SWITCH|STAY|HOLD)"), F.lit(2))
    ordered = F.regexp_extract_all(text, F.lit(r"(?i)VERDICT\b[^A-Z\n]{0,10}(SWITCH|STAY|HOLD)"), F.lit(1))
    pairs = F.arrays_zip(tags.alias("tag"), said.alias("word"))

    def of(i: Column) -> Column:
        tagged = F.filter(pairs, lambda p: p["tag"].cast("int") == i)
        return F.upper(F.coalesce(F.try_element_at(tagged, F.lit(-1))["word"], F.get(ordered, i - 1)))

    return F.transform(F.sequence(F.lit(1), F.lit(n)), of)


def reward(parsed: Column, expected: Column) -> Column:
    """Share of expected verdicts met; 0 if none are expected."""
    met = F.size(F.filter(F.zip_with(parsed, expected, lambda p, e: F.coalesce(p == e, F.lit(False)) & e.isNotNull()), lambda x: x))
    return F.when(F.size(expected) > 0, met / F.size(expected)).otherwise(0.0)


def title_case(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))


def category_label(category: Column) -> Column:
    return F.when(category == "project_mgmt", "Project Management").when(category.isin("crm", "hr"), F.upper(category)).otherwise(F.concat(F.upper(F.left(category, F.lit(1))), F.substring(category, F.lit(2), F.length(category))))


def version_label(updated: Column) -> Column:
    """``vYY.MM`` of a day told as text; null without one."""
    return F.when(F.coalesce(updated, F.lit("")) != "", F.concat(F.lit("v"), F.substring(updated, 3, 2), F.lit("."), F.substring(updated, 6, 2)))


def moment_label(ts: Column) -> Column:
    """Day and minute of a moment told as text; the day alone at midnight, a dash without one."""
    day, minute = F.left(ts, F.lit(10)), F.substring(ts, 12, 5)
    return F.when(F.coalesce(ts, F.lit("")) == "", "—").otherwise(F.when(minute.isin("", "00:00"), day).otherwise(F.concat_ws(" ", day, minute)))


def confidence_label(p: Column) -> Column:
    """A probability with four digits, a dash without one."""
    return F.coalesce(F.format_number(p, 4), F.lit("—"))


def slugified(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def sentence_case(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def json_between(text: Column) -> Column:
    """The outermost braces of noisy text, without trailing commas; null if it still isn't JSON."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_replace(body, r",\s*([}\]])", "$1")))
