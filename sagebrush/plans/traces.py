"""Reasoning traces: prompts and answers made of documents, parsed, classed, filtered and rebuilt.

The tables hold no traces. A document's whole text is the analysis of its answer, and its lines stand in one section of
its prompt; sentences picked by hashes of the id are put after them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import text as X
from sagebrush.functions import traces as T
from sagebrush.functions import words as W
from sagebrush.operators.matching import first_of_each, pivot_steps
from sagebrush.operators.sampling import shuffled

from .registry import query, table
from .signals import ISSUES, SIGNALS, SQUEEZED, one_of, one_of_sql, pick, pick_sql, quoted, signals, some, some_sql

ANALYSES = [
    "The update is irrelevant because it misses the issue. Not STAY: no. Not HOLD: there is no hold, therefore it stays.", "Vague marketing without substance.", "The incumbent is recovering, therefore the case is weakening.",
    "A disqualifier applies: pre-GA feature.", "Pricing is higher and the cost rises.", "Both signals are present but insufficient.", "Gate check passed; both pull and push agree.",
    "Compliance was previously blocked and is now cleared.", "Push signal: HIGH since the sync is failing.", "Pull and push are aligned.", "Idle seats are waste.", "A pilot is running until June.", "Nothing else to tell. issues persist",
]
VERDICTS = ["SWITCH", "STAY", "HOLD"]
ROI_LINES = ["ROI: Migration £1,200 | Annual net £-3,450 | NOT MET", "ROI: Migration £720 | Annual net £+2,640 | MET", "ROI: no figures"]


def bullets(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x)), "\n")


def picks(values: list[str], slot: str, n: int) -> Column:
    return F.filter(F.array(*(one_of(values, f"{slot}{k}") for k in range(n))), lambda x: x != "")


def analysis() -> Column:
    """A document's whole text in one line, and a sentence after it."""
    return F.trim(F.concat(X.squeezed(F.col("text")), F.lit(" "), one_of(ANALYSES, "analysis")))


ANALYSIS = f"trim({SQUEEZED} || ' ' || {one_of_sql(ANALYSES, 'analysis')})"


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt and answer of each document; parts vary independently."""
    nl = "\n"
    prompt = F.concat(
        F.lit("Category: "), one_of(W.CATEGORIES, "category"), F.lit(" — current tool: Tool "), pick("tool", 9).cast("string"), F.lit(nl + "Known issues:" + nl), bullets(some("i", 2)),
        F.lit(nl + "Changes this period" + nl + "Current tool: "), one_of(["(none)", "- inline change", ""], "inline"), F.lit(nl), bullets(some("t", 2)),
        F.lit(nl + "Competitor:" + nl), bullets(some("c", 3)), F.lit(nl + "Buried signals / notes:" + nl), bullets(some("n", 2)),
        F.lit(nl + "ROI: Annual saving: £"), (pick("saving", 4000) - 1000).cast("string"), F.lit(", Net: £1,"), F.lpad(pick("net", 999).cast("string"), 3, "0"), F.lit(", Threshold met: "), one_of(["YES", "NO"], "met"),
        F.lit(nl + "Hold signal: "), one_of(["NONE", "renewal"], "held"), F.lit(nl + "Previous verdict: "), one_of(["HOLD", "STAY", "none"], "before"),
    )
    answer = F.concat(
        F.lit("PUSH SIGNALS:" + nl), bullets(picks(ISSUES, "p", 2)), F.lit(nl + "PULL SIGNALS:" + nl + "  - "), one_of(["Quillboard delivers native sync — Substance: CONCRETE", "Vague words — Substance: VAGUE", "Nothing"], "pull"),
        F.lit(nl + nl + "COMPLIANCE: "), one_of(["PASSED", "BLOCKED — No SOC2"], "gate"), F.lit(nl), one_of(ROI_LINES, "roi"), F.lit(nl + "HOLD CONDITION: "), one_of(["NONE", "until renewal"], "cond"),
        F.lit(nl + "ANALYSIS: "), analysis(), F.lit(nl + "VERDICT: "), one_of(VERDICTS, "verdict"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), answer.alias("answer"))


_BULLETS = lambda values, slot, n: f"list_filter([{', '.join(one_of_sql(values, f'{slot}{k}') for k in range(n))}], lambda x: x <> '')"


@query(f"""SELECT doc_id, {one_of_sql(W.CATEGORIES, "category")} AS category, 'Tool ' || {pick_sql("tool", 9)} AS tool, array_to_string({some_sql("i", 2)}, '|') AS issues,
array_to_string(CASE WHEN {pick_sql("inline", 3)} = 1 THEN ['inline change'] ELSE [] END || ({some_sql("t", 2)}), '|') AS tool_lines, array_to_string({some_sql("c", 3)}, '|') AS competitor_lines,
array_to_string({some_sql("n", 2)}, '|') AS notes, {one_of_sql(["NONE", "renewal"], "held")} AS hold, {one_of_sql(["HOLD", "STAY", "none"], "before")} AS previous_verdict FROM documents""")
def q_parsed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts back into the fields that they were made of."""
    t = traces(spark, sf_dir).select("doc_id", T.parsed_prompt(F.col("prompt")).alias("p"))
    joined = lambda c: F.array_join(f"p.{c}", "|").alias(c)
    return t.select("doc_id", "p.category", "p.tool", joined("issues"), joined("tool_lines"), joined("competitor_lines"), joined("notes"), "p.hold", "p.previous_verdict")


@query(f"""WITH a AS (SELECT doc_id, {pick_sql("pull", 3)} AS k, {ANALYSIS} AS analysis FROM documents)
SELECT doc_id, array_to_string({_BULLETS(ISSUES, "p", 2)}, '|') AS push_lines, {one_of_sql(["PASSED", "BLOCKED — No SOC2"], "gate")} AS compliance, {one_of_sql(["NONE", "until renewal"], "cond")} AS hold_condition, analysis, {one_of_sql(VERDICTS, "verdict")} AS verdict,
CASE WHEN k = 0 THEN 'Quillboard' ELSE coalesce(list_filter(string_split_regex(analysis, '[ \\t\\n]+'), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND len(w) > 3 AND NOT list_contains([{", ".join(quoted(n) for n in T.NOT_NAMES)}], w))[1], '') END AS competitor FROM a""")
def q_parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).select("doc_id", T.parsed_answer(F.col("answer")).alias("a"))
    return t.select("doc_id", F.array_join("a.push_lines", "|").alias("push_lines"), "a.compliance", "a.hold_condition", "a.analysis", "a.verdict", "a.competitor")


def _class_sql() -> str:
    out = "CASE WHEN v = 'SWITCH' AND before = 'HOLD' THEN 'switch_hold_resolved'"
    for said, classes in T.PATTERNS.items():
        for name, groups in classes:
            out += f" WHEN v = '{said}' AND (" + " OR ".join("(" + " AND ".join(f"contains(a, {quoted(w)})" for w in g) + ")" for g in groups) + f") THEN '{name}'"
        out += f" WHEN v = '{said}' THEN '{T.OTHERWISE[said]}'"
    return out + " ELSE 'unknown' END"


@query(f"WITH t AS (SELECT {one_of_sql(VERDICTS, 'verdict')} AS v, {one_of_sql(['HOLD', 'STAY', 'none'], 'before')} AS before, lower({ANALYSIS}) AS a FROM documents) SELECT {_class_sql()} AS pattern, count(*) AS n FROM t GROUP BY 1")
def q_reasoning_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many traces reason in each way."""
    t = traces(spark, sf_dir).select(T.parsed_prompt(F.col("prompt")).alias("p"), T.parsed_answer(F.col("answer")).alias("a"))
    pattern = T.reasoning_pattern(F.col("a.verdict"), F.col("a.analysis"), F.col("p.previous_verdict") == "HOLD")
    return t.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


_FIGURE = lambda pattern: f"coalesce(TRY_CAST(regexp_replace(regexp_extract(line, '{pattern}', 1), '[,+]', '', 'g') AS BIGINT), 0)"


@query(f"""WITH t AS (SELECT doc_id, {one_of_sql(ROI_LINES, "roi")} AS line, {pick_sql("saving", 4000)} - 1000 AS saving, 1000 + {pick_sql("net", 999)} AS net, {pick_sql("met", 2)} = 0 AS met FROM documents)
SELECT doc_id, {_FIGURE("Migration £([0-9,]+)")} AS migration, {_FIGURE("Annual net £([+-]?[0-9,]+)")} AS annual, contains(line, 'MET') AND NOT contains(line, 'NOT MET') AS met, saving AS annual_saving, net, met AS threshold_met FROM t""")
def q_parsed_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the ROI lines of prompts and answers."""
    t = traces(spark, sf_dir).select("doc_id", T.answer_roi(T.after_label(F.col("answer"), "ROI:")).alias("a"), T.prompt_roi(F.col("prompt")).alias("p"))
    return t.select("doc_id", "a.migration", "a.annual", "a.met", "p.annual_saving", "p.net", "p.threshold_met")


def weak_sql(a: str) -> str:
    count = lambda words, x: f"len(list_filter([{', '.join(map(quoted, words))}], lambda w: contains({x}, w)))"
    return f"({count(W.CONNECTIVES, f'lower({a})')} < 2 OR length({a}) < 200 OR {count(W.BOUNDARIES, a)} < 2 OR {count(W.PLACEHOLDERS, f'lower({a})')} > 0)"


def cleaned_sql(a: str) -> str:
    """Placeholders replaced, white space and full stops collapsed."""
    for found, put in W.PLACEHOLDERS.items():
        a = f"regexp_replace({a}, '(?i){re.escape(found)}', {quoted(put)}, 'g')"
    return f"trim(regexp_replace(regexp_replace({a}, '\\s{{2,}}', ' ', 'g'), '\\.\\.+', '.', 'g'))"


@query(f"WITH t AS (SELECT doc_id, {ANALYSIS} AS a FROM documents) SELECT doc_id, {weak_sql('a')} AS weak FROM t")
def q_weak_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses that reason too little."""
    return traces(spark, sf_dir).select("doc_id", X.is_weak(T.after_label(F.col("answer"), "ANALYSIS:")).alias("weak"))


def distilled(traces: DataFrame, rewrite: dict[str, Column] | None = None, least_length: int = 200) -> DataFrame:
    """Traces (prompt, answer) whose weak analyses are rewritten by the writer of their pattern; the others stay.

    ``rewrite`` maps a pattern to a text column over p and a, the parsed prompt and answer; patterns without a writer keep
    their text, cleaned of placeholders. Only the first place of the old analysis is replaced.
    """
    t = traces.withColumn("p", T.parsed_prompt(F.col("prompt"))).withColumn("a", T.parsed_answer(F.col("answer")))
    t = t.withColumn("pattern", T.reasoning_pattern(F.col("a.verdict"), F.col("a.analysis"), F.upper("p.previous_verdict") == "HOLD"))
    new = X.without_placeholders(F.col("a.analysis"))
    for name, text in (rewrite or {}).items():
        new = F.when(F.col("pattern") == name, text).otherwise(new)
    weak = X.is_weak(F.col("a.analysis"), 2, least_length)
    at = F.instr("answer", F.col("a.analysis"))
    replaced = F.overlay(F.col("answer"), new, at, F.length("a.analysis"))
    return t.withColumn("weak", weak).withColumn("answer", F.when(weak & (at > 0) & (F.length("a.analysis") > 0), replaced).otherwise(F.col("answer"))).drop("p", "a")


@query(f"""WITH t AS (SELECT doc_id, {one_of_sql(VERDICTS, "verdict")} AS v, {one_of_sql(["HOLD", "STAY", "none"], "before")} AS before, {ANALYSIS} AS x FROM documents), c AS (SELECT *, {_class_sql().replace("contains(a, ", "contains(lower(x), ")} AS pattern FROM t)
SELECT doc_id, pattern, CASE WHEN NOT {weak_sql("x")} THEN x WHEN pattern = 'hold_pilot' THEN 'Wait for the pilot.' ELSE {cleaned_sql("x")} END AS analysis FROM c""")
def q_distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak analyses rewritten by their pattern."""
    t = distilled(traces(spark, sf_dir), {"hold_pilot": F.lit("Wait for the pilot.")})
    return t.select("doc_id", "pattern", T.after_label(F.col("answer"), "ANALYSIS:").alias("analysis"))


RATED = [
    "1. **Sync fails daily for accounts**: HIGH impact", "2. **Reports need manual work**: MEDIUM", "3. **Audit trail export —**: HIGH", "4. **Mobile app is slow at times**: LOW",
    "Overall push: STRONG", "Overall push: WEAK", "no rating here, HIGH or not", "",
]


def rated_text(text: str = "text") -> Column:
    """A text, and three rated lines after it."""
    return F.concat_ws("\n", F.coalesce(F.col(text), F.lit("")), *(one_of(RATED, f"r{k}") for k in range(3)))


_RATED_TEXT = f"coalesce(text, '') || chr(10) || array_to_string([{', '.join(one_of_sql(RATED, f'r{k}') for k in range(3))}], chr(10))"
_STRENGTH = "CASE WHEN upper(regexp_extract(t, '(?i)Overall\\s+push\\s*[:\\-–]\\s*(STRONG|MODERATE|WEAK)', 1)) <> '' THEN upper(regexp_extract(t, '(?i)Overall\\s+push\\s*[:\\-–]\\s*(STRONG|MODERATE|WEAK)', 1)) WHEN len(regexp_extract_all(t, '(?i)\\bHIGH\\b')) >= 3 THEN 'STRONG' WHEN len(regexp_extract_all(t, '(?i)\\bHIGH\\b')) >= 1 THEN 'MODERATE' ELSE 'WEAK' END"


@query(f"""WITH r AS (SELECT doc_id, {_RATED_TEXT} AS t FROM documents) SELECT doc_id, {_STRENGTH} AS strength,
array_to_string(list_transform(regexp_extract_all(t, '(?i)[0-9]+\\.\\s+\\*\\*"?([^*\\n"]{{10,120}})"?\\*\\*[:\\s]+HIGH', 1), lambda x: trim(regexp_replace(x, '[ —–-]+$', '')))[1:3], '|') AS high,
len(regexp_extract_all(t, '(?i)[0-9]+\\.\\s+\\*\\*"?([^*\\n"]{{5,120}})"?\\*\\*[:\\s]+(HIGH|MEDIUM|LOW)', 1)) AS n_bullets FROM r""")
def q_rated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength, signals rated HIGH and number of bullets of rated lists."""
    t = table(spark, sf_dir, "documents").select("doc_id", rated_text().alias("t"))
    bullets = T.rated_bullets(F.col("t"))
    n = F.when(bullets == "  (none)", 0).otherwise(F.size(F.split(bullets, "\n"))).cast("long")
    return t.select("doc_id", T.strength(F.col("t"), "push").alias("strength"), F.array_join(T.high_signals(F.col("t")), "|").alias("high"), n.alias("n_bullets"))


_TABLE = lambda values, x: "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE 'MODERATE' END"
_NAMED = {s: v for s, v in W.EXPECTED_VERDICT.items() if v and s in W.PUSH_STRENGTH}
_REBUILT = "CASE " + " ".join(f"WHEN scenario = '{s}' THEN '{v}'" for s, v in _NAMED.items()) + """ WHEN {blocked} THEN 'STAY' WHEN net >= 1200 AND push <> 'WEAK' AND pull <> 'WEAK' THEN 'SWITCH'
WHEN net < 1200 AND push = 'STRONG' AND pull = 'STRONG' THEN 'SWITCH' WHEN push = 'WEAK' OR pull = 'WEAK' THEN 'STAY' ELSE 'HOLD' END"""


@query(f"""WITH {SIGNALS}, s AS (SELECT doc_id, scenario, net, {_TABLE(W.PUSH_STRENGTH, "scenario")} AS push, {_TABLE(W.PULL_STRENGTH, "scenario")} AS pull FROM sig),
r AS (SELECT doc_id, {_RATED_TEXT} AS t FROM documents), p AS (SELECT s.doc_id, scenario, net, {_STRENGTH} AS push, pull FROM s JOIN r USING (doc_id))
SELECT s.doc_id, s.scenario, {_REBUILT.format(blocked="false").replace("scenario =", "s.scenario =").replace("net ", "s.net ").replace("push ", "s.push ").replace("pull ", "s.pull ")} AS by_scenario,
{_REBUILT.format(blocked="p.doc_id % 3 = 0").replace("scenario =", "p.scenario =").replace("net ", "p.net ").replace("push ", "p.push ").replace("pull ", "p.pull ")} AS by_text FROM s JOIN p USING (doc_id)""")
def q_rebuilt_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by the strengths of the scenario, and by those that texts tell with compliance as a gate."""
    met = F.col("net") >= W.ROI_THRESHOLD
    texts = table(spark, sf_dir, "documents").select("doc_id", rated_text().alias("t"))
    s = signals(spark, sf_dir).select("doc_id", "scenario", "net").join(texts, "doc_id")
    push, pull = (T.scenario_strength(F.col("scenario"), side) for side in ("push", "pull"))
    told = T.rebuilt_verdict(F.col("scenario"), T.strength(F.col("t"), "push"), pull, met, F.col("doc_id") % 3 == 0)
    return s.select("doc_id", "scenario", T.rebuilt_verdict(F.col("scenario"), push, pull, met).alias("by_scenario"), told.alias("by_text"))


@query(f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x ' || {SQUEEZED} || chr(10) || 'VERDICT: ' || {one_of_sql(VERDICTS, "verdict")} || ' because' || chr(10) || 'Verdict: STAY ' ELSE 'no line ' || {SQUEEZED} || '  ' END AS a, {one_of_sql(VERDICTS, "new")} AS v FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN rtrim(a) || chr(10) || 'VERDICT: ' || v WHEN regexp_replace(a, 'VERDICT:\\s*(SWITCH|STAY|HOLD)[^\\n]*', 'VERDICT: ' || v) <> a THEN regexp_replace(a, 'VERDICT:\\s*(SWITCH|STAY|HOLD)[^\\n]*', 'VERDICT: ' || v) ELSE rtrim(a) || chr(10) || 'VERDICT: ' || v END AS first,
CASE WHEN doc_id % 2 <> 0 THEN trim(a) || chr(10) || 'VERDICT: ' || v ELSE regexp_replace(trim(a), '(?i)VERDICT:\\s*(SWITCH|STAY|HOLD)', 'VERDICT: ' || v, 'g') END AS every FROM t""")
def q_enforced_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose verdict is replaced, at its first place or everywhere, or appended."""
    text = X.squeezed(F.col("text"))
    said = F.concat(F.lit("x "), text, F.lit("\nVERDICT: "), one_of(VERDICTS, "verdict"), F.lit(" because\nVerdict: STAY "))
    unsaid = F.concat(F.lit("no line "), text, F.lit("  "))
    t = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, said).otherwise(unsaid).alias("a"), one_of(VERDICTS, "new").alias("v"))
    return t.select("doc_id", T.with_verdict(F.col("a"), F.col("v")).alias("first"), T.with_verdict(F.col("a"), F.col("v"), every=True).alias("every"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of each document: analysis and verdict."""
    answer = F.concat(F.lit("ANALYSIS: "), analysis(), F.lit("\nVERDICT: "), one_of(VERDICTS, "verdict"))
    return table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))


def flipped_pairs(traces: DataFrame, n: int, seed: int, order: str) -> DataFrame:
    """Preference pairs of n // 3 traces of each verdict: the answer, and the same with a wrong verdict in its first verdict line.

    Of answers with the same text the first in ``order`` counts.
    """
    once = first_of_each(traces, "answer", order)
    has = lambda v: F.contains("answer", F.lit(f"VERDICT: {v}"))
    right = F.when(has("SWITCH"), "SWITCH").when(has("STAY"), "STAY").when(has("HOLD"), "HOLD")
    named = once.withColumn("correct_verdict", right).filter("correct_verdict is not null")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("correct_verdict").orderBy(shuffled(seed, order), order))
    taken = named.withColumn("_place", place).filter(F.col("_place") <= n // 3).drop("_place")
    wrong = F.when(F.col("correct_verdict") == "SWITCH", "STAY").otherwise("SWITCH")
    taken = taken.withColumn("wrong_verdict", wrong)
    old, new = F.concat(F.lit("VERDICT: "), "correct_verdict"), F.concat(F.lit("VERDICT: "), "wrong_verdict")
    return taken.withColumn("rejected", F.overlay("answer", new, F.instr("answer", old), F.length(old))).withColumnRenamed("answer", "chosen")


@query(f"""WITH t AS (SELECT doc_id, 'ANALYSIS: ' || {ANALYSIS} || chr(10) || 'VERDICT: ' || {one_of_sql(VERDICTS, "verdict")} AS answer, {one_of_sql(VERDICTS, "verdict")} AS v FROM documents),
u AS (SELECT min(doc_id) AS doc_id, answer, v FROM t GROUP BY answer, v), p AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY md5('42|' || doc_id), doc_id) AS place FROM u)
SELECT doc_id, v AS correct_verdict, CASE v WHEN 'SWITCH' THEN 'STAY' ELSE 'SWITCH' END AS wrong_verdict, answer AS chosen, replace(answer, 'VERDICT: ' || v, 'VERDICT: ' || CASE v WHEN 'SWITCH' THEN 'STAY' ELSE 'SWITCH' END) AS rejected FROM p WHERE place <= 10""")
def q_flipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flipped_pairs(answers(spark, sf_dir), 30, 42, "doc_id").select("doc_id", "correct_verdict", "wrong_verdict", "chosen", "rejected")


def rebuilt_inputs(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Verdict examples of files (key, step, content) that have all four steps: the last content of each, its strengths, figures and bullets."""
    files = pivot_steps(steps, key, "step", "content", ["compliance", "push", "pull", "verdict"], order)
    return files.select(
        key,
        T.header(F.col("verdict")).alias("header"),
        T.prompt_roi(F.col("verdict")).alias("roi"),
        T.strength(F.col("push"), "push").alias("push_strength"),
        T.strength(F.col("pull"), "pull").alias("pull_strength"),
        T.rated_bullets(F.col("push")).alias("push_bullets"),
        T.rated_bullets(F.col("pull")).alias("pull_bullets"),
        T.compliance_said(F.col("compliance")).alias("compliance"),
        T.compliance_reason(F.col("compliance")).alias("compliance_reason"),
    )


_ENTRIES = """regexp_extract_all({t}, '(?i)[0-9]+\\.\\s+\\*\\*"?([^*\\n"]{{5,120}})"?\\*\\*[:\\s]+(HIGH|MEDIUM|LOW)', {group})[1:5]"""
_LISTED = f"array_to_string(list_transform(list_zip({_ENTRIES.format(t='t', group=1)}, {_ENTRIES.format(t='t', group=2)}), lambda x: '  - ' || trim(x[1]) || ' [' || upper(x[2]) || ']'), chr(10))"


@query(f"""WITH s AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS text, arg_max(text, turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
r AS (SELECT doc_id, {_RATED_TEXT} AS t FROM (SELECT conv_id AS doc_id, text FROM s WHERE text IS NOT NULL AND a IS NOT NULL))
SELECT doc_id AS conv_id, CASE WHEN contains(upper(t), 'FAIL') THEN 'FAIL' WHEN contains(upper(t), 'PASS') OR contains(upper(t), 'COMPLIANT') THEN 'PASS' ELSE string_split(t, chr(10))[1] END AS compliance, {_STRENGTH} AS push_strength,
coalesce(nullif({_LISTED}, ''), '  (none)') AS push_bullets FROM r""")
def q_rebuilt_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with both sides as files of steps; rated lines picked by the conversation's id are put after each text."""
    c = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant') and text is not null").withColumnRenamed("conv_id", "doc_id")
    names = F.when(F.col("role") == "user", F.array(F.lit("compliance"), F.lit("push"))).otherwise(F.array(F.lit("pull"), F.lit("verdict")))
    steps = c.select(F.col("doc_id").alias("conv_id"), "turn", F.explode(names).alias("step"), rated_text().alias("content"))
    return rebuilt_inputs(steps, "conv_id", "turn").select("conv_id", "compliance", "push_strength", "push_bullets")


@query(f"SELECT {one_of_sql(VERDICTS, 'verdict')} AS verdict, count(*) AS n FROM documents GROUP BY 1")
def q_trace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many traces end in each verdict."""
    return traces(spark, sf_dir).groupBy(X.verdict(F.col("answer")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
