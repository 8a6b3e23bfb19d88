"""Signals of competitors: names, validation, compliance, semantic view, consistency and curated traces.

The tables hold no signals, so the registered queries make one of each document. All lines of its text are the notes, the
competitor's changes or the tool's lines of its signal, which a hash of the id tells; sentences that a hash picks from a
list are put after them, and the other fields are picked likewise, so that fields vary independently and rules meet all
their combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.functions import curation as C
from sagebrush.functions import signals as S
from sagebrush.functions import text as X
from sagebrush.functions import words as W
from sagebrush.operators.matching import semantic_view
from sagebrush.operators.order import written
from sagebrush.operators.sampling import balanced, grouped_split

from .curation import sql_hits, sql_list, token_sql, topic_sql
from .registry import query, table

NOTES = [
    "", "Contract renewal is due in June", "consider a pilot next year", "no beta or roadmap caveats apply", "Export is in preview only",
    "sync is live and the connector is live", "renewal calls flagged export as a blocker", "overkill for a team of this size",
    "vendor acquisition announced", "hold: reassess in 60 days", "no SOC2 report yet", "the feature is unrelated to our needs", "pilot in progress in Q3",
    "plain remark without a rule", "note 3",
]
CHANGES = [
    "", "Added native API sync with webhooks", "SSO and SAML now available", "Improved and refreshed experience", "Bank feed for Barclays in beta",
    "Audit trail export added", "Capacity planning on the roadmap", "Multi-currency invoicing launched", "Dashboard reporting requires manual export",
    "change 2", "Mobile app for iOS shipped", "Gantt dependency auto-updates introduced",
]
TOOLS = [
    "", "no change", "API sync crashes under load", "Shelfware: 12 of 40 seats idle", "inactive seats: 14 of 40", "no shelfware", "Stable and reliable this quarter",
    "Mobile app improved", "Reports still slow and manual", "per-user pricing increased by 8%", "Audit log missing for admins", "dashboard available and faster",
]
ISSUES = [
    "API sync fails for large accounts", "No audit trail export", "Manual dashboard reporting", "Mobile app lacks offline mode", "Invoices in one currency only",
    "Bank feed only overnight", "Gantt dependency changes are manual", "Shelfware and unused capacity",
]
TOLD = ["unchanged", "", "SOC2 Type II achieved", "no SOC2 report", "SSO not available, lacks SAML", "UK data residency now available", "no audit log", "audit trail export certified", "none", "GDPR review pending"]
DATES = ["2026-01-15", "2026-02-30", "2026/03/01", "YYYY-MM-DD"]
SLUGS = ["acme", "beta_desk", "both_signals", "push", "crm_hr"]
LISTS = {"n": NOTES, "c": CHANGES, "t": TOOLS, "i": ISSUES}


def pick(slot: str, n: int) -> Column:
    """A number below n that depends on the document's id and the slot."""
    return F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"|{slot}"))), 1, 4), 16, 10).cast("int") % n


def one_of(values: list[str], slot: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), pick(slot, len(values)) + 1)


def pick_sql(slot: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(doc_id || '|{slot}'), 1, 4) AS INTEGER) % {n})"


def one_of_sql(values: list[str], slot: str) -> str:
    return f"{sql_list(values)}[{pick_sql(slot, len(values))} + 1]"


FLAGS = ["soc2_type2", "sso_saml", "uk_residency", "gdpr_eu_residency", "audit_log"]
#: The lists that a document's lines may belong to.
TEXT_LISTS = ["n", "c", "t"]


def text_lines() -> Column:
    """The lines of a document's text, squeezed; blank ones are left out, and a null text has none."""
    return F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), X.squeezed), lambda x: x != "")


TEXT_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), lambda x: x <> '')"


SQUEEZED = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


def some(slot: str, n: int) -> Column:
    """The lines of a list of the signal: those of the text, if they belong to it, then n picks."""
    picked = F.filter(F.array(*(one_of(LISTS[slot], f"{slot}{k}") for k in range(n))), lambda x: x != "")
    if slot not in TEXT_LISTS:
        return picked
    here = pick("lines", len(TEXT_LISTS)) == TEXT_LISTS.index(slot)
    return F.concat(F.when(here, text_lines()).otherwise(F.array().cast("array<string>")), picked)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal of each document; doc_ids are unique."""
    profile = F.struct(*((pick(f, 6) != 0).alias(f) for f in FLAGS), F.when(pick("export", 4) != 0, pick("export", 4) != 1).alias("audit_log_exportable"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        one_of(W.SCENARIOS, "scenario").alias("scenario"),
        one_of(W.SCENARIOS, "told").alias("scenario_type"),
        one_of(W.CATEGORIES, "category").alias("category"),
        one_of(SLUGS, "slug").alias("slug"),
        pick("seats", 30).alias("seats"),
        some("n", 2).alias("notes"),
        some("c", 3).alias("changes"),
        some("t", 2).alias("tool"),
        some("i", 2).alias("issues"),
        one_of(TOLD, "compliance").alias("compliance"),
        one_of(DATES, "date").alias("date"),
        F.when(pick("previous", 3) == 0, "HOLD").alias("previous"),
        (pick("net", 4000) - 1500).alias("net"),
        profile.alias("profile"),
    )


def some_sql(slot: str, n: int) -> str:
    picked = f"list_filter([{', '.join(one_of_sql(LISTS[slot], f'{slot}{k}') for k in range(n))}], lambda x: x <> '')"
    if slot not in TEXT_LISTS:
        return picked
    return f"CASE WHEN {pick_sql('lines', len(TEXT_LISTS))} = {TEXT_LISTS.index(slot)} THEN {TEXT_LINES} || {picked} ELSE {picked} END"


SIGNALS = f"""sig AS (
    SELECT doc_id, {one_of_sql(W.SCENARIOS, "scenario")} AS scenario, {one_of_sql(W.SCENARIOS, "told")} AS scenario_type,
           {one_of_sql(W.CATEGORIES, "category")} AS category, {one_of_sql(SLUGS, "slug")} AS slug, {pick_sql("seats", 30)} AS seats,
           {some_sql("n", 2)} AS notes, {some_sql("c", 3)} AS changes, {some_sql("t", 2)} AS tool, {some_sql("i", 2)} AS issues,
           {one_of_sql(TOLD, "compliance")} AS compliance, {one_of_sql(DATES, "date")} AS date,
           CASE WHEN {pick_sql("previous", 3)} = 0 THEN 'HOLD' END AS previous, {pick_sql("net", 4000)} - 1500 AS net,
           {", ".join(f"{pick_sql(f, 6)} <> 0 AS {f}" for f in FLAGS)},
           CASE WHEN {pick_sql("export", 4)} <> 0 THEN {pick_sql("export", 4)} <> 1 END AS audit_log_exportable
    FROM documents)"""


def first_sql(lines: str, test: str) -> str:
    """The first line x of a list for which the test holds."""
    return f"list_filter({lines}, lambda x: {test})[1]"


def has_sql(text: str, words: list[str]) -> str:
    return f"({sql_hits(f'lower({text})', words)} > 0)"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_ADVISORY = " OR ".join(f"starts_with(lower(x), {quoted(a)})" for a in W.ADVISORY)
_PLAIN = f"NOT ({_ADVISORY}) AND NOT regexp_matches(x, {quoted(W.NEGATION)})"
_MANY = f"coalesce(list_max(list_transform(regexp_extract_all(x, '(?i)inactive\\s+seats?[^\\d]*(\\d+)', 1), lambda y: CAST(y AS INTEGER))) >= 10, false) OR coalesce(list_max(list_transform(regexp_extract_all(x, '(\\d+)%', 1), lambda y: CAST(y AS INTEGER))) >= 30, false)"
SHELFWARE = f"""CASE WHEN len(list_filter(tool, lambda x: regexp_matches(x, {quoted(W.SHELFWARE_DENIED)}))) > 0 THEN 'NONE' ELSE coalesce({first_sql("tool", f"{has_sql('x', W.SHELFWARE)} AND NOT regexp_matches(x, {quoted(W.SHELFWARE_NEGATION)}) AND ({has_sql('x', W.SHELFWARE_WORDS)} OR {_MANY})")}, 'NONE') END"""
RULES = f"""{SIGNALS},
held AS (SELECT *, coalesce({first_sql("notes", f"{_PLAIN} AND {has_sql('x', W.HOLD_NOTE)}")}, {first_sql("changes", f"NOT regexp_matches(x, {quoted(W.NEGATION)}) AND {has_sql('x', W.HOLD_CHANGE)}")}, 'NONE') AS hold,
    {SHELFWARE} AS unused, coalesce({first_sql("notes", has_sql("x", W.MIGRATION_ENABLER))}, 'NONE') AS enabler,
    coalesce({first_sql("notes", f"{has_sql('x', W.DEMAND)} AND contains(lower(x), 'blocker')")}, 'NONE') AS demand FROM sig),
ruled AS (SELECT *, CASE WHEN hold <> 'NONE' THEN 'NONE' ELSE coalesce({first_sql("notes", f"{_PLAIN} AND {has_sql('x', W.DISQUALIFIER)}")}, 'NONE') END AS disq FROM held)"""


def with_rules(df: DataFrame) -> DataFrame:
    """Columns hold, disqualifier, shelfware, enabler and demand added."""
    c = F.col
    df = df.withColumn("hold", X.hold_signal(c("notes"), c("changes"))).withColumn("shelfware", X.shelfware(c("tool")))
    df = df.withColumn("enabler", X.migration_enabler(c("notes"))).withColumn("demand", X.demand_signal(c("notes")))
    return df.withColumn("disqualifier", X.disqualifier(c("notes"), c("hold")))


@query(f"WITH {RULES} SELECT doc_id, hold, disq AS disqualifier, unused AS shelfware, enabler, demand FROM ruled")
def q_signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that hold, rule out, waste, enable and demand."""
    return with_rules(signals(spark, sf_dir)).select("doc_id", "hold", "disqualifier", "shelfware", "enabler", "demand")


STEM = "category || '_' || slug || '_' || scenario"


@query(f"""WITH {SIGNALS}, n AS (SELECT doc_id, {STEM} AS stem FROM sig UNION ALL SELECT doc_id, slug || '_' || scenario FROM sig)
SELECT doc_id, stem, nullif(regexp_extract(stem, {quoted(S.GENERATED)}, 1), '') AS category, nullif(regexp_extract(stem, {quoted(S.GENERATED)}, 2), '') AS competitor, nullif(regexp_extract(stem, {quoted(S.GENERATED)}, 3), '') AS scenario FROM n""")
def q_generated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in file names; names of another shape give none."""
    s = signals(spark, sf_dir)
    names = s.select("doc_id", F.concat_ws("_", "category", "slug", "scenario").alias("stem")).union(s.select("doc_id", F.concat_ws("_", "slug", "scenario")))
    return names.withColumn("k", S.generated_name(F.col("stem"))).select("doc_id", "stem", "k.category", "k.competitor", "k.scenario")


def payload_text() -> Column:
    """A signal as the JSON of its file; some lack a field or have one of another type."""
    loose = F.when(pick("loose", 7) == 0, F.to_json(F.struct(F.col("compliance").alias("compliance_changes"))))
    whole = F.to_json(
        F.struct(
            F.col("scenario_type"),
            F.col("category"),
            F.when(pick("named", 9) != 0, "Competitor").otherwise(" ").alias("competitor"),
            F.lit("Tool").alias("current_tool"),
            "date",
            F.col("changes").alias("competitor_changes"),
            F.col("tool").alias("current_tool_status"),
            F.lit("unchanged").alias("pricing_delta"),
            F.col("compliance").alias("compliance_changes"),
            "notes",
        )
    )
    return F.when(pick("broken", 11) == 0, F.concat(whole, F.lit("}"))).otherwise(F.coalesce(loose, whole))


_LOW = "lower(trim(compliance))"
_NOTED = "lower(array_to_string(notes, ' '))"
_STILL = f"len(list_filter(tool, lambda x: NOT list_contains({sql_list(W.NO_DEGRADATION)}, lower(trim(x))))) = 0"
SIGNAL_ERRORS = f"""CASE WHEN {pick_sql("broken", 11)} = 0 THEN ['Invalid JSON']
    WHEN {pick_sql("loose", 7)} = 0 THEN {sql_list([f"Missing field: {n}" for n in W.SIGNAL_FIELDS if n != "compliance_changes"])}
    ELSE list_filter([
        CASE WHEN scenario_type <> scenario THEN 'scenario_type mismatch: file says ''' || scenario_type || ''', filename says ''' || scenario || '''' END,
        CASE WHEN {pick_sql("named", 9)} = 0 THEN 'competitor name is empty' END,
        CASE WHEN NOT regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date is not YYYY-MM-DD: ''' || date || '''' END], lambda x: x IS NOT NULL)
    || list_transform(list_filter([date, 'unchanged', compliance] || changes || tool || notes, lambda x: regexp_matches(trim(x), {quoted(W.PLACEHOLDER)})), lambda x: 'Placeholder value detected: ''' || x || '''')
    || list_filter([
        CASE WHEN scenario = 'pull_dominant' AND len(changes) = 0 THEN 'pull_dominant: competitor_changes is empty' END,
        CASE WHEN scenario IN ('push_dominant', 'shelfware_case') AND len(tool) = 0 THEN scenario || ': current_tool_status is empty' END,
        CASE WHEN scenario IN ('push_dominant', 'shelfware_case') AND len(tool) > 0 AND {_STILL} THEN scenario || ': current_tool_status shows no degradation' END,
        CASE WHEN scenario = 'fluff_update' AND len(changes) = 0 THEN 'fluff_update: competitor_changes is empty' END,
        CASE WHEN scenario IN ('hard_compliance_failure', 'compliance_newly_met') AND {_LOW} IN ('unchanged', 'no change', '') THEN scenario || ': compliance_changes must describe a compliance event' END,
        CASE WHEN list_contains({sql_list(W.NOTED_SCENARIOS)}, scenario) AND len(notes) = 0 THEN scenario || ': notes is empty' END,
        CASE WHEN scenario = 'hard_compliance_failure' AND NOT {has_sql("compliance", W.BLOCK_WORDS)} AND NOT {has_sql(_NOTED, W.BLOCK_WORDS)} THEN 'hard_compliance_failure: no compliance block keywords found' END,
        CASE WHEN scenario = 'compliance_newly_met' AND NOT {has_sql("compliance", W.MET_WORDS)} THEN 'compliance_newly_met: compliance_changes should describe acquisition of cert' END,
        CASE WHEN list_contains({sql_list(W.EXPLAINED_HOLDS)}, scenario) AND NOT {has_sql(_NOTED, W.HOLD_WORDS)} THEN scenario || ': notes should explain the hold condition' END], lambda x: x IS NOT NULL) END"""


@query(f"WITH {SIGNALS} SELECT doc_id, array_to_string({SIGNAL_ERRORS}, ' / ') AS errors FROM sig")
def q_signal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each signal file, in order."""
    s = signals(spark, sf_dir).select("doc_id", F.concat_ws("_", "category", "slug", "scenario").alias("stem"), payload_text().alias("text"))
    # A slug that ends like a scenario would change the name's reading; these slugs don't.
    return s.select("doc_id", F.array_join(S.signal_errors(F.col("stem"), F.col("text")), " / ").alias("errors"))


@query(f"WITH {SIGNALS}, e AS (SELECT scenario, unnest({SIGNAL_ERRORS}) AS error FROM sig) SELECT scenario, regexp_extract(error, '^[^:'']*', 0) AS kind, count(*) AS n FROM e GROUP BY ALL")
def q_signal_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of error stands in the signals of each scenario."""
    s = signals(spark, sf_dir).select("scenario", F.concat_ws("_", "category", "slug", "scenario").alias("stem"), payload_text().alias("text"))
    e = s.select("scenario", F.explode(S.signal_errors(F.col("stem"), F.col("text"))).alias("error"))
    return e.groupBy("scenario", F.regexp_extract("error", "^[^:']*", 0).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_GAIN = has_sql("compliance", W.CURATED_GAINS)
_SAYS = lambda *w: has_sql("compliance", list(w))
_TELLS = f"NOT list_contains({sql_list(W.UNTOLD_COMPLIANCE)}, lower(trim(compliance)))"
CURATED = f"""curated AS (SELECT doc_id,
    CASE WHEN NOT tells OR NOT {_SAYS("soc2", "soc 2")} THEN soc2_type2 WHEN {_SAYS("not soc2", "no soc2")} THEN false WHEN {_GAIN} THEN true ELSE soc2_type2 END AS soc2,
    CASE WHEN NOT tells OR NOT {_SAYS("sso", "saml", "oidc")} THEN sso_saml WHEN {_SAYS("no sso", "lacks sso", "no saml", "lacks saml")} THEN false WHEN {_GAIN} THEN true ELSE sso_saml END AS sso,
    CASE WHEN NOT tells OR NOT ({_SAYS("uk")} AND {_SAYS("residency")}) THEN uk_residency ELSE {_GAIN} END AS uk,
    CASE WHEN tells AND {_SAYS("uk")} AND {_SAYS("residency")} AND {_GAIN} THEN true ELSE gdpr_eu_residency END AS eu,
    CASE WHEN NOT tells OR NOT {_SAYS("audit")} THEN audit_log WHEN {_SAYS("no audit log", "lacks audit log", "no audit trail", "no exportable audit")} THEN false WHEN {_GAIN} THEN true ELSE audit_log END AS audit,
    CASE WHEN NOT tells OR NOT {_SAYS("audit")} THEN audit_log_exportable WHEN {_SAYS("no audit log", "lacks audit log", "no audit trail", "no exportable audit")} THEN false WHEN {_GAIN} THEN true ELSE audit_log_exportable END AS export
    FROM (SELECT *, {_TELLS} AS tells FROM sig)),
failed AS (SELECT sig.doc_id, list_filter([CASE WHEN NOT soc2 THEN 'No SOC2 Type II' END, CASE WHEN seats > 10 AND NOT sso THEN 'No SSO/SAML' END, CASE WHEN NOT uk AND NOT eu THEN 'No UK or EU data residency' END,
    CASE WHEN category IN ('finance', 'hr', 'crm') AND NOT (audit AND coalesce(export, true)) THEN 'No exportable audit log' END], lambda x: x IS NOT NULL) AS failures FROM sig JOIN curated USING (doc_id))"""


def curated_failures() -> Column:
    return C.curated_failures(F.col("profile"), F.col("compliance"), F.col("category"), F.col("seats"))


@query(f"WITH {SIGNALS}, {CURATED} SELECT doc_id, len(failures) = 0 AS passed, array_to_string(failures, '; ') AS failures FROM failed")
def q_curated_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on the profile that curation reads from the changes."""
    s = signals(spark, sf_dir).withColumn("f", curated_failures())
    return s.select("doc_id", (F.size("f") == 0).alias("passed"), F.array_join("f", "; ").alias("failures"))


_KINDS = f"list_distinct(list_transform(changes[1:3], lambda x: CASE WHEN {sql_hits('lower(x)', W.CONCRETE)} > {sql_hits('lower(x)', W.VAGUE)} THEN 'concrete' ELSE 'vague' END))"
_CHANGED = f"list_filter(tool, lambda x: NOT list_contains({sql_list(W.NO_CHANGE)}, lower(trim(x))))"
_PUSHED = "array_to_string(tool || issues, ' ')"
PROFILES = f"""profiles AS (SELECT *,
    CASE WHEN unused <> 'NONE' THEN 'shelfware' WHEN {has_sql(_PUSHED, W.COMPLIANCE_PUSH)} THEN 'compliance_gap' WHEN {has_sql(_PUSHED, W.INTEGRATION_PUSH)} THEN 'integration_gap'
         WHEN {has_sql(_PUSHED, W.COST_PUSH)} THEN 'cost_pressure' WHEN {has_sql(_PUSHED, W.OPERATIONAL_PUSH)} THEN 'operational_friction' ELSE 'general_gap' END AS push_profile,
    CASE WHEN disq <> 'NONE' THEN 'disqualified' WHEN hold <> 'NONE' THEN 'blocked_pending' WHEN {has_sql("array_to_string(notes, ' ')", W.IRRELEVANT)} THEN 'irrelevant'
         WHEN len(changes) = 0 THEN 'none' WHEN len({_KINDS}) = 2 THEN 'mixed' ELSE {_KINDS}[1] END AS pull_profile,
    CASE WHEN disq <> 'NONE' THEN 'disqualifier' WHEN hold <> 'NONE' THEN 'hold_active' WHEN coalesce(previous = 'HOLD', false) AND scenario = 'hold_resolved' THEN 'hold_resolved'
         WHEN unused <> 'NONE' THEN 'shelfware_override' WHEN {_TELLS} AND {_GAIN} AND {has_sql("compliance", W.HARD_COMPLIANCE)} THEN 'compliance_unblocked' ELSE 'open' END AS gate_state,
    CASE WHEN net >= 1200 THEN 'met' WHEN net >= 0 THEN 'positive_below_threshold' ELSE 'negative' END AS roi_bucket,
    CASE WHEN len({_CHANGED}) = 0 THEN 'stable' WHEN unused <> 'NONE' THEN 'shelfware'
         WHEN {has_sql(f"array_to_string({_CHANGED}, ' ')", W.TREND_UP)} AND {has_sql(f"array_to_string({_CHANGED}, ' ')", W.TREND_DOWN)} THEN 'mixed'
         WHEN {has_sql(f"array_to_string({_CHANGED}, ' ')", W.TREND_UP)} THEN 'rally' WHEN {has_sql(f"array_to_string({_CHANGED}, ' ')", W.TREND_DOWN)} THEN 'degrading' ELSE 'stable' END AS tool_trend
    FROM ruled)"""


def with_profiles(df: DataFrame) -> DataFrame:
    """push_profile, pull_profile, gate_state, roi_bucket, tool_trend and the cell that they make with the scenario."""
    c = F.col
    df = df.withColumns(
        {
            "push_profile": C.push_profile(c("tool"), c("issues")),
            "pull_profile": C.pull_profile(c("changes"), c("notes"), c("hold"), c("disqualifier")),
            "gate_state": C.gate_state(c("scenario"), c("previous"), c("compliance"), c("hold"), c("disqualifier"), c("shelfware")),
            "roi_bucket": F.when(c("net") >= W.ROI_THRESHOLD, "met").when(c("net") >= 0, "positive_below_threshold").otherwise("negative"),
            "tool_trend": C.tool_trend(c("tool")),
        }
    )
    return df.withColumn("semantic_cell", F.concat_ws("|", "scenario", "push_profile", "pull_profile", "gate_state", "roi_bucket", "tool_trend"))


@query(f"WITH {RULES}, {PROFILES} SELECT doc_id, concat_ws('|', scenario, push_profile, pull_profile, gate_state, roi_bucket, tool_trend) AS semantic_cell FROM profiles")
def q_semantic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each signal: scenario, push, pull, gate, return and trend."""
    return with_profiles(with_rules(signals(spark, sf_dir))).select("doc_id", "semantic_cell")


_CLEAN = "trim(regexp_replace(x, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
VIEW = f"""texts AS (SELECT doc_id, 'issue' AS source, unnest(issues) AS text, generate_subscripts(issues, 1) AS pos FROM sig
    UNION ALL SELECT doc_id, 'competitor', unnest(changes), generate_subscripts(changes, 1) FROM sig UNION ALL SELECT doc_id, 'tool', unnest(tool), generate_subscripts(tool, 1) FROM sig),
low AS (SELECT *, lower(text) AS t, ' ' || lower(text) || ' ' AS p FROM texts),
weighed AS (SELECT *, {topic_sql("t")} AS topics, {token_sql("t")} AS tokens, {sql_hits("p", W.PENDING)} > 0 AS pending, {sql_hits("p", W.POSITIVE_OVERRIDES)} > 0 AS over,
    {sql_hits("p", W.POSITIVE)} AS g, {sql_hits("p", W.NEGATIVE)} AS b, starts_with(p, ' no ') AS no FROM low),
counted AS (SELECT *, g + CASE WHEN over THEN 3 ELSE 0 END AS good, b + CASE WHEN no AND NOT over THEN 2 ELSE 0 END AS bad FROM weighed),
entries AS (SELECT *, CASE WHEN source = 'issue' THEN 'negative' WHEN pending THEN 'pending'
    WHEN source = 'competitor' THEN CASE WHEN good = 0 AND bad = 0 THEN CASE WHEN len(topics) > 0 THEN 'positive' ELSE 'neutral' END WHEN bad >= good AND bad > 0 THEN 'negative' ELSE 'positive' END
    WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS polarity FROM counted),
matched AS (SELECT i.doc_id, i.text AS issue, x.text AS change, CASE x.source WHEN 'competitor' THEN 'pull' ELSE 'tool' END AS side, x.polarity, i.pos AS ipos, x.pos AS xpos,
    10 * len(list_intersect(i.topics, x.topics)) + CASE WHEN len(list_intersect(i.tokens, x.tokens)) >= 2 THEN len(list_intersect(i.tokens, x.tokens)) ELSE 0 END + CASE WHEN len(list_intersect(i.topics, x.topics)) > 0 THEN 2 ELSE 0 END AS score
    FROM entries i JOIN entries x ON i.doc_id = x.doc_id AND i.source = 'issue' AND x.source <> 'issue'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side, polarity ORDER BY score DESC, ipos, xpos) AS r FROM matched WHERE score > 0) WHERE r = 1),
firsts AS (SELECT doc_id, source, polarity, arg_min(text, pos) AS text FROM entries GROUP BY ALL),
starts AS (SELECT doc_id, source, arg_min(text, pos) AS text FROM entries GROUP BY ALL),
viewed AS (SELECT sig.*, pp.issue AS pp_issue, pp.change AS pp, pe.issue AS pe_issue, pe.change AS pe, pt.issue AS pt_issue, pt.change AS pt, nt.issue AS nt_issue, nt.change AS nt,
    coalesce(pp.issue, pe.issue, nt.issue, pt.issue, si.text) AS primary_issue, coalesce(pp.change, pe.change, fp.text, fe.text, sc.text) AS primary_pull,
    coalesce(nt.change, pt.change, tn.text, tp.text, st.text) AS primary_tool_change, fp.text IS NOT NULL AS has_positive_pull, fe.text IS NOT NULL AS has_pending_pull,
    tp.text IS NOT NULL AS has_positive_tool, tn.text IS NOT NULL AS has_negative_tool
    FROM sig LEFT JOIN best pp ON pp.doc_id = sig.doc_id AND pp.side = 'pull' AND pp.polarity = 'positive' LEFT JOIN best pe ON pe.doc_id = sig.doc_id AND pe.side = 'pull' AND pe.polarity = 'pending'
    LEFT JOIN best pt ON pt.doc_id = sig.doc_id AND pt.side = 'tool' AND pt.polarity = 'positive' LEFT JOIN best nt ON nt.doc_id = sig.doc_id AND nt.side = 'tool' AND nt.polarity = 'negative'
    LEFT JOIN firsts fp ON fp.doc_id = sig.doc_id AND fp.source = 'competitor' AND fp.polarity = 'positive' LEFT JOIN firsts fe ON fe.doc_id = sig.doc_id AND fe.source = 'competitor' AND fe.polarity = 'pending'
    LEFT JOIN firsts tp ON tp.doc_id = sig.doc_id AND tp.source = 'tool' AND tp.polarity = 'positive' LEFT JOIN firsts tn ON tn.doc_id = sig.doc_id AND tn.source = 'tool' AND tn.polarity = 'negative'
    LEFT JOIN starts si ON si.doc_id = sig.doc_id AND si.source = 'issue' LEFT JOIN starts sc ON sc.doc_id = sig.doc_id AND sc.source = 'competitor' LEFT JOIN starts st ON st.doc_id = sig.doc_id AND st.source = 'tool')"""


@query(f"""WITH {SIGNALS}, {VIEW} SELECT doc_id, pp AS positive_pull, pe AS pending_pull, pt AS positive_tool, nt AS negative_tool, primary_issue, primary_pull, primary_tool_change,
has_positive_pull, has_pending_pull, has_positive_tool, has_negative_tool FROM viewed""")
def q_semantic_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the changes of competitor and tool meet the issues of each signal."""
    v = semantic_view(signals(spark, sf_dir), "issues", "changes", "tool")
    return v.select(
        "doc_id", *(F.col(f"{c}.change").alias(c) for c in ("positive_pull", "pending_pull", "positive_tool", "negative_tool")), "primary_issue", "primary_pull", "primary_tool_change",
        "has_positive_pull", "has_pending_pull", "has_positive_tool", "has_negative_tool",
    )


def judged(df: DataFrame, tools: str = "tool") -> DataFrame:
    """Signals with rules, semantic view, verdict (stated by the scenario, else inferred) and the first inconsistency or null.

    What a tool's lines tell of no change takes no part in the view.
    """
    c = F.col
    df = semantic_view(with_rules(df).withColumn("_changed", S.changed_lines(c(tools))), "issues", "changes", "_changed").drop("_changed")
    met = c("net") >= W.ROI_THRESHOLD
    severe = X.severity(c("positive_pull.issue")) == "HIGH"
    df = df.withColumn("supported", C.supports_switch(c("shelfware"), c("positive_pull.issue"), c("pending_pull.issue"), met, severe))
    stated = F.try_element_at(F.create_map(*(F.lit(x) for s, v in W.EXPECTED_VERDICT.items() if v for x in (s, v))), c("scenario"))
    df = df.withColumn("verdict", F.coalesce(stated, C.inferred_verdict(c("scenario"), met, c("positive_tool.change"), c("supported"))))
    facts = {n: c(n) for n in ("scenario", "verdict", "previous", "hold", "disqualifier", "shelfware", "supported")}
    facts |= {
        "price_hike": S.price_hike(c(tools)),
        "positive_pull": c("positive_pull.change"),
        "positive_tool": c("positive_tool.change"),
        "pending": c("pending_pull").isNotNull() | c("has_pending_pull"),
        "reassured": F.exists(tools, lambda x: X.any_of(x, W.REASSURING)),
        "failures": curated_failures(),
    }
    return df.withColumn("failure", C.consistency_failure(facts))


_STATED = "CASE scenario " + " ".join(f"WHEN '{s}' THEN '{v}'" for s, v in W.EXPECTED_VERDICT.items() if v) + " END"
_IN = lambda names: "scenario IN (" + ", ".join(f"'{n}'" for n in names) + ")"
JUDGED = f"""{RULES}, {CURATED}, {VIEW.replace("unnest(tool), generate_subscripts(tool, 1) FROM sig", f"unnest({_CHANGED}), generate_subscripts({_CHANGED}, 1) FROM sig")},
told AS (SELECT v.*, r.hold, r.disq, r.unused, f.failures, r.unused <> 'NONE' OR (v.pp IS NOT NULL AND (v.net >= 1200 OR {has_sql("v.pp_issue", W.HIGH_SEVERITY)})) AS supported
    FROM viewed v JOIN ruled r USING (doc_id) JOIN failed f USING (doc_id)),
given AS (SELECT *, coalesce({_STATED}, CASE WHEN scenario = 'price_hike_only' THEN CASE WHEN net >= 1200 THEN 'SWITCH' ELSE 'STAY' END WHEN scenario = 'dual_improvement' AND pt IS NULL THEN 'STAY'
    WHEN supported THEN 'SWITCH' ELSE 'STAY' END) AS verdict, pe IS NOT NULL OR has_pending_pull AS pending FROM told),
judged AS (SELECT *, CASE
    WHEN verdict = 'HOLD' AND hold = 'NONE' THEN 'HOLD example has no active hold signal' WHEN {_IN(W.HOLD_SCENARIOS)} AND hold = 'NONE' THEN 'HOLD scenario but no detectable hold signal'
    WHEN scenario = 'hold_resolved' AND previous IS DISTINCT FROM 'HOLD' THEN 'hold_resolved scenario without Previous verdict: HOLD' WHEN scenario = 'hold_resolved' AND hold <> 'NONE' THEN 'hold_resolved scenario still has an active hold signal'
    WHEN scenario = 'hold_resolved' AND NOT supported THEN 'hold_resolved scenario lacks a concrete aligned switch case' WHEN scenario = 'shelfware_case' AND unused = 'NONE' THEN 'shelfware_case scenario lacks a real shelfware flag'
    WHEN scenario = 'price_hike_only' AND len(list_filter(tool, lambda x: regexp_matches(x, {quoted(W.PRICE_HIKE)}))) = 0 THEN 'price_hike_only scenario lacks a real incumbent price signal'
    WHEN verdict = 'SWITCH' AND unused = 'NONE' AND NOT supported THEN 'SWITCH example lacks a concrete competitor change aligned to a key issue'
    WHEN scenario = 'current_tool_rally' AND pt IS NULL AND len(list_filter(tool, lambda x: {has_sql("x", W.REASSURING)})) = 0 THEN 'current_tool_rally scenario lacks a real current-tool improvement'
    WHEN scenario = 'dual_improvement' AND pt IS NULL THEN 'dual_improvement scenario lacks a real current-tool improvement' WHEN scenario = 'dual_improvement' AND pp IS NULL THEN 'dual_improvement scenario lacks a competitor improvement aligned to a key issue'
    WHEN scenario = 'competitor_nearly_ready' AND NOT pending THEN 'competitor_nearly_ready scenario lacks a pending pull aligned to a key issue'
    WHEN scenario = 'roadmap_confirmed_hold' AND NOT supported AND NOT pending THEN 'roadmap_confirmed_hold scenario lacks a roadmap pull that would justify waiting'
    WHEN {_IN(W.CLEARING_HOLDS)} AND NOT supported THEN 'hold scenario lacks a concrete underlying switch case once the hold clears'
    WHEN scenario = 'fluff_update' AND pp IS NOT NULL THEN 'fluff_update scenario contains a concrete aligned competitor pull'
    WHEN scenario = 'irrelevant_change' AND pp IS NOT NULL AND disq = 'NONE' THEN 'irrelevant_change scenario contains an aligned competitor pull'
    WHEN scenario = 'negative_signal_buried' AND disq = 'NONE' THEN 'negative_signal_buried scenario lacks a buried disqualifier'
    WHEN unused <> 'NONE' AND hold = 'NONE' AND verdict = 'STAY' AND disq = 'NONE' THEN 'shelfware flag present with STAY verdict and no disqualifier'
    WHEN scenario = 'hard_compliance_failure' AND len(failures) = 0 THEN 'hard_compliance_failure scenario but compliance is not blocked'
    WHEN scenario <> 'hard_compliance_failure' AND len(failures) > 0 THEN 'compliance blocked in non-compliance scenario' END AS failure FROM given)"""


@query(f"WITH {JUDGED} SELECT doc_id, verdict, supported, failure FROM judged")
def q_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each signal and the first reason, if any, why it doesn't fit its scenario."""
    return judged(signals(spark, sf_dir)).select("doc_id", "verdict", "supported", "failure")


@query(f"""WITH {JUDGED}, fit AS (SELECT doc_id, verdict, scenario, category, slug FROM judged WHERE failure IS NULL),
spread AS (SELECT *, row_number() OVER (PARTITION BY verdict, category ORDER BY md5('99|' || doc_id), doc_id) AS place FROM fit),
t AS (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM fit GROUP BY verdict, category)),
kept AS (SELECT * FROM spread, t WHERE place <= target), g AS (SELECT DISTINCT verdict, category, slug FROM kept),
n AS (SELECT *, count(*) OVER (PARTITION BY verdict, category) AS n, row_number() OVER (PARTITION BY verdict, category ORDER BY md5('123|' || slug), slug) AS p FROM g),
w AS (SELECT *, least(greatest(CAST(round_even(n * 0.15, 0) AS INTEGER), CASE WHEN n >= 3 THEN 1 ELSE 0 END), n - 1) AS want FROM n)
SELECT doc_id, kept.verdict, scenario, kept.category, kept.slug, CASE WHEN n >= 2 AND p <= want THEN 'val' ELSE 'train' END AS split FROM kept JOIN w USING (verdict, category, slug)""")
def q_curated_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curation from end to end: consistent signals, as many of each verdict and category, split by competitor.

    Judgements are written once, before they are filtered: a filter on them would be pushed below them and spell out all
    rules again, and balancing reads its rows more than once.
    """
    told = written(judged(signals(spark, sf_dir)).select("doc_id", "verdict", "scenario", "category", "slug", "failure"), "judged")
    fit = told.filter("failure is null").drop("failure")
    cell = fit.withColumn("cell", F.concat_ws(":", "verdict", "category"))
    return grouped_split(balanced(cell, "cell", 99, "doc_id").drop("cell", "place"), ["verdict", "category"], "slug", 0.15, 123)
