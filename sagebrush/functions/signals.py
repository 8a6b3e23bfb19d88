"""Signals: names of files, payloads of loose types, coercion and validation, as column expressions.

A payload is a JSON object; as a column it is a variant (``try_parse_json`` of a text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .text import any_of, first_where, let

PYTHON_NAMES = {"STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "VOID": "NoneType"}


def alternatives(names: list[str]) -> str:
    """A pattern of the names, longer ones first."""
    return "|".join(map(re.escape, sorted(names, key=len, reverse=True)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parts(text: Column, pattern: str, *names: str) -> Column:
    """The pattern's groups as a struct; null if it doesn't match."""
    return F.when(text.rlike(pattern), F.struct(*(F.regexp_extract(text, pattern, i).alias(n) for i, n in enumerate(names, 1))))


#: The shortest competitor leaves the longest scenario.
GENERATED = rf"^({alternatives(W.CATEGORIES)})_(.+?)_({alternatives(W.SCENARIOS)})$"
INBOX = rf"^({alternatives(W.CATEGORIES)})_(.+)$"


def generated_name(stem: Column) -> Column:
    """category, competitor and scenario of ``{category}_{competitor}_{scenario}``; null if the name has another shape."""
    return parts(stem, GENERATED, "category", "competitor", "scenario")


def inbox_name(path: Column, strict: bool = False) -> Column:
    """category and competitor of ``.../{category}_{competitor}.md``; null, or an error if ``strict``, for other names."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    found = parts(stem, INBOX, "category", "competitor")
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no category and competitor in the name "), path))) if strict else found


def strict_json(text: Column) -> Column:
    """The one JSON value that a text is, as a variant; null for anything else. The parser alone overlooks what follows a value."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(listed) == 1, F.get(listed, 0))


def kind(value: Column) -> Column:
    """STRING, ARRAY, OBJECT, VOID, ... of a variant; null if there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def lines(value: Column) -> Column:
    """A text or a list of texts as a list of trimmed texts; blank ones and everything else are left out."""
    texts = F.when(kind(value) == "STRING", F.array(string(value))).when(kind(value) == "ARRAY", F.transform(F.filter(items(value), lambda x: kind(x) == "STRING"), string))
    return F.coalesce(F.filter(F.transform(texts, stripped), lambda x: x != ""), F.array().cast("array<string>"))


def entry_text(value: Column) -> Column:
    """An object with a name as ``name: status``, another one as JSON, a text trimmed; null for blanks and the rest."""
    name, status = string(field(value, "name")), F.coalesce(string(field(value, "status")), F.lit(""))
    told = F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws(": ", name, status)).otherwise(F.to_json(value))
    return F.when(kind(value) == "OBJECT", told).when(kind(value) == "STRING", F.nullif(stripped(string(value)), F.lit("")))


def compliance_text(value: Column) -> Column:
    """Compliance changes told as a text, a list or an object, as one text. An object is told as compact JSON."""
    listed = F.array_join(F.filter(F.transform(items(value), entry_text), lambda x: x.isNotNull()), "; ")
    return F.coalesce(F.when(kind(value) == "STRING", stripped(string(value))).when(kind(value) == "OBJECT", F.to_json(value)).when(kind(value) == "ARRAY", listed), F.lit(""))


def coerced(payload: Column) -> Column:
    """compliance_changes as text, notes as list and date as day, where a payload has other types; ``changed`` tells whether it had."""
    told, notes, date = (field(payload, n) for n in ("compliance_changes", "notes", "date"))
    pairs = F.transform(F.map_entries(F.try_variant_get(told, "$", "map<string,string>")), lambda e: F.concat_ws(": ", e["key"], F.coalesce(e["value"], F.lit("null"))))
    truthy = F.filter(items(told), lambda x: ~F.coalesce(F.to_json(x), F.lit("null")).isin("null", '""', "0", "false", "[]", "{}"))
    listed = F.transform(truthy, lambda x: F.coalesce(string(x), F.to_json(x)))
    loose, blank = kind(told).isin("ARRAY", "OBJECT"), kind(notes).isNull() | (kind(notes) == "VOID")
    single = (kind(notes) == "STRING") & (stripped(string(notes)) != "")
    day = F.coalesce(string(date), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.struct(
        F.when(kind(told) == "OBJECT", F.array_join(pairs, "; ")).when(kind(told) == "ARRAY", F.array_join(listed, "; ")).otherwise(string(told)).alias("compliance_changes"),
        F.when(blank, F.array().cast("array<string>")).when(single, F.array(stripped(string(notes)))).otherwise(F.try_variant_get(notes, "$", "array<string>")).alias("notes"),
        F.when(day, string(date)).otherwise(W.FALLBACK_DATE).alias("date"),
        (F.coalesce(loose, F.lit(False)) | F.coalesce(blank | single, F.lit(False)) | ~day).alias("changed"),
    )


def present(errors: list[Column]) -> Column:
    return F.filter(F.array(*errors), lambda x: x.isNotNull())


def type_errors(payload: Column) -> Column:
    """Fields that a payload lacks or has in another type, in the order of the fields."""
    wanted = {"str": "STRING", "list": "ARRAY"}
    found = []
    for name, of in W.SIGNAL_FIELDS.items():
        value = kind(field(payload, name))
        got = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PYTHON_NAMES.items() for x in kv)), value), F.when(value == "ARRAY", "list").when(value == "OBJECT", "dict").otherwise("float"))
        found.append(F.when(value.isNull(), F.lit(f"Missing field: {name}")).when(value != wanted[of], F.concat(F.lit(f"Wrong type for {name}: expected {of}, got "), got)))
    return present(found)


def typed(payload: Column) -> Column:
    """A payload's fields as a struct; lists hold the texts among their elements."""
    return F.struct(*((string(field(payload, n)) if of == "str" else lines(field(payload, n))).alias(n) for n, of in W.SIGNAL_FIELDS.items()))


def content_errors(signal: Column, name: Column) -> Column:
    """What is wrong with the contents of a signal (struct of fields) whose file is called ``name`` (struct), in order."""
    low = lambda f: stripped(F.lower(signal[f]))
    empty = lambda f: F.size(signal[f]) == 0
    scenario, told = name["scenario"], low("compliance_changes")
    noted = F.lower(F.array_join(signal["notes"], " "))
    quoted = lambda text, x: F.concat(F.lit(text), F.lit("'"), x, F.lit("'"))
    still = F.forall(signal["current_tool_status"], lambda x: stripped(F.lower(x)).isin(W.NO_DEGRADATION))
    of = lambda names: scenario.isin(names)
    first = [
        F.when(signal["scenario_type"] != scenario, F.concat(quoted("scenario_type mismatch: file says ", signal["scenario_type"]), quoted(", filename says ", scenario))),
        F.when(signal["category"] != name["category"], F.concat(quoted("category mismatch: file says ", signal["category"]), quoted(", filename says ", name["category"]))),
        F.when(stripped(signal["competitor"]) == "", F.lit("competitor name is empty")),
        F.when(stripped(signal["current_tool"]) == "", F.lit("current_tool name is empty")),
        F.when(~signal["date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), quoted("date is not YYYY-MM-DD: ", signal["date"])),
    ]
    texts = F.concat(F.array(signal["date"], signal["pricing_delta"], signal["compliance_changes"]), signal["competitor_changes"], signal["current_tool_status"], signal["notes"])
    placeholders = F.transform(F.filter(texts, lambda x: stripped(x).rlike(W.PLACEHOLDER)), lambda x: quoted("Placeholder value detected: ", x))
    rest = [
        F.when(of(["pull_dominant"]) & empty("competitor_changes"), F.lit("pull_dominant: competitor_changes is empty")),
        F.when(of(W.PUSHED_SCENARIOS) & empty("current_tool_status"), F.concat(scenario, F.lit(": current_tool_status is empty"))),
        F.when(of(W.PUSHED_SCENARIOS) & ~empty("current_tool_status") & still, F.concat(scenario, F.lit(": current_tool_status shows no degradation"))),
        F.when(of(["fluff_update"]) & empty("competitor_changes"), F.lit("fluff_update: competitor_changes is empty")),
        F.when(of(W.COMPLIANCE_SCENARIOS) & told.isin("unchanged", "no change", ""), F.concat(scenario, F.lit(": compliance_changes must describe a compliance event"))),
        F.when(of(W.NOTED_SCENARIOS) & empty("notes"), F.concat(scenario, F.lit(": notes is empty"))),
        F.when(of(["hard_compliance_failure"]) & ~any_of(told, W.BLOCK_WORDS) & ~any_of(noted, W.BLOCK_WORDS), F.lit("hard_compliance_failure: no compliance block keywords found")),
        F.when(of(["compliance_newly_met"]) & ~any_of(told, W.MET_WORDS), F.lit("compliance_newly_met: compliance_changes should describe acquisition of cert")),
        F.when(of(W.EXPLAINED_HOLDS) & ~any_of(noted, W.HOLD_WORDS), F.concat(scenario, F.lit(": notes should explain the hold condition"))),
    ]
    return F.concat(present(first), placeholders, present(rest))


def signal_errors(stem: Column, text: Column) -> Column:
    """All that is wrong with a signal file: its name, else its JSON, else its types, else its contents."""

    def of_payload(payload: Column) -> Column:
        loose = type_errors(payload)
        return (
            F.when(payload.isNull(), F.array(F.lit("Invalid JSON")))
            .when(kind(payload) != "OBJECT", F.array(F.lit("Root is not a JSON object")))
            .when(F.size(loose) > 0, loose)
            .otherwise(let(typed(payload), lambda s: content_errors(s, generated_name(stem))))
        )

    unnamed = F.array(F.lit("Cannot parse filename"))
    return F.when(generated_name(stem).isNull(), unnamed).otherwise(let(strict_json(text), of_payload))


def signal_case(stem: Column, text: Column) -> Column:
    """signal (variant), category, competitor, scenario and expected verdict of a case; null where none can be told.

    The signal may be wrapped; what the wrapper states goes before what the name says.
    """
    payload = strict_json(text)
    name = generated_name(stem)
    inner = field(payload, "signal")
    stated = lambda n: F.when(kind(field(payload, n)) == "STRING", F.nullif(string(field(payload, n)), F.lit("")))
    verdict = F.upper(stripped(string(field(payload, "expected_verdict"))))
    by_scenario = F.create_map(*(F.lit(x) for s, v in W.EXPECTED_VERDICT.items() if v for x in (s, v)))
    category, competitor = F.coalesce(stated("category"), name["category"]), F.coalesce(stated("competitor_slug"), name["competitor"])
    return F.when(
        (kind(payload) == "OBJECT") & category.isNotNull() & competitor.isNotNull(),
        F.struct(
            F.when(kind(inner) == "OBJECT", inner).otherwise(payload).alias("signal"),
            category.alias("category"),
            competitor.alias("competitor"),
            stripped(F.coalesce(stated("scenario"), name["scenario"], stem)).alias("scenario"),
            F.coalesce(F.when(verdict.isin("SWITCH", "STAY", "HOLD"), verdict), F.try_element_at(by_scenario, name["scenario"])).alias("expected"),
        ),
    )


def missing_keys(payload: Column, required: list[str]) -> Column:
    """Required keys that an object lacks, sorted."""
    return present([F.when(field(payload, k).isNull(), F.lit(k)) for k in sorted(required)])


def is_subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def competitor_errors(payload: Column) -> Column:
    """What a registry entry lacks. The payload and its parts are made once for each row, however often they are asked."""
    told = lambda what, keys: let(keys, lambda k: F.when(F.size(k) > 0, F.concat(F.lit(what), F.array_join(k, ", "))))

    def of_profile(profile: Column) -> Column:
        keys = F.when(profile.isNull(), F.array(*map(F.lit, sorted(W.COMPLIANCE_KEYS)))).otherwise(missing_keys(profile, W.COMPLIANCE_KEYS))
        return F.when((kind(profile) == "OBJECT") | profile.isNull(), told("compliance missing keys: ", keys)).otherwise(F.lit("compliance is not an object"))

    def of_features(features: Column) -> Column:
        return F.when(~F.coalesce((kind(features) == "ARRAY") & (F.size(items(features)) > 0), F.lit(False)), F.lit("features list is empty or missing"))

    def of_payload(p: Column) -> Column:
        return present([told("missing keys: ", missing_keys(p, W.COMPETITOR_KEYS)), let(field(p, "compliance"), of_profile), let(field(p, "features"), of_features)])

    return let(payload, of_payload)


def stack_errors(payload: Column) -> Column:
    """Categories that a stack lacks, and keys that its entries lack. The payload and its entries are made once for each row."""

    def of_entry(c: str):
        told = lambda keys: F.when(F.size(keys) > 0, F.concat(F.lit(f"{c} missing keys: "), F.array_join(keys, ", ")))
        return lambda entry: F.when(entry.isNull(), F.lit(f"missing category: {c}")).otherwise(let(missing_keys(entry, W.STACK_KEYS), told))

    return let(payload, lambda p: present([let(field(p, c), of_entry(c)) for c in W.CATEGORIES]))


def price_hike(tool_lines: Column) -> Column:
    return F.coalesce(first_where(tool_lines, lambda x: x.rlike(W.PRICE_HIKE)), F.lit("NONE"))


def changed_lines(tool_lines: Column) -> Column:
    """Lines that tell a change."""
    return F.filter(tool_lines, lambda x: ~stripped(F.lower(x)).isin(W.NO_CHANGE))


def training_text(text: Column) -> Column:
    """Placeholders replaced in their order, white space and dots collapsed."""
    for found, put in W.TRAINING_PLACEHOLDERS.items():
        text = F.regexp_replace(text, "(?i)" + re.escape(found), put)
    return stripped(F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"\.\.+", "."))


def training_lines(texts: Column) -> Column:
    return F.filter(F.transform(texts, training_text), lambda x: x != "")
