"""Curation of signals for training: effective compliance, profiles, consistency, inferred verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compliance
from . import words as W
from .signals import changed_lines, stripped, training_text
from .text import any_of, hits, let, shelfware, substance


def told_compliance(changes: Column) -> Column:
    """Compliance changes in lower case; null where they tell none."""
    text = F.lower(training_text(changes))
    return F.when(~stripped(text).isin(W.UNTOLD_COMPLIANCE), text)


def curated_profile(profile: Column, changes: Column) -> Column:
    """The profile after compliance changes, by the simpler reading that curation uses: the whole text, no segments."""
    yes = lambda name: F.coalesce(profile[name], F.lit(False))

    def after(text: Column) -> Column:
        gain = any_of(text, W.CURATED_GAINS)
        says = lambda words: any_of(text, words)
        no_soc2, no_sso = says(["not soc2", "no soc2"]), says(["no sso", "lacks sso", "no saml", "lacks saml"])
        no_audit = says(["no audit log", "lacks audit log", "no audit trail", "no exportable audit"])
        home = says(["uk"]) & says(["residency"])
        return F.struct(
            F.when(says(["soc2", "soc 2"]) & no_soc2, False).when(says(["soc2", "soc 2"]) & gain, True).otherwise(yes("soc2_type2")).alias("soc2_type2"),
            F.when(says(["sso", "saml", "oidc"]) & no_sso, False).when(says(["sso", "saml", "oidc"]) & gain, True).otherwise(yes("sso_saml")).alias("sso_saml"),
            F.when(home, gain).otherwise(yes("uk_residency")).alias("uk_residency"),
            F.when(home & gain, True).otherwise(yes("gdpr_eu_residency")).alias("gdpr_eu_residency"),
            F.when(says(["audit"]) & no_audit, False).when(says(["audit"]) & gain, True).otherwise(yes("audit_log")).alias("audit_log"),
            F.when(says(["audit"]) & no_audit, False).when(says(["audit"]) & gain, True).otherwise(profile["audit_log_exportable"]).alias("audit_log_exportable"),
        )

    return let(F.coalesce(told_compliance(changes), F.lit("")), after)


def curated_failures(profile: Column, changes: Column, category: Column, seats: Column) -> Column:
    """Requirements that fail after the changes; an empty list is a pass."""
    return compliance.failures(curated_profile(profile, changes), category, seats)


def tool_trend(tool_lines: Column) -> Column:
    """stable, shelfware, rally, degrading or mixed."""

    def named(lines: Column) -> Column:
        text = F.array_join(lines, " ")
        up, down = hits(text, W.TREND_UP) > 0, hits(text, W.TREND_DOWN) > 0
        return (
            F.when(F.size(lines) == 0, "stable")
            .when(shelfware(lines) != "NONE", "shelfware")
            .when(up & down, "mixed")
            .when(up, "rally")
            .when(down, "degrading")
            .otherwise("stable")
        )

    return let(changed_lines(tool_lines), named)


def push_profile(tool_lines: Column, issues: Column) -> Column:
    text = F.array_join(F.concat(tool_lines, issues), " ")
    return (
        F.when(shelfware(tool_lines) != "NONE", "shelfware")
        .when(any_of(text, W.COMPLIANCE_PUSH), "compliance_gap")
        .when(any_of(text, W.INTEGRATION_PUSH), "integration_gap")
        .when(any_of(text, W.COST_PUSH), "cost_pressure")
        .when(any_of(text, W.OPERATIONAL_PUSH), "operational_friction")
        .otherwise("general_gap")
    )


def pull_profile(changes: Column, notes: Column, hold: Column, disqualified: Column) -> Column:
    """What the first three changes are made of, unless a rule comes first."""
    kinds = F.array_distinct(F.transform(F.slice(changes, 1, 3), substance))
    return (
        F.when(disqualified != "NONE", "disqualified")
        .when(hold != "NONE", "blocked_pending")
        .when(any_of(F.array_join(notes, " "), W.IRRELEVANT), "irrelevant")
        .when(F.size(changes) == 0, "none")
        .when(F.size(kinds) == 2, "mixed")
        .otherwise(F.lower(F.get(kinds, 0)))
    )


def gate_state(scenario: Column, previous: Column, changes: Column, hold: Column, disqualified: Column, unused: Column) -> Column:
    """Which gate decides a signal; ``changes`` are its compliance changes, ``unused`` its shelfware line."""
    told = told_compliance(changes)
    unblocked = F.coalesce(any_of(told, W.CURATED_GAINS) & any_of(told, W.HARD_COMPLIANCE), F.lit(False))
    resolved = F.coalesce(previous == "HOLD", F.lit(False)) & (scenario == "hold_resolved")
    return (
        F.when(disqualified != "NONE", "disqualifier")
        .when(hold != "NONE", "hold_active")
        .when(resolved, "hold_resolved")
        .when(unused != "NONE", "shelfware_override")
        .when(unblocked, "compliance_unblocked")
        .otherwise("open")
    )


def supports_switch(unused: Column, positive_issue: Column, pending_issue: Column, roi_met: Column, severe: Column, allow_pending: bool = False) -> Column:
    """Shelfware, or a pull that meets an issue and either pays off or meets a severe one.

    ``positive_issue`` and ``pending_issue`` are the issues that the best pulls meet, or null; ``severe`` tells of an issue
    whether it is of high severity.
    """
    issue = F.coalesce(positive_issue, pending_issue) if allow_pending else positive_issue
    return (unused != "NONE") | (issue.isNotNull() & (roi_met | F.coalesce(severe, F.lit(False))))


def inferred_verdict(scenario: Column, roi_met: Column, positive_tool: Column, supported: Column) -> Column:
    """The verdict of a scenario that states none."""
    return (
        F.when(scenario == "price_hike_only", F.when(roi_met, "SWITCH").otherwise("STAY"))
        .when((scenario == "dual_improvement") & positive_tool.isNull(), "STAY")
        .otherwise(F.when(supported, "SWITCH").otherwise("STAY"))
    )


def consistency_failure(s: dict[str, Column]) -> Column:
    """The first reason why a signal doesn't fit its scenario and verdict, or null.

    ``s`` has scenario, verdict, previous, hold, disqualifier, shelfware, price_hike, supported, positive_pull, positive_tool,
    pending (whether any pull is pending), reassured, failures.
    """
    scenario, verdict = s["scenario"], s["verdict"]
    no = lambda c: s[c] == "NONE"
    is_ = lambda *names: scenario.isin(*names)
    blocked = F.size(s["failures"]) > 0
    reasons = [
        ((verdict == "HOLD") & no("hold"), "HOLD example has no active hold signal"),
        (is_(*W.HOLD_SCENARIOS) & no("hold"), "HOLD scenario but no detectable hold signal"),
        (is_("hold_resolved") & ~F.coalesce(s["previous"] == "HOLD", F.lit(False)), "hold_resolved scenario without Previous verdict: HOLD"),
        (is_("hold_resolved") & ~no("hold"), "hold_resolved scenario still has an active hold signal"),
        (is_("hold_resolved") & ~s["supported"], "hold_resolved scenario lacks a concrete aligned switch case"),
        (is_("shelfware_case") & no("shelfware"), "shelfware_case scenario lacks a real shelfware flag"),
        (is_("price_hike_only") & no("price_hike"), "price_hike_only scenario lacks a real incumbent price signal"),
        ((verdict == "SWITCH") & no("shelfware") & ~s["supported"], "SWITCH example lacks a concrete competitor change aligned to a key issue"),
        (is_("current_tool_rally") & s["positive_tool"].isNull() & ~s["reassured"], "current_tool_rally scenario lacks a real current-tool improvement"),
        (is_("dual_improvement") & s["positive_tool"].isNull(), "dual_improvement scenario lacks a real current-tool improvement"),
        (is_("dual_improvement") & s["positive_pull"].isNull(), "dual_improvement scenario lacks a competitor improvement aligned to a key issue"),
        (is_("competitor_nearly_ready") & ~s["pending"], "competitor_nearly_ready scenario lacks a pending pull aligned to a key issue"),
        (is_("roadmap_confirmed_hold") & ~s["supported"] & ~s["pending"], "roadmap_confirmed_hold scenario lacks a roadmap pull that would justify waiting"),
        (is_(*W.CLEARING_HOLDS) & ~s["supported"], "hold scenario lacks a concrete underlying switch case once the hold clears"),
        (is_("fluff_update") & s["positive_pull"].isNotNull(), "fluff_update scenario contains a concrete aligned competitor pull"),
        (is_("irrelevant_change") & s["positive_pull"].isNotNull() & no("disqualifier"), "irrelevant_change scenario contains an aligned competitor pull"),
        (is_("negative_signal_buried") & no("disqualifier"), "negative_signal_buried scenario lacks a buried disqualifier"),
        (~no("shelfware") & no("hold") & (verdict == "STAY") & no("disqualifier"), "shelfware flag present with STAY verdict and no disqualifier"),
        (is_("hard_compliance_failure") & ~blocked, "hard_compliance_failure scenario but compliance is not blocked"),
        (blocked & ~is_("hard_compliance_failure"), "compliance blocked in non-compliance scenario"),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), reason) for test, reason in reasons))
