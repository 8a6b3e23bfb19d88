"""Compliance gate and verdict override as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .text import any_of

SSO_SEATS = 10


def failures(profile: Column, category: Column, seats: Column) -> Column:
    """Mandatory requirements that a compliance profile (struct of booleans) misses; a missing flag is false.

    An audit log counts as exportable unless the profile denies it.
    """
    yes = lambda name: F.coalesce(profile[name], F.lit(False))
    audit = yes("audit_log") & F.coalesce(profile["audit_log_exportable"], F.lit(True))
    checks = [
        F.when(~yes("soc2_type2"), "No SOC2 Type II"),
        F.when((seats > SSO_SEATS) & ~yes("sso_saml"), "No SSO/SAML"),
        F.when(~yes("uk_residency") & ~yes("gdpr_eu_residency"), "No UK or EU data residency"),
        F.when(category.isin(*W.AUDITED_CATEGORIES) & ~audit, "No exportable audit log"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def segment(text: Column, keywords: list[str]) -> Column:
    """The first part between semicolons, or else between line feeds, that holds a keyword; null if none does."""
    of = lambda by: F.get(F.filter(F.transform(F.split(text, by), F.trim), lambda p: any_of(p, keywords)), 0)
    return F.coalesce(of(";"), of("\n"))


def gained(part: Column) -> Column:
    """A part tells a gain: beside words of loss only by a sure word that "not" doesn't precede."""
    sure = part.rlike("(?<!not\\s{1,4})(?:" + "|".join(W.GAINED_FOR_SURE) + ")")
    return F.when(any_of(part, W.LOST), sure).otherwise(any_of(part, W.GAINED))


def effective_profile(profile: Column, changes: Column, category: Column, seats: Column) -> Column:
    """The profile after compliance changes told in words: gains where a flag was false, losses where it was true."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(changes, F.lit("")), r"^\s*\{[^{}]*\}\s*;?", "")))
    silent = text.isin("", "unchanged", "no changes", "none")
    yes = lambda name: F.coalesce(profile[name], F.lit(False))
    lost = lambda part: any_of(part, W.LOST)
    soc2, sso, uk, eu, audit = (segment(text, k) for k in (["soc2", "soc 2"], ["sso", "saml", "oidc"], ["uk"], ["eu", "gdpr"], ["audit log", "audit trail", "exportable audit"]))
    flip = lambda name, part, able: F.when(part.isNull(), yes(name)).when(~yes(name) & able & gained(part), True).when(yes(name) & lost(part), False).otherwise(yes(name))
    home = uk.isNotNull() & F.contains(uk, F.lit("residency"))
    abroad = eu.isNotNull() & F.contains(eu, F.lit("residency")) & gained(eu)
    audited = category.isin(*W.AUDITED_CATEGORIES) & audit.isNotNull()
    win = audited & ~yes("audit_log") & gained(audit) & ~F.contains(audit, F.lit("csv only"))
    lose = audited & yes("audit_log") & lost(audit)
    exportable = profile["audit_log_exportable"]
    exports = audited & yes("audit_log") & ~lost(audit) & ~F.coalesce(exportable, F.lit(False)) & any_of(audit, ["audit log export", "exportable audit", "audit trail export"]) & gained(audit)
    new = F.struct(
        flip("soc2_type2", soc2, F.lit(True)).alias("soc2_type2"),
        flip("sso_saml", sso, seats > SSO_SEATS).alias("sso_saml"),
        F.when(home & gained(uk), True).when(home & lost(uk), False).otherwise(yes("uk_residency")).alias("uk_residency"),
        (F.coalesce(home & gained(uk), F.lit(False)) | yes("gdpr_eu_residency") | F.coalesce(abroad, F.lit(False))).alias("gdpr_eu_residency"),
        F.when(win, True).when(lose, False).otherwise(yes("audit_log")).alias("audit_log"),
        F.when(win | exports, True).when(lose, False).otherwise(exportable).alias("audit_log_exportable"),
    )
    same = F.struct(*(profile[c].alias(c) for c in ("soc2_type2", "sso_saml", "uk_residency", "gdpr_eu_residency", "audit_log", "audit_log_exportable")))
    return F.when(silent, same).otherwise(new)


def overridden(verdict: Column, hold: Column, disqualified: Column, blocks: Column, enabler: Column, demand: Column) -> Column:
    """The verdict after the rules: hold; else blocked or disqualified; else migration and demand both told."""
    return (
        F.when(hold != "NONE", "HOLD")
        .when((F.size(blocks) > 0) | (disqualified != "NONE"), "STAY")
        .when((enabler != "NONE") & (demand != "NONE"), "SWITCH")
        .otherwise(verdict)
    )
