"""Golden cases of the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sagebrush.functions import compliance, confidence, finance
from sagebrush.functions import text as X


def one(spark, column, **values):
    return spark.createDataFrame([Row(**(values or {"_": 1}))]).select(column.alias("x")).first().x


@pytest.mark.parametrize(("saving", "hours", "rate", "cost", "amortised", "net", "met"), [(480.0, 10, 48, 480, 160, 320, False), (1440.0, 8, 48, 384, 128, 1312, True), (0.0, 5, 48, 240, 80, -80, False), (600.0, 15, 65, 975, 325, 275, False)])
def test_roi(spark, saving, hours, rate, cost, amortised, net, met):
    r = one(spark, finance.roi(F.lit(saving), F.lit(hours), F.lit(rate)))
    assert (r.migration_cost, r.amortised, r.annual_net, r.met) == (cost, amortised, net, met)


def test_saving(spark):
    assert one(spark, finance.annual_saving(F.lit(420.0), F.lit(None).cast("double"), F.lit(380.0))) == 480
    assert one(spark, finance.annual_saving(F.lit(300.0), F.lit(95.0), F.lit(450.0))) == (395 - 450) * 12


@pytest.mark.parametrize(
    ("said", "base", "current", "price"),
    [
        ("from £390 to £345", 390, 510, 345),
        ("£390 (competitor) vs £510 (the tool)", 390, 510, 390),
        ("reduced by £40", 390, 510, 350),
        ("from PS480 to PS355 a month", 480, 510, 355),
        ("PS390 (competitor) vs PS340 (InsightDeck)", 400, 340, 390),
        ("PS420 (a) vs PS420 (b)", 400, 420, 400),
        ("PS340 (a) vs PS385 (b)", 400, 290, 340),
        ("unchanged, was £400", 390, 510, 390),
        ("", 390, 510, 390),
        (None, 390, 510, 390),
        ("slightly reduced", 5, 510, 0),
        ("slightly increased", 5, 510, 15),
        ("£510", 390, 510, 390),
        ("competitor at £510", 390, 510, 510),
    ],
)
def test_price(spark, said, base, current, price):
    assert one(spark, finance.inferred_price(F.lit(said).cast("string"), F.lit(float(base)), F.lit(float(current)))) == price


def profile(**changes):
    flags = dict(soc2_type2=True, sso_saml=True, uk_residency=True, gdpr_eu_residency=True, audit_log=True, audit_log_exportable=True) | changes
    return F.struct(*(F.lit(v).cast("boolean").alias(k) for k, v in flags.items()))


@pytest.mark.parametrize(
    ("changes", "category", "seats", "n"),
    [
        ({}, "crm", 22, 0),
        ({"soc2_type2": False}, "crm", 22, 1),
        ({"sso_saml": False}, "crm", 22, 1),
        ({"sso_saml": False}, "crm", 8, 0),
        ({"sso_saml": False}, "crm", 10, 0),
        ({"uk_residency": False, "gdpr_eu_residency": False}, "crm", 22, 1),
        ({"uk_residency": False}, "crm", 22, 0),
        ({"audit_log": False}, "finance", 22, 1),
        ({"audit_log": False}, "analytics", 22, 0),
        ({"audit_log_exportable": False}, "hr", 22, 1),
        ({"audit_log_exportable": None}, "hr", 22, 0),
        (dict.fromkeys(["soc2_type2", "sso_saml", "uk_residency", "gdpr_eu_residency", "audit_log"], False), "crm", 22, 4),
    ],
)
def test_gate(spark, changes, category, seats, n):
    assert len(one(spark, compliance.failures(profile(**changes), F.lit(category), F.lit(seats)))) == n


def test_effective_profile(spark):
    new = lambda text, **c: one(spark, compliance.effective_profile(profile(**c), F.lit(text), F.lit("crm"), F.lit(22)))
    assert new("acquired SOC2 Type II certification", soc2_type2=False).soc2_type2
    both = new("acquired UK data residency", uk_residency=False, gdpr_eu_residency=False)
    assert both.uk_residency and both.gdpr_eu_residency
    assert not new("no changes", soc2_type2=False).soc2_type2
    assert not new("SOC2 lapsed: not certified").soc2_type2


def test_signals(spark):
    lines = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    hold = lambda notes, changes=(): one(spark, X.hold_signal(lines(*notes), lines(*changes)))
    assert hold(["consider a pilot", "renewal in May"]) == "renewal in May"
    assert hold(["no beta or roadmap caveats"]) == "NONE"
    assert hold([], ["export in beta"]) == "export in beta"
    assert one(spark, X.disqualifier(lines("in preview"), F.lit("NONE"))) == "in preview"
    assert one(spark, X.disqualifier(lines("in preview"), F.lit("renewal"))) == "NONE"
    shelf = lambda *x: one(spark, X.shelfware(lines(*x)))
    assert shelf("inactive seats: 14") == "inactive seats: 14"
    assert shelf("inactive seats: 9") == "NONE"
    assert shelf("inactive seats: 14", "Shelfware: False") == "NONE"


MEMO = "CATEGORY: crm\nCURRENT TOOL: Old (£10/mo)\nCOMPETITOR: New\nDATE: d\nPUSH SIGNALS:\n  - slow\nPULL SIGNALS:\n  - fast\nFINANCIAL ANALYSIS:\nROI threshold met: YES\nVERDICT: {}\nEVIDENCE:\n\"q\"\n"


def test_memo(spark):
    memo = lambda v: F.lit(MEMO.format(v))
    assert one(spark, X.memo_errors(memo("SWITCH"))) == []
    assert one(spark, X.memo_errors(memo("HOLD"))) == ["HOLD without REASSESS CONDITION"]
    assert one(spark, X.memo_errors(memo("MAYBE"))) == ["invalid verdict"]
    assert one(spark, X.verdict(memo("**STAY**"))) == "STAY"
    assert one(spark, X.verdict(F.lit("VERDICT: UNKNOWN"))) is None
    assert one(spark, X.verdict(F.lit("we switch, then hold"))) == "HOLD"
    held = MEMO.format("HOLD") + "REASSESS CONDITION: GA\nREVIEW BY: 2026-05-01\n"
    data = one(spark, X.hold_metadata(F.lit(held)))
    assert (data.current_tool, data.reassess_condition, data.review_by, data.hold_reason) == ("Old", "GA", "2026-05-01", "slow")
    assert one(spark, X.hold_metadata(F.lit(held.replace("REVIEW BY", "X")))) is None
    assert one(spark, F.size(X.lean_errors(F.lit("**ANALYSIS:** x\n**VERDICT:** STAY")))) == 0


def test_reward_and_confidence(spark):
    text = F.lit("[2] so VERDICT: HOLD\n[1] VERDICT: stay")
    assert one(spark, X.numbered_verdicts(text, 3)) == ["STAY", "HOLD", None]
    assert one(spark, X.reward(X.numbered_verdicts(text, 2), F.array(F.lit("STAY"), F.lit("SWITCH")))) == 0.5
    p = one(spark, confidence.softmax(F.array(F.lit(4.0), F.lit(1.5), F.lit(0.5))))
    assert [round(x, 3) for x in p] == pytest.approx([0.899, 0.074, 0.027], abs=0.005) and sum(p) == pytest.approx(1)


def test_small_text_functions(spark):
    assert one(spark, X.replace_first(F.lit("a b a"), "a", "x")) == "x b a"
    assert one(spark, X.slugified(F.lit("Acme Flow!"))) == "acmeflow"
    assert one(spark, X.sentence_case(F.lit("ROI Threshold"))) == "Roi threshold"
    assert one(spark, X.without_placeholders(F.lit("Issues persist..  now"))) == "the incumbent issues remain unresolved. now"
    assert one(spark, X.json_between(F.lit('x {"a": [1,],} y')).cast("string")) == '{"a":[1]}'
    assert one(spark, X.polarity(F.lit("No mobile app"), "tool")) == "negative"
    assert one(spark, X.polarity(F.lit("New API"), "competitor")) == "positive"
    assert one(spark, X.polarity(F.lit("export in beta now"), "competitor")) == "pending"


def test_sections_of_many_lines(spark):
    """100,000 lines in time in proportion, with each line in the section that was begun last."""
    import time

    from sagebrush.functions.traces import sections

    lines = [("PUSH:", "PULL:", "END:")[i // 100 % 3] if i % 100 == 0 else f"- line {i}" if i % 3 else f"other {i}" for i in range(100_000)]
    name = lambda x: F.when(x == "PUSH:", "push").when(x == "PULL:", "pull").when(x == "END:", "")
    df = spark.createDataFrame([(["- before", *lines],), ([],)], "lines array<string>").cache()
    df.count()
    began = time.perf_counter()
    found = [[tuple(e) for e in r.s] for r in df.select(sections(F.col("lines"), name).alias("s")).collect()]
    assert time.perf_counter() - began < 30
    wanted, section = [], ""
    for x in lines:
        if x.endswith(":"):
            section = {"PUSH:": "push", "PULL:": "pull", "END:": ""}[x]
        elif section and x.startswith("- "):
            wanted.append((section, x[2:]))
    assert sorted(found, key=len) == [[], wanted]
