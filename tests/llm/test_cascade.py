"""The cascade of quality rules against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from sagebrush.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple:
    """Counts, base_failed and kept, each by its definition."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    held = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    n, chars = len(w), sum(map(len, w))
    signs = sum(c in "#*$%&|<>" for c in text)
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    base = n < 10 or 100 * len(held) > 20 * n
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    bare = sum(all(33 <= ord(c) < 127 and not c.isalnum() for c in x) for x in w)
    bad = [10 * signs > n, 100 * upper > 30 * (upper + lower), 10 * text.count("!") > n, chars < 2 * n or chars > 15 * n, 10 * bare > n, 2 * dup > len(lines), 100 * max(Counter(w).values(), default=0) > 30 * n]
    return n, chars, signs, dup, len(held), base, not (base or any(bad))


def texts() -> list:
    rng = random.Random(2)
    words = ["one", "two", "THREE", "é", "漢字", "a|b", "***", "!!", "extraordinarilylongword", "x", "five,", " wide"]
    gaps = [" ", " ", " ", "\n", "\t", "\r\n", "\v", "  "]
    made = ["".join(rng.choice(words[: rng.choice([3, 6, 12])]) + rng.choice(gaps) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    fine = " ".join(f"word{i}x" for i in range(40))
    return [None, "", " \n ", "a a a a a a", fine, fine + "\n" + fine, "line of words here\n" * 8 + fine, *made, "w " * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "one two", "x", 1), (4, "one", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def test_counts_and_verdicts(docs):
    found = rules.judged(docs, counts=True).collect()
    wanted = sorted((-1 if r.doc_id is None else r.doc_id, *plain(r.text)) for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed, r.kept) for r in found) == wanted
    assert {w[-1] for w in wanted} == {True, False}


def test_order_changes_no_verdict(docs):
    names = list(rules.RULES)
    one, other = ({(r.doc_id, r.kept) for r in rules.judged(docs, order).collect()} for order in (names, names[::-1]))
    assert one == other
    assert {r.failed for r in rules.judged(docs, names).collect()} >= {None, "short", "repeats"}
    kept = rules.only_kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in one if k}


def test_order_by_rejection_per_cost():
    """First the best share per second; then the best among what is left, though another rejects more of the whole sample."""
    bit = {r: 1 << i for i, r in enumerate(rules.RULES)}
    cost = dict.fromkeys(rules.RULES, 10.0) | {"symbols": 1.0, "exclaims": 1.0, "shouting": 2.0}
    row = lambda mask, n: {"mask": mask, "texts": n} | {r: c * n for r, c in cost.items()}
    measures = [row(bit["symbols"] | bit["exclaims"], 50), row(bit["shouting"], 20), row(bit["exclaims"], 1), row(0, 29)]
    order = [e.rule for e in rules.ordered(measures)]
    assert order[:3] == ["exclaims", "shouting", "symbols"] and sorted(order) == sorted(rules.RULES)
    first, second = rules.ordered(measures)[:2]
    assert first.rejects == 51 / 100 and second.rejects == 20 / 49 and second.cost == 2.0
    assert [e.rule for e in rules.ordered([])] == list(rules.RULES)


def test_measured_on_a_sample(docs):
    found = rules.measured(docs).collect()
    assert sum(r.texts for r in found) == docs.count() and all(r[x] > 0 for r in found for x in rules.RULES)
    names = list(rules.RULES)
    for r in docs.collect():
        facts = rules.Facts(r.text or "")
        mask = sum(rules.RULES[n](facts) << i for i, n in enumerate(names))
        assert any(m["mask"] == mask for m in found)
    assert sum(r.texts for r in rules.measured(docs, rows=30).collect()) < docs.count() / 2


def test_no_rows(docs):
    assert rules.judged(docs.limit(0), counts=True).count() == 0 and rules.only_kept(docs.limit(0)).count() == 0
