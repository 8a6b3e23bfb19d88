"""Quality rules as a short-circuit cascade.

A rule rejects a text by a few counts of it. Rules differ in what they cost and in how many texts they reject, and a text
needs no further rule once one rejects it. So each rule's cost and the texts that it rejects are measured on a sample,
and the rules are ordered greedily: next comes the one that rejects most per second among the sample's texts that all
rules before it let pass. The order changes the time only, never the verdict: a text is kept if no rule rejects it.

Counts are made when the first rule asks for them, and once for a text.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_of

WINDOW_WORDS, LEAST_WORDS = 5, 10
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A word of ASCII signs only.
BARE = re.compile(rb"[!-/:-@\[-`{-~]+")
#: Rows of the sample that costs and rejections are measured on, about.
SAMPLE_ROWS = 2_000


class Facts:
    """Counts of one text, made on demand. Words are parted by ASCII white space."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines, parted by \\n, that hold a word."""
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in runs of ``WINDOW_WORDS`` words that stand twice or more in the text."""
        n = self.n_words - WINDOW_WORDS + 1
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        # Numbers of ever longer runs: a run is told by the number of its beginning and its last word.
        runs = ids
        for k in range(1, WINDOW_WORDS):
            runs = np.unique(runs[: len(runs) - 1] * len(number) + ids[k:], return_inverse=True)[1]
        again = np.flatnonzero(np.bincount(runs)[runs] > 1)
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW_WORDS, -1)
        return int((np.cumsum(edge) > 0).sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LOWER))

    @cached_property
    def n_bare(self) -> int:
        return sum(BARE.fullmatch(w) is not None for w in self.words)

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word stands."""
        return max(Counter(self.words).values(), default=0)


#: Rules by name: whether a text is rejected. The first two are the base.
RULES: dict[str, Callable[[Facts], bool]] = {
    "short": lambda f: f.n_words < LEAST_WORDS,
    "repeats": lambda f: 100 * f.n_repeat_words > 20 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "shouting": lambda f: 100 * f.n_upper > 30 * (f.n_upper + f.n_lower),
    "exclaims": lambda f: 10 * f.text.count("!") > f.n_words,
    "word_length": lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words,
    "bare_words": lambda f: 10 * f.n_bare > f.n_words,
    "same_lines": lambda f: 2 * f.n_dup_lines > len(f.lines),
    "same_word": lambda f: 100 * f.top_word > 30 * f.n_words,
}
BASE = ("short", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Estimate(NamedTuple):
    """A rule's place in the cascade: seconds for a text, and the share of the texts before it that it rejects."""

    rule: str
    cost: float
    rejects: float


def measured(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """mask, texts and the seconds of each rule: how many texts of a sample are rejected by the rules whose bits are in mask.

    The sample is drawn in the JVM before texts go to Python; of ``docs`` it takes about ``rows`` rows. Each rule is
    timed with counts of its own, as if it came first. One row for each mask that occurs, 2 ** rules at most.
    """
    share = min(1.0, rows / max(docs.count(), 1))

    def timed(_: list, texts: list[str]) -> list:
        masks, seconds = [], {r: [] for r in RULES}
        for text in texts:
            mask = 0
            for bit, (name, rule) in enumerate(RULES.items()):
                began = time.perf_counter()
                mask |= bool(rule(Facts(text))) << bit
                seconds[name].append(time.perf_counter() - began)
            masks.append(mask)
        return [masks, *seconds.values()]

    picked = docs.sample(False, share, seed=11) if share < 1 else docs
    found = map_texts(picked, timed, ", ".join(["mask int", *(f"{r} double" for r in RULES)]))
    return found.groupBy("mask").agg(F.count(F.lit(1)).alias("texts"), *(F.sum(r).alias(r) for r in RULES))


def ordered(measures: list) -> list[Estimate]:
    """All rules, by rejections per second among the sample's texts that the earlier ones let pass; ties by name.

    Without a sample the rules stand in the order of ``RULES``.
    """
    texts = sum(m["texts"] for m in measures)
    if not texts:
        return [Estimate(r, 0.0, 0.0) for r in RULES]
    cost = {r: max(sum(m[r] for m in measures) / texts, 1e-9) for r in RULES}
    bit = {r: 1 << i for i, r in enumerate(RULES)}
    left, out = list(measures), []
    while len(out) < len(RULES):
        n = sum(m["texts"] for m in left)
        share = {r: sum(m["texts"] for m in left if m["mask"] & bit[r]) / max(n, 1) for r in RULES if r not in {e.rule for e in out}}
        best = min(share, key=lambda r: (-share[r] / cost[r], cost[r], r))
        out.append(Estimate(best, cost[best], share[best]))
        left = [m for m in left if not m["mask"] & bit[best]]
    return out


def cascade(docs: DataFrame) -> list[Estimate]:
    """The rules in the order that a sample of ``docs`` suggests."""
    return ordered(measured(docs).collect())


def judged(docs: DataFrame, order: list[str] | None = None, counts: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, kept, failed (the rule that rejected it, null if kept), n_tried.

    ``order`` names the rules in the order they are tried, by default that of :func:`cascade`; kept doesn't depend on
    it, failed and n_tried do. ``counts`` adds ``COUNTS`` and base_failed, for which every text is counted whole.
    Null texts count as empty: 0 words, rejected as short. Null and repeated ids are kept, each row by itself. Other
    columns are not read. No rows give no rows. No shuffle.
    """
    order = order or [e.rule for e in cascade(docs)]

    def rows(ids: list, texts: list[str]) -> list:
        out = []
        for text in texts:
            facts = Facts(text)
            tried, failed = 0, None
            for tried, name in enumerate(order, 1):
                if RULES[name](facts):
                    failed = name
                    break
            told = (*(getattr(facts, c) for c in COUNTS), any(RULES[b](facts) for b in BASE)) if counts else ()
            out.append((failed is None, failed, tried, *told))
        columns = list(zip(*out, strict=True))
        return [pa.array(ids, pa.int64()), *map(list, columns)]

    extra = "".join(f", {c} long" for c in COUNTS) + ", base_failed boolean" if counts else ""
    return map_texts(docs, rows, "doc_id long, kept boolean, failed string, n_tried int" + extra)


def only_kept(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``docs`` with all its columns, without the rows that a rule rejects."""
    order = order or [e.rule for e in cascade(docs)]

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        facts = map(Facts, texts)
        return pd.Series([not any(RULES[r](f) for r in order) for f in facts], dtype=bool)

    return docs.filter(passes(text_of()))
