"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = m // ``CHARS_PER_EDIT`` edits. Cut into k + 1 pieces, at least one
piece then stands unchanged. So the pieces of all items go into one automaton, which finds every exact piece hit of a
text in a single pass; around each hit, Myers' bit-parallel algorithm computes the edit distance. Nothing within the
budget is missed, and nothing beyond it is reported.

Pieces are paired. Of the pairs (and a last single piece) at least one has fewer edits than pieces, so a pair in which a
piece stands unchanged has one edit at most in its other piece, of which then one half stands unchanged too, shifted by
one place at most. Hits whose partner has no such half are left out before any distance is computed; so a phrase that
many items share costs each of them two comparisons.

Items and texts are compared as words between spaces, so an item isn't found inside longer words but by edits.

The items are a stated set of queries, taken in blocks of ``BLOCK_CHARS`` at most (or one longer item), each with a pass
over the documents. One block at a time is in the driver and broadcast, so that memory is bounded whatever the number of
items; its results are written before the next one comes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, text_of

CHARS_PER_EDIT = 16
BLOCK_CHARS = 2_000_000
WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Lower-cased words joined by single spaces; whatever isn't a letter or digit parts words."""
    return " ".join(WORD.findall(text.lower()))


def budget(item: str) -> int:
    """The edits k that an item may have; the spaces around it don't count as its characters."""
    return len(item.strip()) // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, int]]:
    """Starts and ends of the k + 1 pieces of an item."""
    n = budget(item) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def partner(item: str, cuts: list[tuple[int, int]], i: int) -> tuple[str, int, str, int, int] | None:
    """What must stand beside a hit of piece ``i``; None for a piece without a partner.

    Either the partner's near half where it belongs, or its far half, shifted by one place at most. Places are relative
    to the last character of the hit.
    """
    j = i ^ 1
    if j >= len(cuts):
        return None
    start, end = cuts[j]
    middle = (start + end) // 2
    if j > i:
        at = 1
        return item[start:middle], at, item[middle:end], at + middle - start - 1, at + end - start + 1
    at = 1 - (cuts[i][1] - cuts[i][0])
    return item[middle:end], at - (end - middle), item[start:middle], at - (end - start) - 1, at - (end - middle) + 1


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and the smallest end of such a part.

    The part may begin anywhere, or only at the start of ``text`` if ``anchored``. One machine step handles all rows
    of the distance matrix: bits of Python's integers are its vertical differences.
    """
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    ones, top = (1 << m) - 1, 1 << m - 1
    up, down, score = ones, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ones & ~(x | up), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & ones | anchored
        minus = minus << 1 & ones
        x = eq | down
        up, down = minus | ones & ~(x | plus), plus & x
        if score < best[0]:
            best = (score, j)
    return best


class Matcher:
    """Finds items in texts. Items without letters or digits match nothing."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, f" {s} ") for i, t in items if (s := normal(t or ""))]
        found: dict[str, list[tuple[int, int, tuple | None]]] = defaultdict(list)
        for n, (_, s) in enumerate(self.items):
            cuts = pieces(s)
            for i, (start, end) in enumerate(cuts):
                found[s[start:end]].append((n, end, partner(s, cuts, i)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best place of each item; positions in ``text``, of whole words.

        Best is the fewest edits, then the smallest end.
        """
        if not self.items:
            return []
        plain = f" {normal(text)} "
        begins = defaultdict(set)
        for last, places in self.automaton.iter(plain):
            for n, end, near in places:
                if near is None or (plain.startswith(near[0], last + near[1]) or plain.find(near[2], max(0, last + near[3]), max(0, last + near[4])) >= 0):
                    begins[n].add(last + 1 - end)
        out = []
        for n, starts in begins.items():
            item_id, item = self.items[n]
            m, k = len(item), budget(item)
            best, window = None, None
            for s in [*sorted(starts), None]:
                if window and (s is None or s - k > window[1]):
                    low, high = max(0, window[0]), min(len(plain), window[1])
                    if (exact := plain.find(item, low, high)) >= 0:
                        edits, end = 0, exact + m
                    else:
                        edits, end = myers(item, plain[low:high])
                        end += low
                    if edits <= k and (best is None or edits < best[0]):
                        best = (edits, end)
                    window = None
                if s is not None:
                    window = (window[0] if window else s - k, s + m + k)
            if best:
                edits, end = best
                _, length = myers(item[::-1], plain[max(0, end - m - k) : end][::-1], anchored=True)
                start = end - length
                start += len(plain[start:end]) - len(plain[start:end].lstrip())
                out.append((item_id, edits, start - 1, len(plain[:end].rstrip()) - 1))
        return self.in_words(text, out) if out else out

    @staticmethod
    def in_words(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        lower = text.lower()
        words = list(WORD.finditer(lower))
        offsets = [0, *accumulate(len(w[0]) + 1 for w in words)]
        word_at = lambda p: min(bisect_right(offsets, p) - 1, len(words) - 1)
        place = (lambda p: p) if len(lower) == len(text) else (lambda p: len_before(text, p))
        return [(i, e, place(words[word_at(s)].start()), place(words[word_at(max(s, t - 1))].end())) for i, e, s, t in sorted(found)]


def len_before(text: str, p: int) -> int:
    """Characters of ``text`` whose lower-case forms fill ``p`` characters."""
    done = 0
    for i, c in enumerate(text):
        if done >= p:
            return i
        done += len(c.lower())
    return len(text)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, each once, in blocks by a hash of id and text; each block is collected when it is asked for.

    Only a single item longer than ``BLOCK_CHARS`` makes a longer block.
    """
    items = items.select(F.col("item_id").alias("id"), text_of().alias("text")).filter("id is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    block = lambda: F.pmod(F.xxhash64("id", "text"), F.lit(n))
    while not items.groupBy(block().alias("b")).agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).filter(f"chars > {BLOCK_CHARS} and n > 1").isEmpty():
        n *= 2
    for b in range(n):
        yield [(r.id, r.text) for r in items.filter(block() == b).toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that meet: doc_id, item_id, edits, start, end.

    Rows of items with the same item_id and text are one item; those with the same item_id and other texts are told each.

    Text and items are compared as lower-cased words, see :func:`normal`; start and end are the best place in the
    text, in characters. Null and empty texts and items match nothing; rows with null item_id take no part; those
    with null or repeated doc_id are told each by itself. Other columns are not read. No rows on either side give no
    rows. No shuffle.
    """
    spark, out = docs.sparkSession, None
    scratch = Scratch(spark, "leaks")
    for b, block in enumerate(item_blocks(items)):
        shared = spark.sparkContext.broadcast(block)

        def rows(ids: list, texts: list[str], shared=shared) -> list:
            matcher = matcher_of(shared)
            found = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in matcher.find(t)]
            return [pa.array([f[c] for f in found], pa.int64()) for c in range(5)]

        part = scratch.keep(map_texts(docs, rows, "doc_id long, item_id long, edits long, start long, end long"), f"block-{b}")
        shared.unpersist()
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows in which an item occurs. Null texts stay."""
    scratch, shared = Scratch(docs.sparkSession, "clean"), None
    for b, block in enumerate(item_blocks(items)):
        if shared is not None:
            docs = scratch.keep(docs, f"block-{b}")
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.filter(clean_by(shared)(text_of()))
    return docs


def clean_by(shared):
    """Whether no item of a broadcast block occurs in a text."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        matcher = matcher_of(shared)
        return pd.Series([not matcher.find(t) for t in texts], dtype=bool)

    return clean


_LAST: list = [None, None]


def matcher_of(shared) -> Matcher:
    """A worker's matcher of a broadcast block, built once; only the last one is kept."""
    block = shared.value
    if _LAST[0] is not block:
        _LAST[:] = [block, Matcher(block)]
    return _LAST[1]
