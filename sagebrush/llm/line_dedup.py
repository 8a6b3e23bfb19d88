"""Line dedup by winnowing: repeated runs of words, kept where they stand first.

Lines are units that the words themselves cut, since passages begin and end inside a text's own lines: of each ``CUT_WORDS``
neighbouring words the one with the smallest hash begins a line. So a line has ``CUT_WORDS`` words at most, and where it
is cut depends on less than ``CUT_WORDS`` words to either side. In each window of ``WINDOW_WORDS`` words, the lines that
the window's own words cut out, one at least, are hashed, and the line of the smallest hash is its fingerprint, told by
the line's words and the ``CUT_WORDS`` - 1 words to either side of it, which the window holds too. All this depends on
the window's words alone, so every repeated run of ``WINDOW_WORDS`` words or more has a fingerprint in common with its
copy; and a line that is common without its surroundings brings nothing together.

Fingerprints that stand once in all documents are left behind. The others are extended both ways, over all windows of
which they are the minimum, and these windows are joined by their content. Every window but the first of its content
is part of a later repeated run; neighbouring ones unite to the whole run. So a word is deleted if, and only if, some
window that holds it stands in an earlier document or earlier in its own. The first copy of each window stays, whatever
other places share its fingerprints.

Documents with equal texts are one, so that thousands of copies bring no windows of their own. Everything is grouped by
content with sums and minima that are combined before the shuffle, and joined by document only: a passage that stands
everywhere is no hot key.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, text_of

#: 4 * CUT_WORDS - 2 words at most, so that a window surely holds a whole line of its own.
CUT_WORDS, WINDOW_WORDS = 12, 50
#: Bases of the polynomials of lines and of windows.
LINE_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Spreads a sum over all bits.
MIX = np.uint64(0xD6E8FEB86659FD93)
TEXT_KEY = ["doc_id", "text_a", "text_b"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and where each text begins; its last number is the end."""
    words = [text.split() for text in texts]
    bounds = np.concatenate([[0], np.cumsum(list(map(len, words)), dtype=np.int64)])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, bounds[-1]), bounds


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


def run_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, n), dtype=np.uint64)])
    hashes = (total[length:] - total[:-length]) * powers(pow(base, -1, 1 << 64), n - length + 1)
    return (hashes ^ (hashes >> np.uint64(32))) * MIX


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` neighbours stands, the first of equal ones; widths double until two overlapping ones do."""
    at, done = np.arange(len(x), dtype=np.int32), 1
    while done < width:
        shift = min(done, width - done)
        left, right = at[:-shift], at[shift:]
        at = np.where(x[left] <= x[right], left, right)
        done += shift
    return at


def line_starts(words: np.ndarray, text_of_word: np.ndarray) -> np.ndarray:
    """Where lines begin: at the smallest of each ``CUT_WORDS`` neighbouring words of a text, the first of equal ones."""
    least = sliding_argmin(words * MIX, CUT_WORDS)
    return np.unique(least[text_of_word[: len(least)] == text_of_word[CUT_WORDS - 1 :]])


def part_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the words from each of ``low`` up to the one before each of ``high``."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(LINE_BASE, len(words)), dtype=np.uint64)])
    hashes = (total[high] - total[low]) * powers(pow(LINE_BASE, -1, 1 << 64), len(words))[low] + (high - low).astype(np.uint64)
    return (hashes ^ (hashes >> np.uint64(32))) * MIX


def least_of_ranges(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the smallest of x[low:high] stands, the first of equal ones, for each range, none of them empty.

    Two overlapping runs of a power of two fill a range; the runs of each power are made from those of the one before.
    """
    first = lambda a, b: np.where(x[a] <= x[b], a, b)
    power = np.frexp((high - low).astype(np.float64))[1] - 1
    out, best = np.zeros(len(low), np.int64), np.arange(len(x), dtype=np.int64)
    for p in range(int(power.max(initial=-1)) + 1):
        if p:
            best = first(best[: -(1 << p - 1)], best[1 << p - 1 :])
        here = np.flatnonzero(power == p)
        out[here] = first(best[low[here]], best[high[here] - (1 << p)])
    return out


def fingerprints(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each line that is smallest in some window of its text, with its surroundings; the first and last of these windows, and where each text's begin.

    Windows that reach over the end of a text are none. A window's own lines are those that begin and end where windows
    of ``CUT_WORDS`` words that lie in it alone decide on it.
    """
    if np.diff(bounds).max(initial=0) < WINDOW_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    text_of_word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text_of_word[: len(words) - WINDOW_WORDS + 1] == text_of_word[WINDOW_WORDS - 1 :])
    starts = line_starts(words, text_of_word)
    least = least_of_ranges(part_hashes(words, starts[:-1], starts[1:]), np.searchsorted(starts, inside + CUT_WORDS - 1), np.searchsorted(starts, inside + WINDOW_WORDS - CUT_WORDS, side="right") - 1)
    owner = text_of_word[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(least) != 0) | (np.diff(owner) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    lines, around = least[first], CUT_WORDS - 1
    hashes = part_hashes(words, starts[lines] - around, starts[lines + 1] + around)
    return hashes.view(np.int64), inside[first], inside[last], np.searchsorted(owner[first], np.arange(len(bounds)))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with text_a and text_b, two hashes of the text that together stand for it."""
    return docs.withColumn("text_a", F.xxhash64(text_of())).withColumn("text_b", F.xxhash64(F.lit(1), text_of()))


def document_marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_a, text_b, n_words and the lines (hashes) of the fingerprints, in their order."""

    def rows(ids: list, a: list, b: list, texts: list[str]) -> list:
        words, bounds = word_hashes(texts)
        lines, _, _, offsets = fingerprints(words, bounds)
        return [pa.array(ids, pa.int64()), a, b, np.diff(bounds).astype(np.int32), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lines))]

    return map_texts(keyed(docs), rows, "doc_id long, text_a long, text_b long, n_words int, lines array<long>", ids=tuple(TEXT_KEY))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """The windows of the fingerprints whose numbers are in the column ``marks``: lines and windows (hashes), starts."""

    def rows(ids: list, a: list, b: list, marks: list, texts: list[str]) -> list:
        words, bounds = word_hashes(texts)
        lines, first, last, offsets = fingerprints(words, bounds)
        some = np.concatenate([np.sort(np.array(x, np.int64)) + o for x, o in zip(marks, offsets, strict=False)])
        sizes = last[some] - first[some] + 1
        text = np.repeat(np.arange(len(texts)), list(map(len, marks))).repeat(sizes)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes - first[some], sizes)
        cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        columns = np.repeat(lines[some], sizes), run_hashes(words, WINDOW_WORDS, WINDOW_BASE)[at].view(np.int64), (at - bounds[text]).astype(np.int32)
        return [pa.array(ids, pa.int64()), a, b, *(pa.ListArray.from_arrays(cuts, pa.array(c)) for c in columns)]

    return map_texts(docs, rows, "doc_id long, text_a long, text_b long, lines array<long>, windows array<long>, starts array<int>", ids=(*TEXT_KEY, "marks"))


def united(starts: np.ndarray) -> list[int]:
    """The runs (start, end exclusive, in turn) that the windows at ``starts``, in order, fill."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > WINDOW_WORDS) + 1
    begins, ends = starts[np.concatenate([[0], breaks])], starts[np.concatenate([breaks - 1, [-1]])] + WINDOW_WORDS
    return np.column_stack([begins, ends]).ravel().tolist()


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_a, text_b, runs: the words (start, end exclusive, in turn) to delete. Rows with null doc_id take no part."""
    docs = docs.filter("doc_id is not null").select("doc_id", text_of().alias("text"))
    marks = scratch.keep(document_marks(docs).filter(F.size("lines") > 0), "marks")
    # Of equal texts, the one with the smallest doc_id stands for all; the others are repeated from first to last word.
    first = marks.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("doc_id"))
    alone = scratch.keep(marks.join(first.hint("merge"), TEXT_KEY, "left_semi"), "alone")
    copies = marks.join(first.hint("merge"), TEXT_KEY, "left_anti").select(*TEXT_KEY, F.array(F.lit(0), "n_words").alias("runs"))

    each = alone.select(*TEXT_KEY, F.posexplode("lines").alias("mark", "line"))
    # A line that stands once is told by where it stands: the minimum of one place is that place.
    once = each.groupBy("line").agg(F.count(F.lit(1)).alias("places"), *(F.min(c).alias(c) for c in (*TEXT_KEY, "mark"))).filter("places = 1")
    once = once.groupBy(*TEXT_KEY).agg(F.collect_list("mark").alias("once"))
    marked = alone.join(once.hint("merge"), TEXT_KEY, "left").select(*TEXT_KEY, F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("once", F.array().cast("array<int>"))).alias("marks"))
    marked = scratch.keep(marked.filter(F.size("marks") > 0).distinct(), "marked")
    windows = scratch.keep(repeated_windows(keyed(docs).join(marked.hint("merge"), TEXT_KEY)), "windows")

    # The first document of each window; in it, and in no other, the window stays.
    own = windows.select("doc_id", F.explode(F.arrays_zip("lines", "windows")).alias("w")).groupBy("w.lines", "w.windows").agg(F.min("doc_id").alias("doc_id"))
    own = own.groupBy("doc_id").agg(F.collect_list("windows").alias("own"))

    def later(batches):
        for batch in batches:
            runs = []
            for hashes, starts, mine in zip(*(batch.column(c) for c in ("windows", "starts", "own")), strict=True):
                hashes, starts = np.array(hashes.values), np.array(starts.values)
                again = ~np.isin(hashes, np.array(mine.values)) if mine.is_valid else np.ones(len(hashes), bool)
                # Windows stand in order, so the first of equal ones is the earliest.
                again[np.setdiff1d(np.arange(len(hashes)), np.unique(hashes, return_index=True)[1])] = True
                runs.append(united(starts[again]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TEXT_KEY), pa.array(runs, pa.list_(pa.int32()))], names=[*TEXT_KEY, "runs"])

    found = windows.drop("lines").join(own.hint("merge"), "doc_id", "left").mapInArrow(later, "doc_id long, text_a long, text_b long, runs array<int>")
    return found.filter(F.size("runs") > 0).union(copies).dropDuplicates(TEXT_KEY)


def line_bounds(text: str) -> np.ndarray:
    """The number of words before each line, and of all words."""
    return np.concatenate([[0], np.cumsum([len(x.split()) for x in text.split("\n")])])


def cut(text: str, runs: list[int], inside_lines: bool) -> tuple[str, int, int]:
    """``text`` without the words of ``runs``, the number of lines that go whole, and the number of words that go.

    A line goes if all its words do, a blank one if it lies inside a run. Other lines stay as they are, unless
    ``inside_lines`` is set: then what is left of them stays, with the white space on one side of a gap.
    """
    lines = text.split("\n")
    bounds = line_bounds(text)
    gone, inside = np.zeros(bounds[-1], bool), np.zeros(bounds[-1] + 1, bool)
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        gone[s:e] = True
        inside[s + 1 : e] = True
    left, n_words = [], 0
    for line, s, e in zip(lines, bounds, bounds[1:], strict=False):
        n = int(gone[s:e].sum())
        if n == e - s if e > s else inside[s]:
            n_words += n
            continue
        if inside_lines and n:
            line = without_words(line, gone[s:e])
            n_words += n
        left.append(line)
    return "\n".join(left), len(lines) - len(left), n_words


def without_words(line: str, gone: np.ndarray) -> str:
    out, at = [], 0
    for word, g in zip(line.split(), gone, strict=True):
        start = line.index(word, at)
        end = start + len(word)
        if not g:
            # After a gap, the white space before the word stays only if nothing stands before it.
            out.append(line[at:end])
        elif not out:
            out.append(line[at:start])
        at = end
    if not gone[-1]:
        out.append(line[at:])
    text = "".join(out)
    return text.lstrip() if gone[0] else text


def without_repeats(docs: DataFrame, inside_lines: bool = False) -> DataFrame:
    """``docs`` with all its columns, later repeated runs of words deleted from text; adds n_lines, n_deleted and n_words_deleted.

    With ``inside_lines`` all words of the runs go, and what else the lines hold in which a run begins or ends stays;
    without it only the whole lines of the runs go. n_deleted counts the lines that go whole, n_words_deleted the words.

    Order is by doc_id, then by word. Rows of one doc_id are not earlier than each other, be their texts equal or not:
    what they share stays in all of them, unless it stands in an earlier document. Rows with null doc_id and null or
    empty texts stay as they are (nothing deleted; a null text has 0 lines). A text may become empty. Columns with the
    names of the added ones are replaced. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    runs = scratch.keep(repeated_runs(docs, scratch), "runs")
    scratch.drop("marks", "alone", "marked", "windows")
    given = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_words_deleted")]

    @F.pandas_udf("text string, n long, words long")
    def shortened(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(t, 0, 0) if r is None else cut(t, r, inside_lines) for t, r in zip(texts, runs, strict=True)], columns=["text", "n", "words"])

    # A row travels as one column, so that no name of its own meets a name of the runs. The runs grow with the
    # documents; always merging keeps one plan for all sizes.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_a"), F.xxhash64(F.lit(1), text_of()).alias("text_b"))
    joined = rows.join(runs.select(*TEXT_KEY, "runs").hint("merge"), TEXT_KEY, "left").select("row", "runs")
    some, old = F.col("runs").isNotNull(), F.col("row")["text"]
    joined = joined.withColumn("left", shortened(F.when(some, old), F.col("runs")))
    text = F.when(some, F.col("left.text")).otherwise(old)
    size = F.when(old.isNull(), 0).otherwise(F.size(F.split(old, "\n", -1))).cast("long")
    count = lambda c: F.when(some, F.col(f"left.{c}")).otherwise(0).cast("long")
    return joined.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in given), size.alias("n_lines"), count("n").alias("n_deleted"), count("words").alias("n_words_deleted"))
