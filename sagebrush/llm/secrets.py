"""Secret scans with DataFrame functions only: known shapes, and strings of high entropy.

Known shapes are regular expressions. Other candidates are long runs of key characters that mix letters and digits.
A window slides over each. One character leaves and one enters at a time, and each of them changes one count and the
sum of c * log2(c) over all counts, so a step costs the same wherever it is, and a candidate's time is in proportion to
its length. The counts are the characters of a string, one for each letter of the alphabet, of which a step overlays
one. A candidate is a secret if a window's Shannon entropy reaches the threshold of the candidate's character class and
no allow-listed pattern fits it.

Everything is an expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush.functions.arrays import running_max, running_sum
from sagebrush.functions.text import let

from .common import text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of at least so many characters is what the unbounded pattern finds and its length test keeps.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a window must reach, by the candidate's character class.
THRESHOLDS = {"hex": 3.0, "base64": 3.7}
#: Candidates that look random but aren't secret: UUIDs, placeholders, runs of one character, counting.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|your[_-]?(api)?[_-]?key",
    r"(.)\1{5,}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
]
KINDS = ["assign", "access", "hex", "entropy"]
#: The character that stands for a count of 0.
ZERO = 48


def found_spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost matches, one after another, as structs (start, rank, end) in code points, without those that fail ``keep``.

    What lies between the matches and the matches themselves alternate, so positions are running sums of lengths.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")

    def placed(x: Column) -> Column:
        def span(p: Column, end: Column) -> Column:
            return F.struct((end - F.length(p["match"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), p["match"].alias("match"))

        ends = running_sum(F.transform(x, lambda p: p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0))))
        return let(ends, lambda at: F.transform(x, lambda p, i: span(p, F.get(at, i))))

    good = F.filter(let(pairs, placed), lambda s: s["match"].isNotNull() if keep is None else s["match"].isNotNull() & keep(s["match"]))
    return F.when(text.rlike(pattern), F.transform(good, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "end"))))).otherwise(none)


def without_inner(base: Column, entropy: Column) -> Column:
    """All spans in their order, without those of kind entropy that lie within one of ``base``.

    Such a span begins earlier, or at the same place, so what counts is the furthest end among the known spans so far.
    """
    random = KINDS.index("entropy")

    def told(spans: Column) -> Column:
        reach = running_max(F.transform(spans, lambda s: F.when(s["rank"] != random, s["end"])))
        return let(reach, lambda ends: F.filter(spans, lambda s, i: (s["rank"] != random) | (s["end"] > F.coalesce(F.get(ends, i), F.lit(0)))))

    return let(F.array_sort(F.concat(base, entropy)), told)


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` neighbouring characters; 0 for a shorter candidate."""
    weights = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.lit(chr(ZERO) * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("size"), F.lit(0.0).alias("peak"))

    def step(state: Column, moved: Column) -> Column:
        """``moved``: the letter that enters, or minus the one that leaves."""
        letter, change = F.abs(moved), F.signum(moved).cast("int")
        n = F.ascii(F.substring(state["counts"], letter, F.lit(1))) - ZERO
        total = state["sum"] + F.element_at(weights, n + change + 1) - F.element_at(weights, n + 1)
        size = state["size"] + change
        bits = F.when(size == window, math.log2(window) - total / window).otherwise(0.0)
        counts = F.overlay(state["counts"], F.char(n + change + ZERO), letter, F.lit(1))
        return F.struct(counts.alias("counts"), total.alias("sum"), size.alias("size"), F.greatest(state["peak"], bits).alias("peak"))

    def fold(codes: Column) -> Column:
        moves = F.flatten(F.transform(codes, lambda c, i: F.when(i >= window, F.array(-F.get(codes, i - window), c)).otherwise(F.array(c))))
        return F.aggregate(moves, start, step, lambda state: state["peak"])

    return let(codes, fold)


def is_random(candidate: Column) -> Column:
    mixes = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    least = F.when(candidate.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).otherwise(THRESHOLDS["base64"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    # Sums of logarithms are rounded, so that a window right at the threshold doesn't depend on the order of its steps.
    return F.when(mixes & ~allowed, F.round(peak_entropy(candidate), 9) >= least).otherwise(False)


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order of ``KINDS``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    n_* count the known shapes; base_sha256 hashes their spans; spans also has those of kind entropy. An entropy span
    that lies within a known one isn't told again. Offsets are code points, ends exclusive. A null or empty text has
    no spans: counts 0, an empty string, and the hash of the empty string. Null and repeated ids are kept, each row
    by itself. Other columns are not read; no rows give no rows.
    """
    text = F.col("text")
    long_key = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    rows = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id",
        found_spans(text, ASSIGN, "assign", long_key).alias("assign"),
        found_spans(text, ACCESS, "access").alias("access"),
        found_spans(text, HEX, "hex").alias("hex"),
        found_spans(text, CANDIDATE, "entropy", is_random).alias("entropy"),
    )
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("all", without_inner(F.col("base"), F.col("entropy")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("all")).alias("spans"))
