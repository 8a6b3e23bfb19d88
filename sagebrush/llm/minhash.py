"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

1. Each text becomes its set of distinct word shingles, hashed to 64 bits. One permutation deals the set over
   ``BINS`` bins; an empty bin borrows from a full one by a fixed probing order (optimal densification). ``ROWS``
   bins make a band: two documents meet in a bucket if all bins of a band agree.
2. Documents with equal sets are one class, so copies cost one sketch, not a pair each.
3. In each bucket the smallest document, the centre, is compared with the other members: a star, not all pairs. Links
   are confirmed on the full shingle sets, by counts and without estimates.
4. A star alone would lose links between members that aren't linked with the centre. Buckets whose other members are
   all in one component by then are finished. Members of the others are decided exactly: at the similarity t, linked
   documents of n shingles share one of their first n - ceil(t * n) + 1, in any order fixed for all, and after the
   first shared one enough shingles must be left for the intersection. With rare shingles first, a passage that
   thousands of documents share brings few of them together. The buckets of these shingles get stars too, of as many
   centres as keep all pairs below a fixed number a document; a bucket with no more members than that is decided whole,
   at once. Centres are taken out, and buckets that still hold two components get new centres, each round many times as
   many, until there are none. New links join the components found before, without going over the old links again.

A pair at similarity 0.75 shares no bucket with probability 1 - (1 - 0.75 ** 4) ** 32, or 5 in a million, falling fast
above that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, text_of
from .components import connected_components, joined_components

WORDS = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: For each bin, the order in which it looks for a full one when empty: itself, then a fixed shuffle of all.
PROBES = np.array([[i, *np.random.default_rng(i).permutation(BINS)] for i in range(BINS)])
EDGES = np.arange(BINS + 1, dtype=np.uint64)[:-1] << np.uint64(64 - BINS.bit_length() + 1)
#: Standard deviations by which an estimate may fall short before a candidate is dropped unconfirmed.
SLACK = 6.0
CENTRES_GROWTH = 64
#: Pairs for each document of the input that a round may make without asking for more than its least number of centres.
PAIRS_A_DOCUMENT = 64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles: A-Z lower-cased, words parted by ASCII white space.

    A text of fewer than ``WORDS`` words is one shingle; a text without words is the empty set.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * MIX[i]
    return np.unique(mixed(total))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bucket keys of the bands, and one byte for each bin to estimate similarity by."""
    at = np.searchsorted(shingles, EDGES)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((first >> np.uint64(64 - BINS.bit_length() + 1)) == np.arange(BINS, dtype=np.uint64))
    source = PROBES[np.arange(BINS), full[PROBES].argmax(axis=1)]
    values = mixed(first[source])
    bands = values.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[4]
    for r in range(ROWS):
        keys = mixed(keys + bands[:, r] * MIX[r])
    return keys.view(np.int64), (values >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (hashes of the set; null if empty), keys (of the bands), bins."""

    def rows(ids: list, texts: list[str]) -> list:
        n, a, b, keys, bins, sizes = [], [], [], [], [], [0]
        for text in texts:
            s = shingle_set(text)
            n.append(len(s))
            sizes.append(sizes[-1] + BANDS * bool(len(s)))
            if not len(s):
                a.append(None), b.append(None), bins.append(None)
                continue
            digest = xxhash.xxh3_128_intdigest(s.tobytes())
            a.append((digest >> 64) - (1 << 63)), b.append((digest & (1 << 64) - 1) - (1 << 63))
            k, sig = sketch(s)
            keys.append(k), bins.append(sig)
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        return [pa.array(ids, pa.int64()), n, a, b, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), bins]

    return map_texts(docs, rows, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, bins binary")


@F.pandas_udf(T.BooleanType())
def may_link(bins_a: pd.Series, bins_b: pd.Series, n_a: pd.Series, n_b: pd.Series, percent: pd.Series) -> pd.Series:
    """False only if the sketches agree so little that a link is out of the question."""
    if not len(bins_a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (bins_a, bins_b))
    least = percent.to_numpy() / 100
    full = BINS * (1 - np.exp(-np.minimum(n_a, n_b).to_numpy() / BINS))
    return pd.Series((x == y).mean(axis=1) >= least - SLACK * np.sqrt(least * (1 - least) / full))


@F.pandas_udf(T.BooleanType())
def linked(text_a: pd.Series, text_b: pd.Series, percent: pd.Series) -> pd.Series:
    """Whether the full shingle sets of two texts reach the similarity."""
    out, last, kept = [], None, np.zeros(0, np.uint64)
    for a, b, least in zip(text_a, text_b, percent, strict=True):
        if a != last:
            last, kept = a, shingle_set(a)
        other = shingle_set(b)
        both = len(np.intersect1d(kept, other, assume_unique=True))
        out.append(100 * both >= least * (len(kept) + len(other) - both))
    return pd.Series(out, dtype=bool)


def star_centres(buckets: DataFrame, count: int) -> DataFrame:
    """All members of buckets of up to ``count``; as many of larger ones, spread over them by a hash of their ids.

    Members of the bucket's rarest component come first, then small ids: a lone document in a bucket full of one
    component is decided against all of it at once.
    """
    share = buckets.groupBy("key", "label").agg(F.count(F.lit(1)).alias("share"))
    rare = share.groupBy("key").agg(F.min(F.struct("share", "label")).getField("label").alias("rare"), F.sum("share").alias("size"))
    salt = F.when(F.col("size") <= count, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(count)))
    placed = buckets.join(rare, "key").withColumn("salt", salt)
    first = F.min(F.struct((F.col("label") != F.col("rare")).alias("common"), "id", "label", "n", "pos"))
    return placed.groupBy("key", "salt").agg(first.alias("c")).select("key", "c.id", "c.label", "c.n", "c.pos")


def centres_that_fit(buckets: DataFrame, documents: int, least: int) -> int:
    """The most centres a bucket for which all buckets together make at most ``PAIRS_A_DOCUMENT`` pairs a document.

    It is ``least`` at least. What a round makes so grows with the input, whatever the sizes of the buckets.
    """
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    able = [least << k for k in range(1, 21)]
    sums = sizes.agg(*[F.sum(F.col("size") * F.least("size", F.lit(c))).alias(str(c)) for c in able]).first()
    return max([least, *(c for c in able if (sums[str(c)] or 0) <= PAIRS_A_DOCUMENT * documents)])


def star_pairs(buckets: DataFrame, centres: DataFrame, percent: int, placed: bool) -> DataFrame:
    """Pairs (a < b) of a centre and a member of its bucket that aren't in one component and whose sizes allow a link.

    If ``placed``, pos is the bucket's shingle's place in the document, and what follows it must allow the link too.
    """
    able = f"m.key = c.key and m.label != c.label and 100 * least(m.n, c.n) >= {percent} * greatest(m.n, c.n)"
    if placed:
        able += f" and {100 + percent} * least(m.n - m.pos, c.n - c.pos) >= {percent} * (m.n + c.n)"
    pairs = buckets.alias("m").join(centres.alias("c"), F.expr(able))
    return pairs.select(F.least("m.id", "c.id").alias("a"), F.greatest("m.id", "c.id").alias("b")).distinct()


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: those whose sketches allow it, confirmed on the full sets."""
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bins").alias(f"bins_{side}")), side)
    pairs = pairs.filter(may_link("bins_a", "bins_b", "n_a", "n_b", F.lit(percent))).select("a", "b")
    for side in "ba":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.filter(linked("text_a", "text_b", F.lit(percent))).select("a", "b").distinct()


def open_buckets(buckets: DataFrame, centres: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets without their centres and with new labels, as far as they hold two components."""
    left = buckets.drop("label").join(centres.select("key", "id"), ["key", "id"], "left_anti")
    left = left.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    still = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    return left.join(still, "key", "left_semi")


def rare_shingle_buckets(left: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Buckets (key, id, n, label, pos) of the first shingles, rarest first, of the documents in ``left``."""
    members = scratch.keep(left.select(F.col("id").alias("doc_id"), "n", "label").distinct(), "members")

    def rows(ids: list, sizes: list, labels: list, texts: list[str]) -> list:
        sets = [shingle_set(t).view(np.int64) for t in texts]
        owner = np.repeat(np.arange(len(ids)), list(map(len, sets)))
        return [np.concatenate(sets), *(pa.array(np.array(c, np.int64)[owner]) for c in (ids, sizes, labels))]

    spread = scratch.keep(map_texts(texts.join(members, "doc_id"), rows, "key long, id long, n long, label long", ids=("doc_id", "n", "label")), "shingles")
    common = scratch.keep(spread.groupBy("key").agg(F.count_distinct("id").alias("documents")).filter("documents > 1"), "common")
    known = spread.distinct().join(common, "key")
    # Shingles of one document come first and bring nothing together; they only use up places.
    ordered = known.groupBy("id", "n", "label").agg(F.sort_array(F.collect_list(F.struct("documents", "key"))).alias("s"))
    alone = (F.col("n") - F.size("s")).cast("int")
    places = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int") - alone
    taken = ordered.filter(places > 0).select("id", "n", "label", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), places)).alias("at", "p"))
    return taken.select(F.col("p.key").alias("key"), "id", "n", "label", (F.col("alone") + F.col("at")).alias("pos"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * intersection >= percent * union`` of their shingle sets; component_id is the
    smallest doc_id that links reach, and kept marks the document that bears it. Texts that are null, empty or
    without words have no shingles, are linked with nothing and are kept. Rows with null doc_id get a null
    component_id and are kept. Rows of one doc_id are one document, whose links are those of all its texts. Of
    several documents with the same set the smallest doc_id stands for all. Other columns are not read; no rows give
    no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    own = scratch.keep(sketches(docs), "sketches")
    some = own.filter("n_shingles > 0 and doc_id is not null")
    sets = some.select("doc_id", "set_a", "set_b")
    classes = scratch.keep(sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = scratch.keep(some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b"], "left_semi"), "reps")

    hits = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # The smallest member of each bucket is its centre; buckets of one document end here.
    first = scratch.keep(hits.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.max("id").alias("high")).filter("c.id < high").select("key", "c.id", "c.n", F.col("c.id").alias("label")), "centres-1")
    buckets = scratch.keep(hits.join(first.select("key"), "key", "left_semi").withColumn("label", F.col("id")), "buckets-1")
    met = buckets.select(F.col("id").alias("doc_id")).distinct()
    texts = scratch.keep(docs.select("doc_id", text_of().alias("text")).join(met, "doc_id", "left_semi"), "texts")

    # A doc_id with several sets ties their classes together.
    several = sets.groupBy("doc_id").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low < high").select("doc_id")
    links = scratch.keep(sets.join(several, "doc_id").join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links-0")
    done = scratch.keep(star_pairs(buckets, first, percent, placed=False), "pairs-1")
    links = links.union(scratch.keep(confirmed(done, reps, texts, percent), "links-1"))
    labels = connected_components(links, scratch, "labels-1")
    buckets = scratch.keep(open_buckets(buckets, first, labels), "buckets-2")
    buckets = scratch.keep(rare_shingle_buckets(buckets, texts, percent, scratch), "buckets-3")
    nobody = first.limit(0)
    buckets = scratch.keep(open_buckets(buckets, nobody, labels), "buckets-4")
    scratch.drop("buckets-1", "buckets-2", "buckets-3", "shingles", "common")
    step, count, documents = 3, CENTRES_GROWTH, reps.count()
    while not buckets.isEmpty():
        step += 1
        count = centres_that_fit(buckets, documents, count)
        centres = scratch.keep(star_centres(buckets, count), f"centres-{step}")
        pairs = scratch.keep(star_pairs(buckets, centres, percent, placed=True).join(done, ["a", "b"], "left_anti"), f"pairs-{step}")
        done = done.union(pairs)
        new = scratch.keep(confirmed(pairs, reps, texts, percent), f"links-{step}")
        if not new.isEmpty():
            labels = joined_components(labels, new, scratch, f"labels-{step}")
        buckets = scratch.keep(open_buckets(buckets, centres, labels), f"buckets-{step + 1}")
        scratch.drop(f"buckets-{step}", f"centres-{step}")
        count *= CENTRES_GROWTH
    scratch.drop("texts", "reps")

    found = own.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    found = found.withColumn("node", F.coalesce("rep", "doc_id"))
    found = found.join(labels, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
