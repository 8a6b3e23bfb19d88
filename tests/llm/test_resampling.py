"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import pytest

from sagebrush.llm import resampling

SCHEMA = "doc_id long, text string, score string, rank int, place long, bucket int"


def plain(rows: list, target: list, grams: int, buckets: int, least: int, percent: int, seed: int) -> list:
    """Rows (doc_id, n_features, weight, score, rank)."""

    def counted(text):
        w = brute.LICENSE_WORD.findall(brute.lower(text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1))

    own, aim = [counted(t) for _, t in rows], Counter()
    for t in target:
        aim.update(counted(t)[1])
    every = sum((c for _, c in own), Counter())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (every.total() + buckets) / ((every[b] + 1) * (aim.total() + buckets))))
    out = []
    for (i, _), (n, c) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) * k for b, k in c.items())
        out.append([n >= least, i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    rank = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted((-1 if r[1] is None else r[1], *r[2:], rank.get(id(r), 0)) for r in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "É", "naïve", "漢字", "don't", "x_y", "1st"]
    made = ["".join(rng.choice(words) + rng.choice(["  ", " ", ". ", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(250)]
    same = "one text that stands many times and has more than twenty words so that it may be drawn each time it stands here or there"
    return [*enumerate([None, "", "...", *made, " ".join(words * 700)]), *((i, same) for i in range(300, 320)), (7, same), (7, same), (7, "short"), (None, same), (None, None)]


TARGET = ["w1 w2 w3 w1 w2 w3 naïve the the", None, "", "w1 W1 w2"]


@pytest.mark.parametrize(("grams", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (3, 500, 0, 35), (2, 10_000, 20, 100)])
def test_by_plain_version(spark, rows, grams, buckets, least, percent):
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = resampling.resample(docs, target, grams, buckets, least, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in found) == plain(rows, TARGET, grams, buckets, least, percent, resampling.SEED)


def test_drawn_and_empty(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    kept = resampling.drawn(docs, target)
    ids = {r[0] for r in plain(rows, TARGET, 1, 10_000, 20, 10, resampling.SEED) if r[-1]} - {-1}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    assert resampling.resample(docs.limit(0), target).count() == 0
    alone = resampling.resample(docs, target.limit(0)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in alone) == plain(rows, [], 1, 10_000, 20, 10, resampling.SEED)
