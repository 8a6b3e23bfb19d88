"""Components, whole and joined with new links, against a union of sets."""

import random

import pytest
from pyspark.sql import functions as F

from sagebrush.llm import minhash
from sagebrush.llm.common import Scratch
from sagebrush.llm.components import connected_components, joined_components


def plain(edges):
    of = {}
    for a, b in edges:
        one = of.get(a, {a}) | of.get(b, {b})
        of.update(dict.fromkeys(one, one))
    return {n: min(s) for n, s in of.items()}


def told(labels):
    rows = labels.collect()
    found = {r.node: r.label for r in rows}
    assert len(found) == len(rows)
    return found


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


RNG = random.Random(3)
PATH = [(i, i + 1) for i in range(40)]
SOME = [(RNG.randrange(120), RNG.randrange(120)) for _ in range(70)]
MORE = [(RNG.randrange(-60, 160), RNG.randrange(160)) for _ in range(60)]


@pytest.mark.parametrize(("old", "new"), [(PATH, [(100, 40), (101, 102)]), (SOME, MORE), (SOME, SOME[:5] + [(7, 7)]), ([], MORE)])
def test_components_and_new_links(spark, old, new):
    scratch = Scratch(spark, "components")
    labels = connected_components(frame(spark, old), scratch, "old")
    assert told(labels) == plain(old)
    assert told(joined_components(labels, frame(spark, new), scratch, "new")) == plain(old + new)
    assert told(joined_components(labels, frame(spark, []), scratch, "none")) == plain(old)


def test_small_buckets_are_decided_whole_and_large_ones_by_centres(spark):
    sizes = {1: 5, 2: 40, 3: 200}
    rows = [(key, 1000 * key + i, 10, 1000 * key + i, 1) for key, n in sizes.items() for i in range(n)]
    buckets = spark.createDataFrame(rows, "key long, id long, n long, label long, pos int")
    found = {r.key: r["count"] for r in minhash.star_centres(buckets, 64).groupBy("key").count().collect()}
    assert found[1] == 5 and found[2] == 40 and 1 < found[3] <= 64
    # 5 * 5 + 40 * 40 + 200 * 128 pairs at 128 centres, 41,625 at 256.
    assert minhash.centres_that_fit(buckets, 27_225 // 64 + 1, 64) == 128
    assert minhash.centres_that_fit(buckets, 1, 64) == 64
    assert minhash.centres_that_fit(buckets, 41_625 // 64 + 1, 64) == 64 << 20
    assert minhash.centres_that_fit(buckets.filter(F.lit(False)), 0, 64) == 64 << 20
