"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Texts become sparse vectors: words and runs of punctuation, alone and in pairs, hashed to ``BITS`` bits; pairs of the
same word, side by side or with one between, also count as one gram whatever the word. A value is the square root of
the gram's share of all grams. The training sample is dealt to shards; each shard makes
passes over its rows with per-coordinate FTRL-proximal updates, and the shards' weights are averaged by their rows. The
model is a vector of bounded size, so it is broadcast, and a score is one sparse dot product.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_of
from .labelled import fold, sample

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of "the same word again", by distance.
REPEATS = np.arange(3, dtype=np.uint64) * MIX
#: Labelled rows that the model is fitted on at most, shards, and passes over each.
SAMPLE_ROWS, SHARDS, PASSES = 12_000, 4, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.1
THRESHOLD = 0.7


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's vector; index 0 is the intercept."""
    tokens = TOKEN.findall(text)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = [np.full(int((h[:-d] == h[d:]).sum()), REPEATS[d]) for d in (1, 2)]
    grams = np.concatenate([h, (h[:-1] * MIX) ^ h[1:], *pairs])
    index, counts = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts / max(len(grams), 1))
    return np.append(index + 1, 0), np.append(values, 1.0)


def probability(z: float) -> float:
    return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """Weights after ``passes`` over the rows, in their order."""
    z = np.zeros((1 << BITS) + 1)
    n = np.zeros_like(z)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(passes):
        for index, values, label in rows:
            w = weights(index)
            g = (probability(w @ values) - label) * values
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(slice(None))


def fit(rows: DataFrame, shards: int = SHARDS) -> np.ndarray:
    """Average weights of the shards' models, by their rows. ``rows`` is what :func:`labelled.sample` returns.

    Without rows all weights are 0, and every score is one half.
    """

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "doc_id"])
        w = ftrl([(*features(t), y) for t, y in zip(part.text, part.label, strict=True)])
        index = np.flatnonzero(w)
        # Index -1 carries the number of rows.
        return pd.DataFrame({"index": np.append(index, -1), "weight": np.append(w[index], 1.0) * len(part)})

    dealt = rows.withColumn("shard", F.pmod("place", F.lit(shards)))
    trained = dealt.groupBy("shard").applyInPandas(train, "index long, weight double")
    out, total = np.zeros((1 << BITS) + 1), 1.0
    for r in trained.groupBy("index").agg(F.sum("weight").alias("weight")).toLocalIterator():
        if r["index"] < 0:
            total = r["weight"]
        else:
            out[r["index"]] = r["weight"]
    return out / total


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(ids: list, texts: list[str]) -> list:
        w = shared.value
        out = []
        for text in texts:
            index, values = features(text)
            out.append(probability(w[index] @ values))
        return [ids, out]

    return map_texts(docs, rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Only texts are scored; labels of the held-out fold are never read into the fit. Null and empty texts get the
    intercept's score. A null doc_id isn't held out. Null and repeated ids are kept, each row by itself. Other
    columns are not read. No rows give no rows; without labels every score is one half.
    """
    weights = fit(sample(docs, labels, "quality", folds, held_out, SAMPLE_ROWS))
    found = scored(docs, weights)
    return found.select("doc_id", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def only_good(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """``docs`` with all its columns, without the rows that the classifier rejects.

    Where the usable labels of these documents are not of both classes, there is no fit, and nothing is rejected.
    """
    rows = sample(docs, labels, "quality", folds, held_out, SAMPLE_ROWS)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return docs
    weights = fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([probability(w[i] @ v) for i, v in map(features, texts)], dtype="float64")

    return docs.filter(score(text_of()) >= THRESHOLD)
