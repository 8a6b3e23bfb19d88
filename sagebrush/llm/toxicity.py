"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed and of a learned lexicon, how near lexicon words stand to the second person,
capitals, punctuation, and words whose letters are hidden by digits or symbols. Part of the training rows gives the
learned lexicon and grows the trees; the rest, whose labels neither has seen, calibrates the trees' margin by isotonic
regression, so that scores are probabilities.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts
from .labelled import fold, sample

#: Insults of a general kind, in the languages of the corpus.
LEXICON = {
    *"idiot stupid moron dumb loser trash garbage pathetic worthless disgusting scum clown fool jerk ugly hate".split(),
    *"idiote stupide imbecile connard debile nul".split(),
    *"idiota estupido imbecil basura tonto inutil".split(),
    *"dumm dummkopf trottel abschaum wertlos arschloch".split(),
}
SECOND_PERSON = set("you your yours u ur tu te ton toi vous votre usted tus du dich dein dir ihr euch".split())
#: What digits and symbols inside a word stand for.
DISGUISES = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"\w+")
HIDDEN = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
UPPER = bytes(range(65, 91))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
FEATURES = ["fixed", "learned", "any_fixed", "any_learned", "near_you", "you", "capitals", "shouted", "punctuation", "exclaims", "hidden", "hidden_hits", "log_words"]
NEAR = 4
#: Labelled rows that the model is fitted on at most, and the words that the learned lexicon holds at most.
SAMPLE_ROWS, LEXICON_WORDS = 12_000, 150
#: Texts in which a learned word must stand, and the least share of them that must be toxic, in multiples of the average.
LEAST_TEXTS, LEAST_LIFT = 8, 3.0
TREES, DEPTH = 20, 3
THRESHOLD = 0.7


def dense(text: str, learned: frozenset[str]) -> list[float]:
    words = WORD.findall(text.lower())
    n = max(len(words), 1)
    known = LEXICON | learned
    fixed = [w for w in words if w in LEXICON]
    own = [w for w in words if w in learned]
    hits = [i for i, w in enumerate(words) if w in known] if fixed or own else []
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    raw = text.encode()
    size = max(len(raw), 1)
    capitals = len(raw) - len(raw.translate(None, UPPER))
    punctuation = len(raw) - len(raw.translate(None, PUNCTUATION))
    hidden = HIDDEN.findall(text.lower())
    found = sum(h.translate(DISGUISES) in known for h in hidden)
    shouted = capitals / size > 0.3
    return [100 * len(fixed) / n, 100 * len(own) / n, float(len(fixed)), float(len(own)), 100 * near / n, 100 * sum(w in SECOND_PERSON for w in words) / n, capitals / size, float(shouted), punctuation / size, raw.count(b"!") / size, len(hidden) / n, float(found), len(words) ** 0.25]


def learned_lexicon(rows: DataFrame) -> frozenset[str]:
    """Words that stand in far more toxic texts than their frequency explains; counts are over texts of the sample."""
    average = rows.agg(F.avg("label")).first()[0] or 0.0
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    counts = rows.select("label", F.explode(words).alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("texts"), F.sum("label").alias("toxic"))
    share = (F.col("toxic") + average) / (F.col("texts") + 1)
    best = counts.filter((F.col("texts") >= LEAST_TEXTS) & (share >= LEAST_LIFT * average)).orderBy(share.desc(), F.desc("texts"), "word").limit(LEXICON_WORDS)
    return frozenset(r.word for r in best.collect())


def with_features(docs: DataFrame, learned: frozenset[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, of type long, and one column for each of ``FEATURES``."""

    def rows(*columns: list) -> list:
        *kept, texts = columns
        values = [dense(t, learned) for t in texts]
        return [*(pa.array(x, pa.int64()) for x in kept), *([v[i] for v in values] for i in range(len(FEATURES)))]

    return map_texts(docs, rows, ", ".join([*(f"{c} long" for c in keep), *(f"{f} double" for f in FEATURES)]), ids=keep)


class Model:
    """Trees, and the calibration of their margin."""

    def __init__(self, rows: DataFrame):
        self.average, n, classes = rows.agg(F.avg("label"), F.count(F.lit(1)), F.count_distinct("label")).first()
        self.learned, self.trees, self.steps = frozenset(), None, None
        if n == 0 or classes < 2:
            return
        part = F.pmod("place", F.lit(3))
        growing, calibrating = rows.agg(F.count_distinct(F.when(part != 0, F.col("label"))), F.count(F.when(part == 0, 1))).first()
        if growing < 2 or not calibrating:
            return
        self.learned = learned_lexicon(rows.filter(part != 0))
        dealt = with_features(rows.withColumn("label", F.col("label").cast("long")), self.learned, ("doc_id", "label", "place"))
        # Each round of the fit reads the features again; written once, they are not made again from the texts.
        known = assembled(Scratch(rows.sparkSession, "toxicity").keep(dealt, "features"))
        self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8, seed=7, maxBins=64, featuresCol="features", labelCol="label").fit(known.filter(part != 0))
        held = self.margins(known.filter(part == 0)).select("margin", F.col("label").cast("double").alias("label"))
        self.steps = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held)

    def margins(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of each row of ``docs``."""
        if self.trees is None:
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(self.average or 0.0)).alias("score"))
        margins = self.margins(assembled(with_features(docs, self.learned)))
        return self.steps.transform(margins.select("doc_id", "margin")).select("doc_id", F.col("prediction").alias("score"))


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).drop(*FEATURES)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (higher: label 1 likelier), predicted.

    Only texts are scored; labels of the held-out fold are never read into the fit. Null and empty texts are texts
    without words. A null doc_id isn't held out. Null and repeated ids are kept, each row by itself. Other columns
    are not read. No rows give no rows; where the labels that grow the trees are of one class only, or none calibrate,
    every score is the labels' average, or 0 without any.
    """
    rows = sample(docs, labels, "toxic", folds, held_out, SAMPLE_ROWS).persist()
    try:
        found = Model(rows).score(docs)
    finally:
        rows.unpersist()
    return found.select("doc_id", F.coalesce(fold(folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
