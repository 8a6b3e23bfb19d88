"""A corpus pipeline: from raw documents to tokenised training documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.llm import bpe, decontamination, line_dedup, minhash, quality
from sagebrush.llm.common import Scratch
from sagebrush.llm.queries import VOCABULARY, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.only_good(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of words go, inside lines too, and with them documents of which no word is left."""
    found = line_dedup.without_repeats(docs, inside_lines=True)
    cut = F.col("n_words_deleted") > 0
    emptied = cut & ~F.col("text").rlike("(?U)\\S")
    found = found.filter(F.coalesce(~emptied, F.lit(True)))
    if "n_chars" in docs.columns:
        counted = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", counted)
    return found.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The ids that go grow with the documents, so the join is merged at every size and never broadcast.
    """
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(Scratch(spark, "pipeline").keep(gone, "gone").hint("merge"), "doc_id", "left_anti").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens with their offsets, counts, and hashes of ids and decoded text."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_tokens=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", lines_once),
    ("near dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("byte-level BPE", tokenised),
]

#: The classifier and the edit matching can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
