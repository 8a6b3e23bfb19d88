"""Labelled rows for fitting: a bounded sample, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, text, label and place (a hash that orders rows) of about ``bound`` labelled rows outside the held-out fold.

    If more rows are labelled, a hash of doc_id picks ``bound`` of them, give or take its chance. The ids and labels
    of the sample, 12 bytes a row and so bounded too, are broadcast, so that texts are picked where they are read.
    Rows with null ids or labels take no part; of several labels of one doc_id the largest counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = known.withColumn("place", place).filter(F.col("place") < min(1.0, bound / max(n, 1)) * (1 << 40))
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
