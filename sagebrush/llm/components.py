"""Connected components of an undirected graph of integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """One row (node, label) for each node of ``edges`` (a, b); label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, and then that label's own label, so that long
    paths shrink by more than half a round. Labels are written each round, which cuts
    the lineage; the minimum is combined before the shuffle, and the joins are between written tables, whose hot keys
    (a hub's) Spark can split.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"), F.col("node").alias("was")), f"{name}-0")
    step = 0
    while not labels.filter("label != was").isEmpty():
        step += 1
        told = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        new = scratch.keep(told.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), f"{name}-{step}")
        up = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = scratch.keep(new.join(up, "label").select("node", F.col("top").alias("label"), "was"), f"{name}-{step}-up")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-up")
        labels = new
    scratch.drop(f"{name}-edges")
    return labels.select("node", "label")


def joined_components(labels: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components (node, label) of a graph that has those of ``labels``, as :func:`connected_components` returns
    them, and ``edges`` (a, b) besides.

    Each component so far counts as one node, so the work grows with the new edges and one pass over the labels.
    """
    for side in "ab":
        known = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        edges = edges.join(known, side, "left").withColumn(side, F.coalesce(f"{side}_label", side)).drop(f"{side}_label")
    tops = connected_components(edges.select("a", "b"), scratch, f"{name}-tops").select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("top").alias("label"))
    return scratch.keep(moved.union(fresh), name)
