"""Connected components of an undirected edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b); label is the least node reachable.

    Each round takes the least label of the neighbours and then follows labels once
    (pointer jumping), until none changes. Each round is a written table, so a lost
    executor costs at most one round; no rows go to the driver but one count a round.
    Labels fall with every round, so the loop ends; star-shaped input takes few rounds.
    """
    both = scratch.save(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels0")
    k = 0
    while True:
        k += 1
        told = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        least = labels.select("node", "label", F.col("label").alias("was")).union(told.select("node", "label", F.lit(None).cast("long").alias("was")))
        least = least.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("above"))
        jumped = least.join(up, least["label"] == up["up"], "left").select("node", F.least("label", "above").alias("label"), "was")
        new = scratch.save(jumped, f"labels{k}")
        if k > 1:
            scratch.drop(f"labels{k - 2}")
        if new.where("label <> was").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
