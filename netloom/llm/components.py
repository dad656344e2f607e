"""Connected components of an edge table, by smallest labels and pointer jumping, each round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """``edges`` (a, b) -> node, comp: the smallest node of each component; only nodes with an edge appear.

    A round takes the smallest label among a node and its neighbours, then the label of that label, so that the number of rounds grows with
    the logarithm of the longest chain and not with its length in most graphs. It ends when no label changes.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
    both = scratch.keep(both.distinct(), f"{name}_both")
    labels = scratch.keep(both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("comp")), f"{name}_0")
    k = 0
    while True:
        k += 1
        heard = both.join(labels.select(F.col("node").alias("y"), F.col("comp").alias("said")), "y").groupBy(F.col("x").alias("node")).agg(F.min("said").alias("said"))
        lower = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "said").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        fresh = scratch.keep(lower.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")), f"{name}_{k}")
        changed = fresh.where("comp < old").limit(1).count()
        labels = fresh.select("node", "comp")
        if not changed:
            return labels
