"""Connected components of a graph in a DataFrame, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any comparable type -> (node, label), one row per node that has an edge; nodes of a component share the label.

    Each round maps every node to the least of itself and its neighbours and contracts the edges; ids should be
    in random order (hashes), so that a round removes a constant part of the nodes. Every round is a written table:
    a lost executor costs the current round only. Empty edges give an empty result; loops and repeats do no harm.
    """
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")))
        if labels is None:
            after = written(step.select("node", F.col("up").alias("label")))
        else:
            after = written(labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
            discard(labels)
        labels = after
        left = live.join(step.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("b", "x")
        moved = left.join(step.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        now = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(live)
        discard(step)
        live = now
    if labels is None:
        return written(live.select(F.col("a").alias("node"), F.col("b").alias("label")))
    discard(live)
    return labels
