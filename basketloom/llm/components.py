"""Connected components of an undirected graph, round by round in stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.runtime import Scratch


def _edge(node: str, other: str) -> Column:
    return F.struct(F.col(node).alias("node"), F.col(other).alias("other"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the label of that
    label, so that chains shorten by half; it ends when no label changes.  No edges give no rows.
    """
    both = scratch.keep(
        edges.where("a <> b")
        .select(F.explode(F.array(_edge("a", "b"), _edge("b", "a"))).alias("e"))
        .select("e.*")
        .distinct()
    )
    labels = scratch.keep(
        both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    )
    while True:
        seen = both.join(
            labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other"
        )
        lowest = seen.groupBy("node").agg(F.min("c").alias("c"))
        nearer = scratch.keep(
            labels.join(lowest, "node").select(
                "node", F.least("component", "c").alias("component"), F.col("component").alias("was")
            )
        )
        roots = nearer.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = scratch.keep(
            nearer.join(roots, "component", "left").select(
                "node", F.least("component", "root").alias("component"), "was"
            )
        )
        scratch.drop(nearer, labels)
        labels = jumped
        if jumped.where("component <> was").isEmpty():
            return jumped.select("node", "component")
