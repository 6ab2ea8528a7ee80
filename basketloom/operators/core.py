"""Shrinking the basket-item graph to a dense core of a wanted size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketloom.operators.counts import (
    basket_scores,
    baskets_above,
    count_items,
    exact_threshold,
    filter_item_names,
    halving_threshold,
    restrict_edges,
    score_histogram,
)
from basketloom.runtime import Scratch

THRESHOLDS = {"exact": exact_threshold, "halving": halving_threshold}

ROUNDS = T.StructType(
    [
        T.StructField("round", T.IntegerType()),
        T.StructField("baskets", T.LongType()),
        T.StructField("edges", T.LongType()),
        T.StructField("items", T.LongType()),
        T.StructField("threshold", T.DoubleType()),
    ]
)


class Core(NamedTuple):
    baskets: DataFrame
    items: DataFrame
    edges: DataFrame
    rounds: DataFrame


def extract_core(
    spark: SparkSession,
    baskets: DataFrame,
    item_counts: DataFrame,
    edges: DataFrame,
    wanted: int,
    rounds: int = 5,
    score: str = "min",
    mode: str = "exact",
    filter_names: bool = True,
) -> Core:
    """Each round keeps the baskets whose rarest item is frequent enough, then counts again.

    Every round aims at the remaining reduction spread evenly over the remaining rounds.  A round
    stores what it keeps as Parquet, so a round reads the one before it and nothing older; only
    counts and the threshold reach the driver.
    """
    scratch = Scratch(spark, "core")
    counts = scratch.keep(filter_item_names(item_counts) if filter_names else item_counts)
    size = baskets.count()
    report = []
    for i in range(rounds):
        if size == 0:
            break
        scores = scratch.keep(basket_scores(edges, counts, score))
        histogram = scratch.keep(score_histogram(scores))
        threshold = THRESHOLDS[mode](histogram, (wanted / size) ** (1.0 / (rounds - i)))
        if threshold is None:
            threshold = 0
        next_baskets = scratch.keep(baskets_above(baskets, scores, threshold))
        next_edges = scratch.keep(restrict_edges(edges, next_baskets))
        next_counts = scratch.keep(count_items(counts.drop("count"), next_edges))
        scratch.drop(scores, histogram, baskets, edges, counts)
        baskets, edges, counts = next_baskets, next_edges, next_counts
        size = baskets.count()
        report.append((i + 1, size, edges.count(), counts.count(), float(threshold)))
    return Core(baskets, counts, edges, spark.createDataFrame(report, ROUNDS))
