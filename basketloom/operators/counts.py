"""Item counts, basket scores and the filters built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.fixed_values import BAD_NAME_OPENING, BAD_NAME_PARTS
from basketloom.runtime import HOT_ROWS, join_counted

SCORES = {"min": F.min, "max": F.max, "avg": F.avg, "mean": F.avg}


def count_items(items: DataFrame, edges: DataFrame, how: str = "inner", of: str = "edges") -> DataFrame:
    """Number of edges (or of distinct baskets) per item.

    ``how='inner'`` drops unused items and ``how='left'`` keeps them with 0.  ``of='rows'`` counts
    the rows of the outer join, so that an unused item counts 1.  Edges are counted before they
    meet the items, so a popular item is one partial row per task by the time it is shuffled.
    """
    if of == "baskets":
        per_item = edges.select("item_id", "basket_id").distinct().groupBy("item_id")
    else:
        per_item = edges.groupBy("item_id")
    used = per_item.agg(F.count("*").alias("count"))
    if how == "inner":
        return items.join(used, "item_id").select(*items.columns, "count")
    unused = F.lit(1 if of == "rows" else 0).cast("long")
    return items.join(used, "item_id", "left").select(
        *items.columns, F.coalesce("count", unused).alias("count")
    )


def good_name(name: Column) -> Column:
    """True for a name without the signs of a parsing error; NULL for a NULL name."""
    lowered = F.lower(name)
    special = "\\.[]{}()*+?^$|"
    parts = "|".join("".join("\\" + c if c in special else c for c in p) for p in BAD_NAME_PARTS)
    return ~lowered.rlike(f"{parts}|^{BAD_NAME_OPENING}|[0-9]")


def filter_item_names(items: DataFrame, where: Column | str | None = None) -> DataFrame:
    """Keep items with a good name, or those that meet the given condition."""
    return items.where(good_name(F.col("item_name")) if where is None else where)


def basket_scores(
    edges: DataFrame, counts: DataFrame, score: str = "min", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Lowest, highest or mean count of a basket's items; items without a count are left out."""
    counted = join_counted(
        edges.select("basket_id", "item_id"),
        counts.select("item_id", "count"),
        hot_rows=hot_rows,
    )
    return counted.groupBy("basket_id").agg(SCORES[score.lower()]("count").alias("score"))


def score_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy("score").agg(F.count("*").alias("n"))


def exact_threshold(histogram: DataFrame, fraction: float, bins: int = 1024) -> float | int | None:
    """Smallest score that at least a ``1 - fraction`` share of baskets do not exceed.

    The histogram stays distributed: each pass counts up to ``bins`` equal ranges of the interval
    that holds the answer and descends into one of them, until it holds a single score.
    """
    low, high, total = histogram.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    if total is None:
        return None
    rank = min(max(math.ceil((1.0 - fraction) * total), 1), total)
    passed = 0  # baskets below the interval
    while low < high:
        width = (high - low) / bins
        bin_of = F.least(F.floor((F.col("score") - low) / F.lit(width)), F.lit(bins - 1))
        found = (
            histogram.where(F.col("score").between(low, high))
            .groupBy(bin_of.alias("bin"))
            .agg(F.sum("n").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            .orderBy("bin")
            .collect()  # at most `bins` rows
        )
        for row in found:
            if passed + row["n"] >= rank:
                low, high = row["low"], row["high"]
                break
            passed += row["n"]
    return low


def halving_threshold(histogram: DataFrame, fraction: float) -> int | None:
    """Integer threshold by halved steps: up while more than the wanted share reaches it.

    Starts at half the lowest score with a quarter of the spread as first step.
    """
    low, high, total = histogram.agg(F.min("score"), F.max("score"), F.sum("n")).first()
    if total is None:
        return None
    wanted = int(total * fraction)
    threshold, step = int(low) // 2, int(high - low) // 4
    up = True
    while step > 0:
        threshold += step if up else -step
        reached = histogram.where(F.col("score") >= threshold).agg(
            F.coalesce(F.sum("n"), F.lit(0))
        ).first()[0]
        up = reached > wanted
        step //= 2
    return threshold


def baskets_above(baskets: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Baskets scoring strictly above the threshold; baskets without a score drop out."""
    kept = scores.where(F.col("score") > threshold).select("basket_id")
    return baskets.join(kept, "basket_id", "left_semi")


def restrict_edges(edges: DataFrame, baskets: DataFrame) -> DataFrame:
    return edges.join(baskets.select("basket_id"), "basket_id", "left_semi")
