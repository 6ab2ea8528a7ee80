"""Exports of baskets, samples and clustering results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.sources.vocabulary import grouped_arrays

def timestamped(stem: str, now: datetime | None = None) -> str:
    return f"{stem}_{(now or datetime.now()).strftime('%Y-%m-%d_%H-%M-%S')}"


def nested_baskets(
    baskets: DataFrame,
    items: DataFrame,
    edges: DataFrame,
    title_key: str = "title",
    items_key: str = "ingredients",
    include_title: bool = True,
    include_items: bool = True,
) -> DataFrame:
    """One row per basket with its title and the sorted names of its items.

    A basket without items has an empty list.
    """
    head = [F.col("basket_name").alias(title_key)] if include_title else []
    if not include_items:
        return baskets.select("basket_id", *head)
    named = edges.select("basket_id", "item_id").join(
        items.select("item_id", "item_name"), "item_id"
    )
    lists = grouped_arrays(
        named.select("basket_id", "item_name"), ["basket_id"], "item_name", "_names"
    )
    return baskets.join(lists, "basket_id", "left").select(
        "basket_id",
        *head,
        F.coalesce("_names", F.array().cast("array<string>")).alias(items_key),
    )


def export_baskets(
    baskets: DataFrame, items: DataFrame, edges: DataFrame, folder: str, name: str | None = None,
    **options,
) -> str:
    """Write nested baskets as JSON below ``folder`` and return the path.

    The default name carries the row counts of the three tables.
    """
    if name is None:
        name = f"baskets_b{baskets.count()}i{items.count()}e{edges.count()}.json"
    path = f"{folder.rstrip('/')}/{name}"
    nested_baskets(baskets, items, edges, **options).drop("basket_id").write.json(path)
    return path


def write_sample(
    titles: DataFrame, basket_items: DataFrame, items: DataFrame, folder: str,
    stem: str = "sampled_baskets",
) -> str:
    """Write a sampled subgraph as three JSON tables in one timestamped folder."""
    path = f"{folder.rstrip('/')}/{timestamped(stem)}"
    titles.write.json(f"{path}/titles")
    basket_items.write.json(f"{path}/constituents")
    items.write.json(f"{path}/items")
    return path


def write_results(profiles: DataFrame, folder: str, stem: str = "clustering_results") -> str:
    """Write one row per K with its metrics."""
    path = f"{folder.rstrip('/')}/{timestamped(stem)}"
    profiles.write.parquet(path)
    return path
