"""Parsed documents -> basket, item and edge tables -> counts -> core -> export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from basketloom.operators.core import Core, extract_core
from basketloom.operators.counts import count_items
from basketloom.operators.star import basket_dimension, edge_fact, item_dimension, item_names
from basketloom.runtime import Scratch
from basketloom.sources.exports import export_baskets


class Star(NamedTuple):
    baskets: DataFrame
    items: DataFrame
    edges: DataFrame


def build_star(documents: DataFrame, partof: str) -> Star:
    """The three tables, stored once so that ids are the same for every reader."""
    scratch = Scratch(documents.sparkSession, "star")
    baskets = scratch.keep(basket_dimension(documents, partof))
    items = scratch.keep(item_dimension(item_names(documents)))
    return Star(baskets, items, scratch.keep(edge_fact(documents, baskets, items)))


def core_export(
    spark: SparkSession, star: Star, wanted: int, rounds: int, folder: str
) -> tuple[Core, str]:
    counts = count_items(star.items, star.edges, how="left")
    core = extract_core(spark, star.baskets, counts, star.edges, wanted, rounds)
    return core, export_baskets(core.baskets, core.items, core.edges, folder)
