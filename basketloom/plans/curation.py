"""Curated vocabulary and relations -> canonical items, edges and samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from basketloom.operators.closure import canonical_items_job
from basketloom.operators.curate import (
    canonical_edges,
    correct_ids,
    new_valid_items,
    relation_ids,
    validated_baskets,
    validated_items,
)
from basketloom.operators.walk import sampled_baskets, walk_baskets
from basketloom.runtime import Scratch


class Curated(NamedTuple):
    items: DataFrame
    validated: DataFrame
    baskets: DataFrame
    canonical: DataFrame
    edges: DataFrame


def curate(
    vocabulary: DataFrame, triples: DataFrame, items: DataFrame, edges: DataFrame
) -> Curated:
    """Correct ids, add new valid items, validate baskets and map edges to canonical items."""
    scratch = Scratch(vocabulary.sparkSession, "curation")
    vocabulary = scratch.keep(correct_ids(vocabulary, items))
    items = scratch.keep(items.unionByName(new_valid_items(vocabulary, items)))
    validated = scratch.keep(validated_items(vocabulary, items))
    baskets = scratch.keep(validated_baskets(edges, validated))
    relations = scratch.keep(relation_ids(triples, validated, items))
    canonical = scratch.keep(canonical_items_job(relations, validated, items))
    return Curated(
        items, validated, baskets, canonical, scratch.keep(canonical_edges(edges, baskets, canonical))
    )


def sample(edges: DataFrame, baskets: DataFrame, items: DataFrame, n_samples: int = 50, **walk):
    """Titles, basket-item pairs and item names of a sampled connected subgraph."""
    visits = walk_baskets(edges, n_samples=n_samples, **walk)
    chosen = Scratch(edges.sparkSession, "sample").keep(sampled_baskets(visits, n_samples))
    titles = baskets.join(chosen, "basket_id", "left_semi").select("basket_id", "basket_name")
    pairs = (
        edges.join(chosen, "basket_id", "left_semi").select("basket_id", "canonical_id").distinct()
    )
    names = items.join(
        pairs.withColumnRenamed("canonical_id", "item_id"), "item_id", "left_semi"
    ).select("item_id", "item_name")
    return titles, pairs, names
