"""Curating the item vocabulary and carrying it over to baskets and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.functions.text import strip
from basketloom.runtime import dense_ids, shuffled


def new_valid_items(vocabulary: DataFrame, items: DataFrame) -> DataFrame:
    """Valid vocabulary entries whose name is not an item yet."""
    known = items.select(F.col("item_name").alias("name"))
    return (
        vocabulary.where(F.col("valid") == 1)
        .join(known, "name", "left_anti")
        .select(F.col("id").alias("item_id"), F.col("name").alias("item_name"))
    )


def append_new(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` that may be appended to ``target``: key unseen, one row per key."""
    fields = F.struct(*rows.columns)
    fresh = rows.join(target.select(key), key, "left_anti").select(*rows.columns)
    return fresh.groupBy(key).agg(F.min(fields).alias("_row")).select("_row.*")


def validated_items(vocabulary: DataFrame, items: DataFrame) -> DataFrame:
    """Vocabulary ids of valid entries whose name is an item."""
    known = items.select(F.col("item_name").alias("name"))
    return (
        vocabulary.where(F.col("valid") == 1)
        .join(known, "name", "left_semi")
        .select(F.col("id").alias("item_id"))
    )


def correct_ids(vocabulary: DataFrame, items: DataFrame) -> DataFrame:
    """Take the item's id where the name is an item, and keep the entry's own id elsewhere."""
    known = items.select(F.col("item_name").alias("name"), F.col("item_id").alias("_master"))
    return (
        vocabulary.join(known, "name", "left")
        .withColumn("id", F.coalesce("_master", "id"))
        .select(*vocabulary.columns)
    )


def relation_ids(triples: DataFrame, validated: DataFrame, items: DataFrame) -> DataFrame:
    """Named triples as ids, where both ends are validated items."""
    names = validated_item_names(validated, items)
    subjects = names.select(
        F.col("item_name").alias("subject"), F.col("item_id").alias("subject_id")
    )
    objects = names.select(F.col("item_name").alias("object"), F.col("item_id").alias("object_id"))
    return (
        triples.join(subjects, "subject")
        .join(objects, "object")
        .select("subject_id", F.col("relation").alias("predicate"), "object_id")
    )


def validated_baskets(edges: DataFrame, validated: DataFrame) -> DataFrame:
    """Baskets all of whose items are validated: one pass and one partial aggregate."""
    flags = validated.select("item_id").distinct().withColumn("_ok", F.lit(True))
    return (
        edges.where(F.col("basket_id").isNotNull())
        .select("basket_id", "item_id")
        .join(shuffled(flags), "item_id", "left")
        .groupBy("basket_id")
        .agg(F.every(F.coalesce("_ok", F.lit(False))).alias("_all"))
        .where("_all")
        .select("basket_id")
    )


def named_alias_edges(relations: DataFrame, items: DataFrame) -> DataFrame:
    """Alias relations between different items, with names, except singular-of."""
    subjects = items.select(
        F.col("item_id").alias("subject_id"), F.col("item_name").alias("subject_name")
    )
    objects = items.select(
        F.col("item_id").alias("object_id"), F.col("item_name").alias("object_name")
    )
    return (
        relations.where(
            F.col("predicate").startswith("alias:")
            & ~F.col("predicate").startswith("alias:singular-of")
            & (F.col("subject_id") != F.col("object_id"))
        )
        .join(shuffled(subjects), "subject_id", "left")
        .join(shuffled(objects), "object_id", "left")
        .select("subject_id", "subject_name", "predicate", "object_id", "object_name")
    )


def alias_map(alias_edges: DataFrame) -> DataFrame:
    """One object per subject; the smallest id where there are several."""
    return alias_edges.groupBy("subject_id").agg(F.min("object_id").alias("object_id"))


def canonical_map(validated: DataFrame, items: DataFrame, closure: DataFrame) -> DataFrame:
    """Validated item -> canonical item (itself when it is no alias)."""
    targets = closure.select(F.col("subject_id").alias("item_id"), F.col("object_id").alias("_target"))
    return (
        validated.join(shuffled(items.select("item_id")), "item_id", "left_semi")
        .join(shuffled(targets), "item_id", "left")
        .select("item_id", F.coalesce("_target", "item_id").alias("canonical_id"))
    )


def canonical_edges(edges: DataFrame, baskets: DataFrame, canonical: DataFrame) -> DataFrame:
    """Distinct (edge, basket, canonical item) over validated baskets."""
    return (
        edges.select("edge_id", "basket_id", "item_id")
        .join(shuffled(baskets.select("basket_id")), "basket_id", "left_semi")
        .join(shuffled(canonical), "item_id")
        .select("edge_id", "basket_id", "canonical_id")
        .distinct()
    )


def canonical_baskets(canonical: DataFrame, validated: DataFrame) -> DataFrame:
    return (
        canonical.select("basket_id")
        .join(validated.select("basket_id"), "basket_id", "left_semi")
        .distinct()
    )


def canonical_items(canonical: DataFrame, validated: DataFrame) -> DataFrame:
    return (
        canonical.select(F.col("canonical_id").alias("item_id"))
        .join(validated.select("item_id"), "item_id", "left_semi")
        .distinct()
    )


def canonical_edge_list(canonical: DataFrame) -> DataFrame:
    return canonical.select("basket_id", "canonical_id")


def validated_item_names(validated: DataFrame, items: DataFrame) -> DataFrame:
    return validated.select("item_id").join(items, "item_id").select("item_id", "item_name")


def validated_basket_titles(validated: DataFrame, baskets: DataFrame) -> DataFrame:
    return (
        validated.select("basket_id")
        .join(baskets, "basket_id")
        .select("basket_id", "basket_name")
    )


def basket_details(canonical: DataFrame, baskets: DataFrame, items: DataFrame) -> DataFrame:
    """Title and distinct canonical items with names, one row per (basket, item).

    Kept as rows: a basket of any size then never has to fit into one task.
    """
    return (
        canonical.select("basket_id", "canonical_id")
        .distinct()
        .join(baskets.select("basket_id", "basket_name"), "basket_id")
        .join(
            items.select(F.col("item_id").alias("canonical_id"), "item_name"), "canonical_id"
        )
        .select("basket_id", "basket_name", "canonical_id", "item_name")
    )


def mark_known_valid(
    vocabulary: DataFrame, names: DataFrame, respect_invalid: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Set ``valid`` to 1 for known names; also return the names that are not in the vocabulary."""
    known = names.select("name").distinct()
    hit = F.col("_known").isNotNull()
    if respect_invalid:
        hit = hit & (F.col("valid") != -1)
    marked = (
        vocabulary.join(known.withColumn("_known", F.lit(1)), "name", "left")
        .withColumn("valid", F.when(hit, F.lit(1)).otherwise(F.col("valid")).cast("tinyint"))
        .select(*vocabulary.columns)
    )
    return marked, known.join(vocabulary.select("name"), "name", "left_anti")


def append_unmatched(
    vocabulary: DataFrame, unmatched: DataFrame, least_id: int = 10_000_000
) -> DataFrame:
    """Add names with fresh ids above both ``least_id`` and every id in use."""
    in_use = vocabulary.agg(F.max("id")).first()[0]
    start = max(least_id, in_use if in_use is not None else least_id) + 1
    fresh = dense_ids(unmatched.select("name").distinct(), ["name"], "id", start=start)
    return vocabulary.unionByName(
        fresh.select(
            "name",
            "id",
            F.lit(0).cast("long").alias("count"),
            F.length("name").alias("length"),
            F.lit(0).cast("tinyint").alias("valid"),
        )
    )


def integrate_known(
    vocabulary: DataFrame, names: DataFrame, least_id: int = 10_000_000
) -> DataFrame:
    """Mark known names valid and append the rest as unknown entries."""
    trimmed = names.select(strip(F.col("name")).alias("name"))
    marked, unmatched = mark_known_valid(vocabulary, trimmed)
    return append_unmatched(marked, unmatched, least_id)


def drop_duplicate_names(vocabulary: DataFrame) -> DataFrame:
    """Per name the entry with the lowest (valid, id); a partial aggregate, not a window."""
    rest = [c for c in vocabulary.columns if c not in ("valid", "id")]
    return (
        vocabulary.groupBy("name")
        .agg(F.min(F.struct("valid", "id", *rest)).alias("_row"))
        .select(*[F.col(f"_row.{c}") for c in vocabulary.columns])
    )
