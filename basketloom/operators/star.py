"""Basket, item and edge tables built from parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.runtime import dense_ids

def item_key(name: Column, longest: int | None = None) -> Column:
    """Lower-case key of a name, cut to ``longest`` characters where a key length is wanted."""
    lowered = F.lower(name)
    return lowered if longest is None else F.left(lowered, F.lit(longest))


def item_name(name: Column, text: Column, longest: int | None = None) -> Column:
    """Key of an item: its name, else the line's text."""
    return item_key(F.coalesce(name, text), longest)


def _address(basket: Column, pos: Column) -> Column:
    """One number for a line: the dense basket id and the line's place.

    A document may have up to 2^24 lines and there may be up to 2^39 baskets.
    """
    return F.shiftleft(basket, 24).bitwiseOR(pos.cast("long"))


def basket_dimension(documents: DataFrame, partof: str) -> DataFrame:
    """One row per document, with dense ids in the order of the source key."""
    rows = documents.select(
        F.col("title").alias("basket_name"),
        F.col("url").alias("source"),
        F.lit(partof).alias("partof"),
        F.col("id").alias("lid"),
    )
    return dense_ids(rows, ["lid"], "basket_id")


def _lines(documents: DataFrame) -> DataFrame:
    """(id, pos, line) of documents, or of their lines where these are given one by one."""
    if "line" in documents.columns:
        return documents.select("id", "pos", "line")
    return documents.select("id", F.posexplode("ingredients").alias("pos", "line"))


def item_names(documents: DataFrame, longest: int | None = None) -> DataFrame:
    """Distinct item names over main lines and their substitutions."""
    names = _lines(documents).select(
        F.explode(
            F.concat(
                F.array(item_name(F.col("line.name"), F.col("line.text"), longest)),
                F.coalesce(
                    F.transform(
                        "line.substitutions",
                        lambda sub: item_key(sub["name"], longest),
                    ),
                    F.array().cast("array<string>"),
                ),
            )
        ).alias("item_name")
    )
    return names.where(F.col("item_name").isNotNull()).distinct()


def item_dimension(names: DataFrame) -> DataFrame:
    return dense_ids(names.select("item_name").distinct(), ["item_name"], "item_id")


def _edge_lines(documents: DataFrame, longest: int | None = None) -> DataFrame:
    return _lines(documents).select(
        F.col("id").alias("lid"),
        "pos",
        item_name(F.col("line.name"), F.col("line.text"), longest).alias("item_name"),
        F.col("line.quantity_low").alias("quantity_low"),
        F.col("line.quantity_high").alias("quantity_high"),
        F.col("line.unit").alias("unit"),
        F.col("line.text").alias("text"),
    )


def edge_fact(
    documents: DataFrame, baskets: DataFrame, items: DataFrame, longest: int | None = None
) -> DataFrame:
    """One edge per main line whose basket and item are known.

    Both lookups are equi joins on unique keys, so a popular item only makes one side long; the
    adaptive skew join splits it.  ``edge_id`` holds the basket and the place of the line.
    """
    return (
        _edge_lines(documents, longest)
        .join(baskets.select("lid", "basket_id"), "lid")
        .join(items.select("item_name", "item_id"), "item_name")
        .select(
            _address(F.col("basket_id"), F.col("pos")).alias("edge_id"),
            "basket_id",
            "item_id",
            "quantity_low",
            "quantity_high",
            "unit",
            "text",
        )
    )


def unresolved_lines(
    documents: DataFrame, baskets: DataFrame, items: DataFrame, longest: int | None = None
) -> DataFrame:
    """Lines whose basket or item is missing from the dimensions."""
    lines = _edge_lines(documents, longest)
    no_basket = lines.join(baskets, "lid", "left_anti").withColumn("missing", F.lit("basket"))
    no_item = lines.join(items, "item_name", "left_anti").withColumn("missing", F.lit("item"))
    return no_basket.unionByName(no_item).select("lid", "pos", "item_name", "missing")


def equipment_tables(
    documents: DataFrame, baskets: DataFrame, longest: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Equipment dimension (unique names) and the basket-equipment bridge."""
    used = documents.select(
        F.col("id").alias("lid"), F.posexplode("equipment").alias("pos", "piece")
    ).select("lid", "pos", F.col("piece.text").alias("text"))
    named = used.withColumn("equipment_name", item_key(F.col("text"), longest))
    equipment = dense_ids(
        named.select("equipment_name").distinct(), ["equipment_name"], "equipment_id"
    )
    bridge = (
        named.join(baskets.select("lid", "basket_id"), "lid")
        .join(equipment, "equipment_name")
        .select(_address(F.col("basket_id"), F.col("pos")).alias("id"), "basket_id", "equipment_id", "text")
    )
    return equipment, bridge


def instruction_steps(documents: DataFrame, baskets: DataFrame) -> DataFrame:
    """(basket, step, text) with steps counted from 1."""
    return (
        documents.select(
            F.col("id").alias("lid"), F.posexplode("instructions").alias("pos", "step_text")
        )
        .join(baskets.select("lid", "basket_id"), "lid")
        .select("basket_id", (F.col("pos") + 1).alias("step"), F.col("step_text.text").alias("text"))
    )
