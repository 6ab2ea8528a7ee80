"""Declared schemas of the frames that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TEXT_ITEM = _schema(text=T.StringType())

DOCUMENT = _schema(
    id=T.StringType(),
    title=T.StringType(),
    url=T.StringType(),
    partition=T.StringType(),
    ingredients=T.ArrayType(TEXT_ITEM),
    instructions=T.ArrayType(TEXT_ITEM),
)

_PART = {
    "name": T.StringType(),
    "unit": T.StringType(),
    "quantity_str": T.StringType(),
    "quantity_low": T.DoubleType(),
    "quantity_high": T.DoubleType(),
    "modifier": T.StringType(),
    "parenthetic": T.ArrayType(T.StringType()),
}

PARSED_LINE = _schema(
    text=T.StringType(),
    **_PART,
    matched=T.StringType(),
    substitutions=T.ArrayType(_schema(**_PART)),
)

PARSED_DOCUMENT = _schema(
    id=T.StringType(),
    title=T.StringType(),
    url=T.StringType(),
    partition=T.StringType(),
    ingredients=T.ArrayType(PARSED_LINE),
    instructions=T.ArrayType(TEXT_ITEM),
    equipment=T.ArrayType(TEXT_ITEM),
)

BASKETS = _schema(
    basket_id=T.LongType(),
    basket_name=T.StringType(),
    source=T.StringType(),
    partof=T.StringType(),
    lid=T.StringType(),
)
ITEMS = _schema(item_id=T.LongType(), item_name=T.StringType())
EDGES = _schema(
    edge_id=T.LongType(),
    basket_id=T.LongType(),
    item_id=T.LongType(),
    quantity_low=T.DoubleType(),
    quantity_high=T.DoubleType(),
    unit=T.StringType(),
    text=T.StringType(),
)
VOCABULARY = _schema(
    name=T.StringType(),
    id=T.LongType(),
    count=T.LongType(),
    length=T.IntegerType(),
    valid=T.ByteType(),
)
TRIPLES = _schema(subject=T.StringType(), relation=T.StringType(), object=T.StringType())
CHILD_OF = _schema(child=T.StringType(), parent=T.StringType())
ALIASES = _schema(alias=T.StringType(), ingredient=T.StringType())
PAIRS = _schema(rid=T.LongType(), iid=T.LongType())
MODIFIERS = _schema(modifier=T.StringType())
ABBREVIATIONS = _schema(abbreviation=T.StringType(), expansion=T.StringType())
