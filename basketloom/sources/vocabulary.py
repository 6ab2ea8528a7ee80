"""CSV files of the curation step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketloom.schemas import (
    ABBREVIATIONS,
    ALIASES,
    CHILD_OF,
    MODIFIERS,
    PAIRS,
    TRIPLES,
    VOCABULARY,
)


def _read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(
        path, header=header, enforceSchema=True
    )


def read_keyed(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """Rows keyed by column ``key``: the column of that name, else the first column renamed.

    Only the header line is looked at to find out; columns may come in any order.
    """
    reader = spark.read.option("quote", '"').option("escape", '"')
    header = reader.csv(path, header=True).columns
    raw = reader.csv(path, header=True, inferSchema=False)
    if key not in header:
        raw = raw.withColumnRenamed(header[0], key)
    kinds = {field.name: field.dataType for field in schema.fields}
    return raw.select(
        *[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns]
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, "name", VOCABULARY)


def read_modifiers(spark: SparkSession, path: str) -> DataFrame:
    return read_keyed(spark, path, "modifier", MODIFIERS)


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(abbreviation, expansion), whatever the two columns are called."""
    raw = read_keyed(spark, path, "abbreviation", ABBREVIATIONS)
    others = [c for c in raw.columns if c != "abbreviation"]
    return raw.select("abbreviation", F.col(others[0]).alias("expansion"))


def read_child_of(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CHILD_OF)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ALIASES)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRIPLES, header=False)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PAIRS, header=False)


def write_vocabulary(vocabulary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vocabulary.write.mode(mode).option("quote", '"').option("escape", '"').csv(path, header=True)


def multimap(edges: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key as one sorted array."""
    return grouped_arrays(edges.select(key, value).distinct(), [key], value, "values")


def grouped_arrays(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """All values of a key, repeated ones too, as one sorted array."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))
