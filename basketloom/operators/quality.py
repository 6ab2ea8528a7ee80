"""Checks that stand in for table constraints: each returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set but has no parent."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti").select(*child.columns)


def trailing_space(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).endswith(" "))


def leading_alphanumeric(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).rlike("^[a-zA-Z0-9]"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def vocabulary_status(vocabulary: DataFrame) -> DataFrame:
    valid = F.col("valid")
    return vocabulary.agg(
        F.count("*").alias("length"),
        F.count_if(valid == 1).alias("valid"),
        F.count_if(valid == 0).alias("unknown"),
        F.count_if(valid == -1).alias("invalid"),
    )
