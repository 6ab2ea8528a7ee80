"""Tables: Parquet folders, catalog tables and JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from basketloom.operators.curate import append_new


def read_table(spark: SparkSession, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A catalog table, a Parquet folder (by path) or, with options, a JDBC table.

    JDBC reads need ``url`` and, to be parallel, ``partitionColumn`` with its bounds.
    """
    if options:
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    if "/" in name:
        return spark.read.parquet(name)
    return spark.table(name)


def create_table(df: DataFrame, name: str, fragile: bool = True) -> None:
    """Store a query as a table; an existing one is an error, or kept when not ``fragile``."""
    mode = "errorifexists" if fragile else "ignore"
    if "/" in name:
        df.write.mode(mode).parquet(name)
    else:
        df.write.mode(mode).saveAsTable(name)


def copy_table(spark: SparkSession, source: str, target: str, fragile: bool = True) -> None:
    create_table(read_table(spark, source), target, fragile)


def insert_new(rows: DataFrame, target: str, key: str) -> None:
    """Append rows whose key the table does not have yet, one row per key."""
    spark = rows.sparkSession
    fresh = append_new(read_table(spark, target), rows, key)
    if "/" in target:
        fresh.write.mode("append").parquet(target)
    else:
        fresh.write.mode("append").saveAsTable(target)
