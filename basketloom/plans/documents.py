"""Raw documents -> parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketloom.operators.lines import parse_documents, rejected_documents
from basketloom.sources.documents import read_documents, write_documents


def parse_document_files(
    spark: SparkSession, source: str | list[str], target: str, partitions: int | None = None
) -> DataFrame:
    """Parse all files of ``source`` into ``target``; returns the rejected documents."""
    parsed = parse_documents(read_documents(spark, source, partitions))
    write_documents(parsed, target)
    return rejected_documents(
        spark.read.schema(parsed.schema).json(target)
    )
