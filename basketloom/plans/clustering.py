"""Row-item pairs -> K-means for several K -> metrics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from basketloom.operators.kmeans import SWEEP, kmeans_sweep
from basketloom.operators.metrics import edge_cells
from basketloom.sources.exports import write_results
from basketloom.sources.vocabulary import read_pairs


def cluster_pairs(
    spark: SparkSession, pairs: str, folder: str, ks: Sequence[int] = SWEEP, seed: int = 0
) -> str:
    cells = edge_cells(read_pairs(spark, pairs), "rid", "iid")
    return write_results(kmeans_sweep(cells, ks, seed), folder)
