"""Small helpers that several text operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the words of several contracts end at these characters only
BLANKS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are already stored.

    Spark removes them when the driver has collected the frames that made them, which may be long
    after; a job of several stored steps calls this between the steps to keep its disk use low.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of an Arrow string array without nulls."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def without_nulls(array):
    """The strings of an Arrow column in one array, null as the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def small_batches(batches: Iterable, column: str = "text", size: int = SLICE_BYTES) -> Iterator:
    """The batches cut so that each has about ``size`` bytes of text, or one row.

    Array work on texts takes many times the memory of the texts, and Arrow cuts by rows only.
    """
    for batch in batches:
        texts = without_nulls(batch.column(column))
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one range after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
