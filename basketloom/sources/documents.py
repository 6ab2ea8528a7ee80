"""Nested JSON documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketloom.runtime import Scratch
from basketloom.schemas import DOCUMENT, PARSED_DOCUMENT

# A brace cannot be escaped in JSON, so a file cut at its closing braces is never cut inside an escape.
CUT = "}"
# outside of strings only brackets and quotes count; an escape only stands in a string
_MARK = re.compile(r'"|\\.|[\[\]{}]', re.S)

_STATES = "file string, block long, flips int, plain_depth long, string_depth long, opens_list boolean"
_FOUND = "file string, block long, at long, kind string, text string"


@contextmanager
def _same_splits(spark: SparkSession):
    """Hold what the sizes of splits depend on, so that two scans of a file cut it alike."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _by_block(batches) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches cut where another block of a file begins; rows of a block come in file order."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
        first = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                yield keys[first], batch.slice(first, k - first)
                first = k


def _pieces(batch: pa.RecordBatch) -> str:
    return "".join([piece + CUT for piece in batch.column("value").to_pylist()])


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block changes: whether it turns "in a string" over, and the depth under both beginnings."""
    found: dict[tuple, list] = {}
    for key, batch in _by_block(batches):
        state = found.setdefault(key, [0, 0, 0, None])
        text = _pieces(batch)
        inside, depth = state[0], [state[1], state[2]]
        for match in _MARK.finditer(text):
            mark = match[0]
            if mark == '"':
                inside ^= 1
            elif len(mark) == 1:
                depth[inside] += 1 if mark in "[{" else -1
        if state[3] is None and (opening := text.lstrip("﻿ \t\r\n")):
            state[3] = opening[0] == "["
        state[:3] = inside, *depth
    rows = [(*key, *state) for key, state in found.items()]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = ["file", "block", "flips", "plain_depth", "string_depth", "opens_list"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents of each block, and what belongs to a document cut by the block's ends."""
    key, inside, depth, base, at = None, 0, 0, 0, 0
    pieces: list[str] = []
    rows: list[tuple] = []

    def put(kind: str) -> None:
        nonlocal at
        rows.append((*key, at, kind, "".join(pieces)))
        at += 1
        pieces.clear()

    def taken() -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["file", "block", "at", "kind", "text"],
            )
            rows.clear()

    begun = True
    for new, batch in _by_block(batches):
        if new != key:
            if key is not None and depth > base:
                put("tail" if begun else "middle")
            if batch.column("inside")[0].as_py() is None:
                raise RuntimeError(f"{new} was cut differently before; the files or splits have changed")
            key, at = new, 0
            pieces.clear()
            inside, depth, base = (batch.column(c)[0].as_py() for c in ("inside", "depth", "base"))
            # a document that an earlier block began
            begun = depth <= base
        text, start = _pieces(batch), 0
        for match in _MARK.finditer(text):
            mark = match[0]
            if mark == '"':
                inside ^= 1
            elif inside or len(mark) > 1:
                continue
            elif mark in "[{":
                if depth == base and mark == "{":
                    start, begun = match.start(), True
                depth += 1
            else:
                depth -= 1
                if depth == base and mark == "}":
                    pieces.append(text[start : match.end()])
                    put("whole" if begun else "head")
                    begun = True
        if depth > base:
            pieces.append(text[start:])
        yield from taken()
    if key is not None and depth > base:
        put("tail" if begun else "middle")
    yield from taken()


def document_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, text of every object of files that each hold one outer list, or objects side by side.

    A file is read in splits like a text file.  One scan says for every split how it changes the state
    (in a string, depth of brackets); running sums give the state each split begins with, and a second
    scan cuts the objects out.  Objects that splits cut in two are put together by their file and place.
    """
    scratch = Scratch(spark, "documents")
    with _same_splits(spark):
        pieces = (
            spark.read.option("lineSep", CUT)
            .text(paths)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        )
        # one row for every split and task
        parts = scratch.keep(pieces.mapInArrow(_block_states, _STATES))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        first = Window.partitionBy("file").orderBy("block")
        inside = (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2).cast("int")
        change = F.when(F.col("inside") == 1, F.col("string_depth")).otherwise(F.col("plain_depth"))
        states = scratch.keep(
            parts.withColumn("inside", inside)
            .withColumn("change", change)
            .select(
                "file", "block", "inside",
                F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
                F.first("opens_list", ignorenulls=True).over(first).cast("int").alias("base"),
            )
        )
        joined = pieces.join(F.broadcast(states), ["file", "block"], "left").select(
            "value", "file", "block", "inside", "depth", F.coalesce("base", F.lit(0)).alias("base")
        )
        found = scratch.keep(joined.mapInArrow(_documents_of, _FOUND))
    order = Window.partitionBy("file").orderBy("block", "at")
    cut = found.where("kind <> 'whole'").withColumn(
        "number", F.sum((F.col("kind") == "tail").cast("long")).over(order)
    )
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "text")))
    mended = cut.groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return found.where("kind = 'whole'").select("file", "text").unionByName(mended.select("file", "text"))


def read_documents(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Documents of files that each hold one outer list, whatever its layout; large files are split.

    ``partitions`` spreads the documents out for work that costs more than moving them.
    """
    texts = document_texts(spark, paths)
    documents = texts.select(F.from_json("text", DOCUMENT).alias("document")).select("document.*")
    return documents.repartition(partitions) if partitions else documents


def read_parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED_DOCUMENT).json(path)


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, which can be read back in splits."""
    documents.write.mode(mode).json(path)


def write_document_lists(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that each hold one outer list, a file for every partition with rows."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if waiting is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([waiting + ","])], names=["value"])
                waiting = ("" if waiting is not None else "[\n") + text
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array([waiting + "\n]"])], names=["value"])

    rows = documents.select(F.to_json(F.struct(*documents.columns)).alias("text"))
    rows.mapInArrow(lists, "value string").write.mode(mode).text(path)
