"""K-means over a range of K, mini-batch K-means, and the profile of a clustering."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketloom.operators import lloyd
from basketloom.operators.metrics import (
    calinski_harabasz,
    davies_bouldin,
    label_sizes,
    square_sums,
    stored_moments,
)
from basketloom.operators.walk import seeded_number
from basketloom.runtime import Scratch

SWEEP = (3, 4, 5, 6, 7, 8, 9, 12)

PROFILE = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("cluster_counts", T.ArrayType(T.LongType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("inertia", T.DoubleType()),
        T.StructField("ch_score", T.DoubleType()),
        T.StructField("db_score", T.DoubleType()),
    ]
)


def incidence_rows(pairs: DataFrame, row: str = "rid", col: str = "iid") -> DataFrame:
    """One row per ``row`` with its sorted distinct column numbers."""
    return (
        pairs.select(F.col(row).alias("row_id"), F.col(col).alias("dim"))
        .distinct()
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list("dim")).alias("dims"))
    )


def matrix_width(cells: DataFrame, dim: str = "dim") -> int:
    return int(cells.agg(F.coalesce(F.max(dim), F.lit(-1)) + 1).first()[0])


def vector_rows(cells: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Stored rows (row_id, dims, values).

    They are stored as the plain structs of sparse ML vectors: draws go by the partitions of the
    files, so Spark ML's K-means draws the same rows from them.  Cells without a column are left out,
    but not their rows.  One row of the matrix has at most ``width`` cells.
    """
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(width).alias("size"),
        F.transform("_cells", lambda c: c["dim"].cast("int")).alias("indices"),
        F.transform("_cells", lambda c: c["value"].cast("double")).alias("values"),
    )
    plain = scratch.keep(
        cells.groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_cells"))
        .withColumn("_cells", F.filter("_cells", lambda c: c["dim"].isNotNull()))
        .select("row_id", sparse.alias("features"))
    )
    return plain.select(
        "row_id",
        F.col("features.indices").alias("dims"),
        F.col("features.values").alias("values"),
    )


def centre_cells(spark, centres: Sequence[np.ndarray]) -> DataFrame:
    """K dense centres (which the model holds on the driver) as (label, dim, value)."""
    frames = []
    for label, centre in enumerate(centres):
        dims = np.flatnonzero(centre)
        frames.append(pd.DataFrame({"label": label, "dim": dims, "value": centre[dims]}))
    return spark.createDataFrame(pd.concat(frames), "label int, dim long, value double")


def profile_clustering(
    cells: DataFrame,
    labels: DataFrame,
    centres: DataFrame,
    k: int,
    inertia: float,
    table: DataFrame | None = None,
) -> tuple:
    """Cluster sizes, score (minus the inertia), inertia and both quality indices."""
    sizes = {row["label"]: row["n"] for row in label_sizes(labels).collect()}  # k rows
    table = stored_moments(cells, labels) if table is None else table
    ch = calinski_harabasz(cells, labels, centres, table).first()["ch_score"]
    db = davies_bouldin(cells, labels, centres, table=table).first()["db_score"]
    return (k, [sizes.get(i, 0) for i in range(k)], -inertia, inertia, ch, db)


def profile_of_labels(cells: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """The profile of a labelling that is given, its inertia taken from the stored moments."""
    spark = cells.sparkSession
    table = stored_moments(cells, labels)
    inertia = square_sums(table, centres, label_sizes(labels)).agg(F.sum("squares")).first()[0]
    k = labels.agg(F.max("label")).first()[0] + 1
    profile = profile_clustering(cells, labels, centres, int(k), float(inertia), table)
    return spark.createDataFrame([profile], PROFILE)


def kmeans_sweep(
    cells: DataFrame, ks: Sequence[int] = SWEEP, seed: int = 0, max_iter: int = 300
) -> DataFrame:
    """Fit K-means for every K on the same stored rows and profile each result.

    Centres are tables, so neither the driver nor a task holds a vector of the matrix's width.
    """
    spark = cells.sparkSession
    scratch = Scratch(spark, "kmeans")
    stored = scratch.keep(cells.select("row_id", F.col("dim").cast("long").alias("dim"), "value"))
    # stored, so that every fit reads them again after a lost executor too
    rows = vector_rows(stored, matrix_width(stored), scratch)
    whole = lloyd.totals(rows, seed, scratch)
    placed = stored.where(F.col("dim").isNotNull())
    profiles = []
    for k in ks:
        fit = lloyd.fit(rows, k, max_iter, whole, scratch)
        profiles.append(profile_clustering(placed, fit.labels, fit.centres, k, fit.cost))
        scratch.drop(fit.labels, fit.stored)
    return spark.createDataFrame(profiles, PROFILE)


class MiniBatch(NamedTuple):
    centres: DataFrame  # label, dim, value
    labels: DataFrame  # row_id, label, distance
    inertia: float


def array_rows(cells: DataFrame) -> DataFrame:
    """row_id, dims, values: the cells of a row as two arrays, by column number."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))))
    return cells.groupBy("row_id").agg(pairs.alias("_cells")).select(
        "row_id",
        F.transform("_cells", lambda c: c["dim"]).alias("dims"),
        F.transform("_cells", lambda c: c["value"]).alias("values"),
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column numbers, values and row starts of a batch of array rows."""
    lists = batch.column("dims")
    sizes = lists.value_lengths().to_numpy()
    return lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy(), np.cumsum(sizes) - sizes


def _nearest(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and squared distance of each row; the lowest label of equally near ones."""
    dims, values, starts = _flat(batch)
    dots = np.add.reduceat(centres.T[dims] * values[:, None], starts)
    own = np.add.reduceat(values * values, starts)
    apart = np.maximum(own[:, None] - 2 * dots + (centres * centres).sum(axis=1), 0.0)
    labels = apart.argmin(axis=1)
    return labels, apart[np.arange(len(labels)), labels]


# in place of a column number: rows and summed squared distances of a label
COUNT, SQUARES = -1, -2


def batch_sums(
    rows: DataFrame, centres: dict[int, np.ndarray], one_batch: bool = False
) -> dict[tuple[int, int, int], float]:
    """(start, label, column) -> sum over the rows that ``starts`` deals to each start.

    One aggregate assigns the rows and sums them: every task sends one number for each start, label
    and column it has seen, besides ``COUNT`` and ``SQUARES``.  The few tasks of ``one_batch`` send
    theirs straight to the driver, more are added up by a shuffle.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            starts = batch.column("starts")
            row_of = np.repeat(np.arange(batch.num_rows), starts.value_lengths().to_numpy())
            start_of = starts.flatten().to_numpy()
            for start, means in sent.value.items():
                mine = batch.take(pa.array(row_of[start_of == start]))
                if not mine.num_rows:
                    continue
                labels, squares = _nearest(mine, means)
                dims, values, at = _flat(mine)
                # two more columns at the end, so that COUNT and SQUARES are places too
                sums = total.setdefault(start, np.zeros((means.shape[0], means.shape[1] + 2)))
                sizes = np.diff(np.append(at, len(dims)))
                np.add.at(sums, (np.repeat(labels, sizes), dims), values)
                np.add.at(sums, (labels, COUNT), 1.0)
                np.add.at(sums, (labels, SQUARES), squares)
        for start, sums in total.items():
            label, dim = np.nonzero(sums)
            width = sums.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(label), start), pa.int32()),
                    pa.array(label, pa.int32()),
                    pa.array(np.where(dim >= width - 2, dim - width, dim), pa.int64()),
                    pa.array(sums[label, dim]),
                ],
                names=["start", "label", "dim", "value"],
            )

    parts = rows.select("starts", "dims", "values").mapInArrow(
        run, "start int, label int, dim long, value double"
    )
    if not one_batch:
        parts = parts.groupBy("start", "label", "dim").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int, int], float] = defaultdict(float)
    # in one order, so that the sums do not depend on which task ends first
    for r in sorted(parts.collect()):
        found[r["start"], r["label"], r["dim"]] += r["value"]
    sent.unpersist()
    return found


class _Start:
    """Running means of one start, and whether its batches still bring something."""

    def __init__(self, first: np.ndarray) -> None:
        self.sums, self.sizes = first.copy(), np.ones(len(first))
        self.smoothed = self.lowest = None
        self.waited = 0

    def centres(self) -> np.ndarray:
        return self.sums / self.sizes[:, None]

    def take(self, found: dict[tuple[int, int], float], weight: float) -> None:
        rows = squares = 0.0
        for (label, dim), value in found.items():
            if dim == COUNT:
                self.sizes[label] += value
                rows += value
            elif dim == SQUARES:
                squares += value
            else:
                self.sums[label, dim] += value
        if not rows:
            return
        inertia = squares / rows
        self.smoothed = inertia if self.smoothed is None else self.smoothed + weight * (inertia - self.smoothed)
        if self.lowest is None or self.smoothed < self.lowest:
            self.lowest, self.waited = self.smoothed, 0
        else:
            self.waited += 1


def drawn_batches(
    rows: DataFrame, total: int, batch_size: int, max_iter: int, salts: Sequence[int]
) -> DataFrame:
    """Rows with ``iteration`` and ``starts``: the batch of every iteration and start.

    A pass deals all rows to batches of about ``batch_size`` by a hash that differs from pass to pass,
    so later passes meet other batches.  At most about ``max_iter * batch_size`` rows of every start
    are drawn.
    """
    batches = max(total // batch_size, 1)
    draws = []
    for start, salt in enumerate(salts):
        for turn in range(-(-max_iter // batches)):
            place = F.pmod(seeded_number(salt, "row_id", F.lit(turn)), F.lit(batches)).cast("int")
            draws.append(F.struct((place + turn * batches).alias("iteration"), F.lit(start).alias("start")))
    kept = F.filter(F.array(*draws), lambda d: d["iteration"] < max_iter)
    return (
        rows.withColumn("_draw", F.explode(kept))
        .groupBy("row_id", F.col("_draw.iteration").alias("iteration"))
        .agg(F.collect_list("_draw.start").alias("starts"), F.first("dims").alias("dims"), F.first("values").alias("values"))
    )


def mini_batch_kmeans(
    cells: DataFrame,
    k: int,
    batch_size: int = 1024,
    max_iter: int = 100,
    n_init: int = 3,
    max_no_improvement: int = 10,
    seed: int = 0,
) -> MiniBatch:
    """Mini-batch K-means: centres are running means of the batch rows assigned to them.

    All starts go side by side.  An iteration is one aggregate over its stored batch; only the centres
    (starts x k x columns) live on the driver.  The start with the lowest inertia over all rows wins.
    """
    spark = cells.sparkSession
    scratch = Scratch(spark, "mini-batch")
    rows = scratch.keep(array_rows(cells))
    total = rows.count()
    if total < k:
        raise ValueError(f"{total} rows cannot form {k} clusters")
    width = int(rows.agg(F.max(F.element_at("dims", -1))).first()[0]) + 1
    salts = [seed * n_init + start for start in range(n_init)]
    starts: list[_Start] = []
    for salt in salts:
        first = np.zeros((k, width))
        chosen = rows.orderBy(seeded_number(salt, "row_id", F.lit("start")), "row_id").limit(k).collect()
        for label, row in enumerate(chosen):
            first[label, row["dims"]] = row["values"]
        starts.append(_Start(first))
    everyone = rows.withColumn("starts", F.array(*[F.lit(n) for n in range(n_init)]))
    table = None
    if total >= 2 * batch_size:
        drawn = drawn_batches(rows, total, batch_size, max_iter, salts)
        # one file for every iteration
        table = scratch.keep(drawn.repartition("iteration"), partition_by=["iteration"])
    weight = min(2.0 * batch_size / (total + 1), 1.0)
    for i in range(max_iter):
        going = {n: s.centres() for n, s in enumerate(starts) if s.waited < max_no_improvement}
        if not going:
            break
        batch = everyone if table is None else table.where(F.col("iteration") == i)
        found: dict[int, dict] = {n: {} for n in going}
        for (start, label, dim), value in batch_sums(batch, going, one_batch=True).items():
            found[start][label, dim] = value
        for n in going:
            starts[n].take(found[n], weight)
    centres = [s.centres() for s in starts]
    last = batch_sums(everyone, dict(enumerate(centres)))
    inertia = [sum(v for (n, _, dim), v in last.items() if n == start and dim == SQUARES) for start in range(n_init)]
    best = int(np.argmin(inertia))
    sent = spark.sparkContext.broadcast(centres[best])

    def label_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                labels, squares = _nearest(batch, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_id"), pa.array(labels, pa.int32()), pa.array(np.sqrt(squares))],
                    names=["row_id", "label", "distance"],
                )

    kind = rows.schema["row_id"].dataType.simpleString()
    labels = scratch.keep(rows.mapInArrow(label_rows, f"row_id {kind}, label int, distance double"))
    return MiniBatch(centre_cells(spark, centres[best]), labels, inertia[best])
