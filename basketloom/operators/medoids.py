"""K-medoids on sparse rows kept as cells (row_id, dim, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketloom.functions.text import literal_map
from basketloom.operators.metrics import label_cells
from basketloom.operators.walk import random_rows
from basketloom.runtime import Scratch, join_counted

# Largest K x D that dense medoids may have when they are inlined as constants.
MAX_INLINE_VALUES = 2_000_000

# Rows and cells of a block; a task holds two blocks and the distances of a few of their rows.
BLOCK_ROWS, BLOCK_CELLS = 8_192, 500_000
_SLICE_ROWS, _SLICE_COLUMNS = 128, 2_048
MAX_BLOCK_TASKS = 4_096

# Below this number of row-row pairs, passes that drop rows by bounds cost more than the pairs.
PLAIN_PAIRS = 100_000_000_000


def _norms(points: DataFrame) -> dict[int, float]:
    """Squared norm per label: K numbers."""
    rows = (
        points.groupBy("label").agg(F.sum(F.col("value") * F.col("value")).alias("norm")).collect()
    )
    return {row["label"]: row["norm"] for row in rows}


def nearest_point(
    cells: DataFrame, points: DataFrame, k: int, rows: DataFrame | None = None
) -> DataFrame:
    """Label 0..k-1 and distance of the nearest of k points (label, dim, value) for each row.

    |x - c|^2 = |x|^2 - 2 x.c + |c|^2, and all k products of a row are sums of one aggregate by
    row, so no row-point pairs are made.  Ties go to the lowest label.  ``rows`` lists the row ids
    when some rows have no cells.
    """
    norms = _norms(points)
    weights = points.groupBy("dim").agg(
        *[F.sum(F.when(F.col("label") == i, F.col("value"))).alias(f"w{i}") for i in range(k)]
    )
    sums = (
        cells.select("row_id", "dim", "value")
        .join(weights, "dim", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("value") * F.col("value")).alias("xx"),
            *[
                F.coalesce(F.sum(F.col("value") * F.col(f"w{i}")), F.lit(0.0)).alias(f"d{i}")
                for i in range(k)
            ],
        )
    )
    if rows is not None:
        sums = rows.select("row_id").join(sums, "row_id", "left").fillna(0.0)
    distances = F.array(
        *[
            F.sqrt(
                F.greatest(
                    F.col("xx") - 2 * F.col(f"d{i}") + F.lit(float(norms.get(i, 0.0))), F.lit(0.0)
                )
            )
            for i in range(k)
        ]
    )
    return sums.select("row_id", distances.alias("_d")).select(
        "row_id",
        (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("label"),
        F.array_min("_d").alias("distance"),
    )


def row_vectors(cells: DataFrame) -> DataFrame:
    """Rows as arrays (row_id, dims, values) in the order of the dims, with two norms (xx, l1)."""
    row = F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_row")
    return (
        cells.groupBy("row_id")
        .agg(
            row,
            F.sum(F.col("value") * F.col("value")).alias("xx"),
            F.sum(F.abs("value")).alias("l1"),
        )
        .select(
            "row_id", F.col("_row.dim").alias("dims"), F.col("_row.value").alias("values"), "xx", "l1"
        )
    )


def vector_cells(vectors: DataFrame, *keep: str) -> DataFrame:
    pairs = F.arrays_zip("dims", "values")
    return vectors.select("row_id", *keep, F.explode(pairs).alias("_c")).select(
        "row_id", *keep, F.col("_c.dims").alias("dim"), F.col("_c.values").alias("value")
    )


def label_vectors(vectors: DataFrame, medoids: Sequence[int], scratch: Scratch) -> DataFrame:
    """The vectors with the label of their nearest medoid, lowest of equally near ones.

    Only cells in columns of a medoid are grouped; the vectors are read where they lie.
    """
    k = len(medoids)
    points = scratch.keep(medoid_points(vector_cells(vectors), medoids))  # the cells of k rows
    norms = _norms(points)
    weights = points.groupBy("dim").agg(
        *[F.sum(F.when(F.col("label") == i, F.col("value"))).alias(f"w{i}") for i in range(k)]
    )
    products = (
        vector_cells(vectors)
        .join(weights, "dim")
        .groupBy("row_id")
        .agg(*[F.sum(F.col("value") * F.col(f"w{i}")).alias(f"d{i}") for i in range(k)])
    )
    zero = F.lit(0.0)
    squares = F.array(
        *[
            F.greatest(
                F.col("xx") - 2 * F.coalesce(f"d{i}", zero) + F.lit(float(norms.get(i, 0.0))), zero
            )
            for i in range(k)
        ]
    )
    distances = F.transform(squares, F.sqrt)
    return (
        vectors.join(products, "row_id", "left")
        .select(*vectors.columns, distances.alias("_d"))
        .select(
            *vectors.columns,
            (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("label"),
        )
    )


def medoid_points(cells: DataFrame, medoids: Sequence[int]) -> DataFrame:
    """Cells of the k medoid rows, labelled by their place in the list."""
    places = {str(int(m)): str(i) for i, m in enumerate(medoids)}
    label = F.element_at(literal_map(places), F.col("row_id").cast("string")).cast("int")
    return cells.where(F.col("row_id").isin([int(m) for m in medoids])).select(
        label.alias("label"), "dim", "value"
    )


def assign_to_medoids(
    cells: DataFrame, medoids: Sequence[int], rows: DataFrame | None = None
) -> DataFrame:
    return nearest_point(cells, medoid_points(cells, medoids), len(medoids), rows)


def assign_dense(
    rows: DataFrame, medoids: Sequence[int], metric: Callable[[Column, Column], Column]
) -> DataFrame:
    """Nearest medoid under any metric of two array columns; rows are (row_id, vector)."""
    found = {
        row["row_id"]: row["vector"]
        for row in rows.where(F.col("row_id").isin([int(m) for m in medoids])).collect()
    }
    if sum(len(vector) for vector in found.values()) > MAX_INLINE_VALUES:
        raise ValueError("these medoids are too large to inline; use assign_to_medoids")
    points = [F.array(*[F.lit(float(v)) for v in found[m]]) for m in medoids]
    distances = rows.select(
        "row_id", F.array(*[metric(F.col("vector"), point) for point in points]).alias("_d")
    )
    return distances.select(
        "row_id",
        (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("label"),
        F.array_min("_d").alias("distance"),
    )


def distance_to_mean(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Distance of each row to the mean of its own cluster (row_id, label, n, distance)."""
    labelled = label_cells(cells, labels)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    means = (
        labelled.groupBy("label", "dim")
        .agg(F.sum("value").alias("_sum"), F.count("*").alias("count"))
        .join(sizes, "label")
        .select("label", "dim", (F.col("_sum") / F.col("n")).alias("c"), "count")
    )
    norms = means.groupBy("label").agg(F.sum(F.col("c") * F.col("c")).alias("_norm"))
    own = (
        join_counted(labelled, means, ["label", "dim"])
        .groupBy("row_id")
        .agg(F.sum(F.col("value") * (F.col("value") - 2 * F.col("c"))).alias("_own"))
    )
    square = F.coalesce("_own", F.lit(0.0)) + F.coalesce("_norm", F.lit(0.0))
    return (
        labels.select("row_id", "label")
        .join(own, "row_id", "left")
        .join(norms, "label", "left")
        .join(sizes, "label")
        .select(
            "row_id", "label", "n", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance")
        )
    )


def nearest_to_mean(labelled: DataFrame) -> DataFrame:
    """Per label the row nearest to the mean of its vectors (row_id, label, dims, values, xx, l1).

    With c the mean, |x - c|^2 differs from |x|^2 + |c|^2 by 2 |x.c|, which is at most
    2 |x|_1 max|c| and 2 |x| |c|.  Rows that these bounds leave behind another row's are not joined
    to the mean; the others are compared exactly.
    """
    scratch = Scratch(labelled.sparkSession, "means")
    sizes = scratch.keep(labelled.groupBy("label").agg(F.count("*").alias("n")))
    means = scratch.keep(
        vector_cells(labelled, "label")
        .groupBy("label", "dim")
        .agg(F.sum("value").alias("_sum"), F.count("*").alias("count"))
        .join(F.broadcast(sizes), "label")
        .select("label", "dim", (F.col("_sum") / F.col("n")).alias("c"), "count")
    )
    centre = means.groupBy("label").agg(
        F.sum(F.col("c") * F.col("c")).alias("_norm"), F.max(F.abs("c")).alias("_most")
    )
    # one row per label
    centre = scratch.keep(sizes.join(centre, "label", "left").fillna(0.0, ["_norm", "_most"]))
    xx, l1 = F.coalesce("xx", F.lit(0.0)), F.coalesce("l1", F.lit(0.0))
    apart = F.least(2 * l1 * F.col("_most"), 2 * F.sqrt(xx) * F.sqrt("_norm"))
    bounded = labelled.join(F.broadcast(centre), "label").withColumns(
        {"_low": xx + F.col("_norm") - apart, "_high": xx + F.col("_norm") + apart}
    )
    reach = bounded.groupBy("label").agg(F.min("_high").alias("_reach"))
    # the margin covers rounding
    near = scratch.keep(
        bounded.join(F.broadcast(reach), "label")
        .where(F.col("_low") <= F.col("_reach") + 1e-9 * (F.col("_reach") + xx + F.col("_norm")))
        .select("row_id", "label", "dims", "values", "_norm")
    )
    own = (
        join_counted(vector_cells(near, "label"), means, ["label", "dim"])
        .groupBy("row_id")
        .agg(F.sum(F.col("value") * (F.col("value") - 2 * F.col("c"))).alias("_own"))
    )
    square = F.coalesce("_own", F.lit(0.0)) + F.col("_norm")
    distance = F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance")
    return (
        near.join(own, "row_id", "left")
        .select("label", F.struct(distance, "row_id").alias("_row"))
        .groupBy("label")
        .agg(F.min("_row").alias("_best"))
        .select("label", F.col("_best.row_id").alias("medoid"), F.col("_best.distance").alias("loss"))
    )


def medoids_near_mean(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label the row nearest to the cluster's mean, and its distance as the loss.

    Linear in the rows, which makes it the step to use at scale.
    """
    vectors = labels.select("row_id", "label").join(row_vectors(cells), "row_id", "left")
    return nearest_to_mean(Scratch(cells.sparkSession, "labelled").keep(vectors))


def _summed_distances(
    labelled: DataFrame, labels: DataFrame, candidates: DataFrame, batch: int
) -> DataFrame:
    """Distance of every row to the numbered candidates of its own cluster (array per row)."""
    points = labelled.join(candidates.select("row_id", "slot"), "row_id")
    weights = points.groupBy("label", "dim").agg(
        *[F.sum(F.when(F.col("slot") == i, F.col("value"))).alias(f"w{i}") for i in range(batch)]
    )
    norms = (
        candidates.join(
            labelled.groupBy("row_id").agg(
                F.sum(F.col("value") * F.col("value")).alias("norm")
            ),
            "row_id",
            "left",
        )
        .groupBy("label")
        .agg(
            *[
                F.max(F.when(F.col("slot") == i, F.coalesce("norm", F.lit(0.0)))).alias(f"n{i}")
                for i in range(batch)
            ]
        )
    )
    sums = (
        labelled.join(weights, ["label", "dim"], "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.col("value") * F.col("value")).alias("xx"),
            *[F.sum(F.col("value") * F.col(f"w{i}")).alias(f"d{i}") for i in range(batch)],
        )
    )
    zero = F.lit(0.0)
    return (
        labels.select("row_id", "label")
        .join(sums, "row_id", "left")
        .join(norms, "label")
        .select(
            "row_id",
            "label",
            *[
                # NULL where a cluster has no candidate with that number
                F.when(
                    F.col(f"n{i}").isNotNull(),
                    F.sqrt(
                        F.greatest(
                            F.coalesce("xx", zero)
                            - 2 * F.coalesce(f"d{i}", zero)
                            + F.col(f"n{i}"),
                            zero,
                        )
                    ),
                ).alias(f"t{i}")
                for i in range(batch)
            ],
        )
    )


def most_promising(open_rows: DataFrame, batch: int) -> DataFrame:
    """The ``batch`` rows of each label with the least bounds, numbered from 0 in ``slot``.

    A comparison of the row number itself lets Spark keep ``batch`` rows of a label in every task
    before the rows of a cluster come together.
    """
    by_bound = F.row_number().over(Window.partitionBy("label").orderBy("bound", "row_id"))
    return (
        open_rows.withColumn("_rank", by_bound)
        .where(F.col("_rank") <= batch)
        .select("row_id", "label", "n", (F.col("_rank") - 1).alias("slot"))
    )


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a table of rows: row number, dim, value."""
    dims = rows["dims"].combine_chunks()
    counts = pc.fill_null(pc.list_value_length(dims), 0).to_numpy(zero_copy_only=False)
    number = np.repeat(np.arange(len(counts)), counts)
    values = pc.list_flatten(rows["values"].combine_chunks()).to_numpy(zero_copy_only=False)
    return number, pc.list_flatten(dims).to_numpy(zero_copy_only=False), values


def _block_distances(block: pa.Table) -> pa.Table:
    """Summed distances of the wanted rows of a block to its other rows, a few rows at a time."""
    block = block.sort_by("row_id")  # equal rows add up alike, whatever order they came in
    wanted, others = block.filter(pc.field("wanted")), block.filter(~pc.field("wanted"))
    row, dim, value = _flat(others)
    norms = np.bincount(row, value * value, minlength=others.num_rows)
    parts = np.zeros(wanted.num_rows)
    known: tuple[np.ndarray, np.ndarray] | None = None
    for first in range(0, wanted.num_rows, _SLICE_ROWS):
        few = wanted.slice(first, _SLICE_ROWS)
        own_row, own_dim, own_value = _flat(few)
        own_norms = np.bincount(own_row, own_value * own_value, minlength=few.num_rows)
        squares = own_norms[:, None] + norms[None, :]
        columns, place = np.unique(own_dim, return_inverse=True)
        for start in range(0, len(columns), _SLICE_COLUMNS):
            some = columns[start : start + _SLICE_COLUMNS]
            if known is None or not np.array_equal(known[0], some):
                found = np.minimum(np.searchsorted(some, dim), len(some) - 1)
                hit = some[found] == dim
                dense = np.zeros((others.num_rows, len(some)))
                dense[row[hit], found[hit]] = value[hit]
                known = some, dense
            inside = (place >= start) & (place < start + len(some))
            own = np.zeros((few.num_rows, len(some)))
            own[own_row[inside], place[inside] - start] = own_value[inside]
            squares -= 2 * (own @ known[1].T)
        parts[first : first + few.num_rows] = np.sqrt(np.maximum(squares, 0, out=squares), out=squares).sum(axis=1)
    return pa.table({"label": wanted["label"], "row_id": wanted["row_id"], "part": parts})


def summed_distances(
    vectors: DataFrame, wanted: DataFrame, block_rows: int = BLOCK_ROWS, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """Summed distance of the wanted rows to all rows of their label (label, row_id, loss).

    ``vectors`` are (row_id, label, dims, values).  The rows of a label are dealt into blocks by
    hash, on either side, and every pair of blocks is a group of its own: a task never holds more
    than two blocks, and no row-row pair leaves it.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        cells = F.sum(F.coalesce(F.size("dims"), F.lit(0)))
        needed = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(cells / block_cells))
        return rows.groupBy("label").agg(needed.cast("int").alias(name))

    sought = vectors.join(wanted.select("row_id"), "row_id")
    # one row per label
    sizes = Scratch(vectors.sparkSession, "blocks").keep(
        blocks(sought, "_a").join(blocks(vectors, "_b"), "label")
    )
    pairs = sizes.agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 1

    def place(rows: DataFrame, own: str, other: str, is_wanted: bool) -> DataFrame:
        dealt = rows.join(F.broadcast(sizes), "label").select(
            "label", "row_id", "dims", "values", F.lit(is_wanted).alias("wanted"),
            F.pmod(F.xxhash64("row_id"), F.col(own)).cast("int").alias(f"{own}_at"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"),
        )
        return dealt

    placed = place(sought, "_a", "_b", True).unionByName(place(vectors, "_b", "_a", False))
    keys = ("label", "_a_at", "_b_at")
    label, row_id = vectors.schema["label"].dataType, vectors.schema["row_id"].dataType
    parts = (
        placed.repartition(min(pairs, MAX_BLOCK_TASKS), *keys)
        .groupBy(*keys)
        .applyInArrow(
            _block_distances,
            f"label {label.simpleString()}, row_id {row_id.simpleString()}, part double",
        )
    )
    # added in one order, so that equal rows have equal sums
    total = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, x: s + x)
    return parts.groupBy("label", "row_id").agg(total.alias("loss"))


def possible_medoids(cells: DataFrame, labels: DataFrame, batch: int = 32) -> DataFrame:
    """The rows that may have the least summed distance to their cluster (row_id).

    A row's sum S(i) is at least n |x_i - mean|, and at least |n d(i, c) - S(c)| for any row c
    whose sum is known.  Each round computes the sums of the ``batch`` most promising rows per
    cluster in one pass, tightens the bounds of the others, and drops those that can no longer
    win; the rounds end when one drops less than half of the rows.
    """
    scratch = Scratch(cells.sparkSession, "medoids")
    labelled = scratch.keep(label_cells(cells, labels))
    rows = scratch.keep(labels.select("row_id", "label"))
    open_rows = scratch.keep(
        distance_to_mean(cells, labels).select(
            "row_id", "label", "n", (F.col("n") * F.col("distance")).alias("bound")
        )
    )
    # the margin covers rounding in the bounds and sums
    margin = 1 + 1e-9
    tried: DataFrame | None = None
    left = open_rows.count()
    before = 2 * left
    while left and 2 * left <= before:
        candidates = scratch.keep(most_promising(open_rows, batch))
        distances = scratch.keep(_summed_distances(labelled, rows, candidates, batch))
        sums = scratch.keep(
            distances.groupBy("label").agg(
                F.array(*[F.sum(f"t{i}") for i in range(batch)]).alias("sums")
            )
        )
        found = candidates.join(sums, "label").select(
            "label", "row_id", F.element_at("sums", F.col("slot") + 1).alias("loss")
        )
        tried = scratch.keep(found if tried is None else found.unionByName(tried))
        best = tried.groupBy("label").agg(F.min("loss").alias("_loss"))
        per_candidate = F.array(*[F.col(f"t{i}") for i in range(batch)])
        bounds = F.zip_with(
            per_candidate, "sums", lambda d, s: F.abs(F.col("n") * d - s)
        )
        open_rows = scratch.keep(
            open_rows.join(candidates.select("row_id"), "row_id", "left_anti")
            .join(distances.drop("label"), "row_id")
            .join(sums, "label")
            .join(best, "label")
            .select(
                "row_id",
                "label",
                "n",
                F.greatest("bound", F.array_max(bounds)).alias("bound"),
                "_loss",
            )
            .where(F.col("bound") <= F.col("_loss") * margin)
            .drop("_loss")
        )
        before, left = left, open_rows.count()
    if tried is None:
        return rows.select("row_id")
    best = tried.groupBy("label").agg(F.min("loss").alias("_loss"))
    near = tried.join(best, "label").where(F.col("loss") <= F.col("_loss") * margin)
    return open_rows.select("row_id").unionByName(near.select("row_id"))


def best_medoids(
    labelled: DataFrame, batch: int = 32, plain_pairs: int = PLAIN_PAIRS
) -> DataFrame:
    """``exact_medoids`` of stored vectors with labels."""
    sizes = labelled.groupBy("label").agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    wanted = labelled
    if pairs > plain_pairs:
        labels = labelled.select("row_id", "label")
        wanted = possible_medoids(vector_cells(labelled), labels, batch)
    best = F.min(F.struct("loss", "row_id")).alias("found")
    return (
        summed_distances(labelled, wanted)
        .groupBy("label")
        .agg(best)
        .select("label", F.col("found.row_id").alias("medoid"), F.col("found.loss").alias("loss"))
    )


def exact_medoids(
    cells: DataFrame, labels: DataFrame, batch: int = 32, plain_pairs: int = PLAIN_PAIRS
) -> DataFrame:
    """Per label the row with the least summed distance to its cluster, and that sum as the loss.

    Sums are taken over pairs of blocks, so the answer is exact without ever forming all pairs at
    once; with more than ``plain_pairs`` pairs, rows that cannot win are dropped by bounds first.
    """
    vectors = labels.select("row_id", "label").join(row_vectors(cells), "row_id", "left")
    labelled = Scratch(cells.sparkSession, "labelled").keep(vectors)
    return best_medoids(labelled, batch, plain_pairs)


MEDOID_STEPS = {"mean": nearest_to_mean, "exact": best_medoids}


class Medoids(NamedTuple):
    medoids: list[int]
    labels: DataFrame
    losses: list[float]


def k_medoids(
    cells: DataFrame,
    k: int,
    initial: Sequence[int] | None = None,
    threshold: float = 1,
    iterations: int | None = 10,
    step: str = "mean",
    seed: int = 0,
) -> Medoids:
    """Alternate assignment and medoid update until the loss gains no more than ``threshold``."""
    scratch = Scratch(cells.sparkSession, "k-medoids")
    vectors = scratch.keep(row_vectors(cells))
    medoids = (
        list(initial)
        if initial is not None
        else [row[0] for row in random_rows(vectors.select("row_id"), ["row_id"], k, seed).collect()]
    )
    losses: list[float] = []
    previous = None
    change = float("inf")
    labelled = None
    while change > threshold:
        superseded = labelled
        labelled = scratch.keep(label_vectors(vectors, medoids, scratch))
        if superseded is not None:
            scratch.drop(superseded)
        found = {row["label"]: row for row in MEDOID_STEPS[step](labelled).collect()}  # k rows
        # a label that lost all rows to an equal medoid keeps its medoid
        medoids = [found[i]["medoid"] if i in found else medoids[i] for i in range(k)]
        loss = sum(row["loss"] for row in found.values())
        losses.append(loss)
        change = change if previous is None else previous - loss
        previous = loss
        if iterations is not None and len(losses) >= iterations:
            break
    return Medoids(medoids, labelled.select("row_id", "label"), losses)
