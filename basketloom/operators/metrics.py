"""Cluster quality on sparse rows kept as cells (row_id, dim, value); absent cells are 0.

Distances to a row's own centroid are sums over (label, dim) groups, so a pass is one partial
aggregate keyed by (label, dim): a dense column costs one row per task, whoever owns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.runtime import Scratch, join_counted, one_row, shuffled


def array_cells(rows: DataFrame, row_id: str, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of dense vectors held as arrays."""
    return rows.select(
        F.col(row_id).alias("row_id"),
        *keep,
        F.posexplode(vector).alias("dim", "value"),
    ).withColumn("value", F.col("value").cast("double"))


def edge_cells(edges: DataFrame, row: str = "basket_id", col: str = "item_id") -> DataFrame:
    """0/1 cells of the basket-item incidence matrix."""
    return edges.select(F.col(row).alias("row_id"), F.col(col).alias("dim")).distinct().withColumn(
        "value", F.lit(1.0)
    )


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def label_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    return cells.join(labels.select("row_id", "label"), "row_id")


def centroids(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean of each cluster as (label, dim, value)."""
    sums = labelled.groupBy("label", "dim").agg(F.sum("value").alias("_sum"))
    return sums.join(sizes, "label").select(
        "label", "dim", (F.col("_sum") / F.col("n")).alias("value")
    )


def moments(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums of the values and of their squares by (label, dim): all that the squared indices need.

    One scan of the cells; rows without a label are under the label NULL.  ``stored_moments`` keeps
    the table, which has at most labels x columns rows, for any number of indices.
    """
    return (
        cells.join(shuffled(labels.select("row_id", "label")), "row_id", "left")
        .groupBy("label", "dim")
        .agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    )


def stored_moments(cells: DataFrame, labels: DataFrame) -> DataFrame:
    return Scratch(cells.sparkSession, "moments").keep(moments(cells, labels))


def square_sums(table: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per label the summed squared distance of its rows to its centroid (label, n, squares).

    Sum |x - c|^2 = sum x^2 - 2 c sum x + n |c|^2, moment by moment.
    """
    cross = (
        table.where(F.col("label").isNotNull())
        .join(shuffled(centres.withColumnRenamed("value", "c")), ["label", "dim"], "left")
        .groupBy("label")
        .agg(F.sum(F.col("ss") - 2 * F.coalesce("c", F.lit(0.0)) * F.col("s")).alias("_cross"))
    )
    norms = centres.groupBy("label").agg(F.sum(F.col("value") * F.col("value")).alias("_norm"))
    squares = (
        F.coalesce("_cross", F.lit(0.0)) + F.col("n") * F.coalesce("_norm", F.lit(0.0))
    )
    return (
        sizes.join(cross, "label", "left")
        .join(norms, "label", "left")
        # rounding may leave a tiny negative sum for a cluster of equal rows
        .select("label", "n", F.greatest(squares, F.lit(0.0)).alias("squares"))
    )


def between_separation(
    cells: DataFrame, labels: DataFrame, centres: DataFrame, table: DataFrame | None = None
) -> DataFrame:
    """Size-weighted squared distance of centroids to the overall mean, over K - 1.

    With S the column sums, N the rows and m = S / N the mean, the sum over labels of n |c - m|^2
    is  sum n |c|^2 - 2/N sum_dim S sum_label n c + |S|^2 / N^2 sum n.
    """
    sizes = label_sizes(labels)
    if table is None:
        sums = cells.groupBy("dim").agg(F.sum("value").alias("s"))
    else:
        sums = table.groupBy("dim").agg(F.sum("s").alias("s"))
    weighted = (
        centres.join(F.broadcast(sizes), "label")  # a row per label
        .groupBy("dim")
        .agg(
            F.sum(F.col("n") * F.col("value") * F.col("value")).alias("ncc"),
            F.sum(F.col("n") * F.col("value")).alias("nc"),
        )
    )
    totals = (
        weighted.join(sums, "dim", "full")
        .fillna(0.0)
        .agg(
            F.sum("ncc").alias("ncc"),
            F.sum(F.col("s") * F.col("nc")).alias("snc"),
            F.sum(F.col("s") * F.col("s")).alias("ss"),
        )
    )
    clusters = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("rows"))
    rows = F.col("rows")
    spread = F.col("ncc") - 2 * F.col("snc") / rows + F.col("ss") / rows
    return one_row(totals, clusters).select((spread / (F.col("k") - 1)).alias("separation"))


def within_cohesion(table: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """Summed squared distance of rows to their centroid, over N - K; ``table``: ``moments``."""
    return square_sums(table, centres, label_sizes(labels)).agg(
        (F.sum("squares") / (F.sum("n") - F.count("*"))).alias("cohesion")
    )


def calinski_harabasz(
    cells: DataFrame, labels: DataFrame, centres: DataFrame, table: DataFrame | None = None
) -> DataFrame:
    table = stored_moments(cells, labels) if table is None else table
    separation = between_separation(cells, labels, centres, table)
    cohesion = within_cohesion(table, labels, centres)
    return one_row(separation, cohesion).select(
        "separation",
        "cohesion",
        F.try_divide("separation", "cohesion").alias("ch_score"),
    )


def scatter(
    labelled: DataFrame,
    labels: DataFrame,
    centres: DataFrame,
    p: float = 2,
    q: float = 2,
    table: DataFrame | None = None,
) -> DataFrame:
    """(mean of |x - c|_p^q)^(1/q) per label; the moments alone do for p = q = 2."""
    sizes = label_sizes(labels)
    if p == 2 and q == 2:
        if table is None:
            table = labelled.groupBy("label", "dim").agg(
                F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
            )
        return square_sums(table, centres, sizes).select(
            "label", F.sqrt(F.col("squares") / F.col("n")).alias("scatter")
        )
    norms = centres.groupBy("label").agg(
        F.sum(F.pow(F.abs("value"), F.lit(float(p)))).alias("_norm")
    )
    # |x - c|_p^p = |c|_p^p + sum over the row's cells of |x - c|^p - |c|^p
    change = F.pow(F.abs(F.col("value") - F.col("c")), F.lit(float(p))) - F.pow(
        F.abs("c"), F.lit(float(p))
    )
    # the centroid's value and the number of cells it will meet
    known = (
        labelled.groupBy("label", "dim")
        .agg(F.count("*").alias("count"))
        .join(centres.withColumnRenamed("value", "c"), ["label", "dim"], "left")
        .fillna(0.0, ["c"])
    )
    per_row = (
        join_counted(labelled, known, ["label", "dim"])
        .groupBy("row_id")
        .agg(F.sum(change).alias("_change"))
    )
    distance = F.greatest(
        F.coalesce("_norm", F.lit(0.0)) + F.coalesce("_change", F.lit(0.0)), F.lit(0.0)
    )
    return (
        labels.join(per_row, "row_id", "left")
        .join(norms, "label", "left")
        .groupBy("label")
        .agg(
            F.pow(F.avg(F.pow(distance, F.lit(q / p))), F.lit(1.0 / q)).alias("scatter")
        )
    )


def centroid_distances(centres: DataFrame, sizes: DataFrame, p: float = 2) -> DataFrame:
    """p-norm distance of every ordered pair of different labels (i, j).

    |x - y|^p summed over dimensions is the two norms plus a correction on the shared dimensions,
    so each dimension joins the K centroids that have it and zeros are never written out.
    """
    power = F.lit(float(p))
    norms = sizes.select("label").join(
        centres.groupBy("label").agg(F.sum(F.pow(F.abs("value"), power)).alias("norm")),
        "label",
        "left",
    ).fillna(0.0)
    # a dimension outside the data, in which all labels are 0, makes every pair meet
    nowhere = sizes.select(
        "label",
        F.lit(-1).cast(centres.schema["dim"].dataType).alias("dim"),
        F.lit(0.0).alias("value"),
    )
    values = centres.select("label", "dim", "value").unionByName(nowhere)
    a = values.select("dim", F.col("label").alias("i"), F.col("value").alias("x"))
    b = values.select("dim", F.col("label").alias("j"), F.col("value").alias("y"))
    shared = (
        a.join(shuffled(b), "dim")
        .where(F.col("i") != F.col("j"))
        .groupBy("i", "j")
        .agg(
            F.sum(
                F.pow(F.abs(F.col("x") - F.col("y")), power)
                - F.pow(F.abs("x"), power)
                - F.pow(F.abs("y"), power)
            ).alias("_shared")
        )
    )
    left = norms.select(F.col("label").alias("i"), F.col("norm").alias("_ni"))
    right = norms.select(F.col("label").alias("j"), F.col("norm").alias("_nj"))
    powered = F.col("_ni") + F.col("_nj") + F.col("_shared")
    return (
        shared.join(left, "i")
        .join(right, "j")
        .select("i", "j", F.pow(F.greatest(powered, F.lit(0.0)), F.lit(1.0 / p)).alias("distance"))
    )


def worst_similarity(scatters: DataFrame, distances: DataFrame) -> DataFrame:
    """Per label the largest (S_i + S_j) / M_ij; infinite for coincident centroids."""
    si = scatters.select(F.col("label").alias("i"), F.col("scatter").alias("_si"))
    sj = scatters.select(F.col("label").alias("j"), F.col("scatter").alias("_sj"))
    ratio = F.coalesce(
        F.try_divide(F.col("_si") + F.col("_sj"), "distance"), F.lit(float("inf"))
    )
    return (
        distances.join(si, "i").join(sj, "j").groupBy("i").agg(F.max(ratio).alias("worst"))
    ).withColumnRenamed("i", "label")


def davies_bouldin(
    cells: DataFrame,
    labels: DataFrame,
    centres: DataFrame,
    p: float = 2,
    q: float = 2,
    table: DataFrame | None = None,
) -> DataFrame:
    if table is None and p == 2 and q == 2:
        table = stored_moments(cells, labels)
    scatters = scatter(label_cells(cells, labels), labels, centres, p, q, table)
    distances = centroid_distances(centres, label_sizes(labels), p)
    return worst_similarity(scatters, distances).agg(F.avg("worst").alias("db_score"))


def adjusted_rand(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labelings (row_id, label) of the same rows."""

    def pairs(n: Column) -> Column:
        return (n * (n - 1) / 2).cast("double")

    table = (
        labels.select("row_id", F.col("label").alias("a"))
        .join(truth.select("row_id", F.col("label").alias("b")), "row_id")
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("nij"), F.sum("n").alias("n"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ai"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("bj"))
    expected = F.col("ai") * F.col("bj") / pairs(F.col("n"))
    most = (F.col("ai") + F.col("bj")) / 2
    return one_row(cells, rows, cols).select(
        F.when(most == expected, F.lit(1.0))
        .otherwise((F.col("nij") - expected) / (most - expected))
        .alias("ari")
    )
