"""Synthetic 0/1 rows with known clusters, drawn by seeded hashes that other engines can repeat."""

from __future__ import annotations

from math import ceil, gcd, inf, log1p, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.text import let
from basketloom.operators.walk import seeded_number


def active_columns(columns: int, density: float, col_density: float | None) -> tuple[int, float]:
    """How many columns a block uses, and the share of them that a row fills."""
    if col_density is None:
        active = columns
    elif col_density >= density:
        active = max(round(col_density * columns), 1)
    else:
        raise ValueError(
            f"a share of {col_density} of the columns cannot hold {density} of all cells"
        )
    return active, min(density * columns / active, 1.0)


def _drawn_places(active: int, p: float, seed: int) -> Column:
    """Places of a row's ones among ``active`` columns, each filled with probability ``p``.

    The gap to the next one is geometric, so a row costs one draw for each of its ones and not one
    for each column.  Nearly all rows end within ``enough`` draws; the others draw once more in full.
    """
    if p <= 0:
        return F.array().cast("array<long>")
    scale = log1p(-p) if p < 1 else -inf

    def places(draws: int) -> Column:
        def step(found: Column, t: Column) -> Column:
            u = (seeded_number(seed, "row_id", t) + 1) / F.lit(float(1 << 32))
            following = F.element_at(found, -1) + 1 + F.floor(F.ln(u) / F.lit(scale)).cast("long")
            return F.when(F.element_at(found, -1) >= active, found).otherwise(F.array_append(found, following))

        return F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.array(F.lit(-1).cast("long")), step)

    enough = min(ceil(active * p + 6 * sqrt(active * p)) + 8, active)
    whole = let(
        places(enough),
        lambda found: F.when(F.element_at(found, -1) >= active, found).otherwise(places(active)),
    )
    return F.filter(whole, lambda j: (j >= 0) & (j < active))


def _column_step(columns: int, seed: int) -> int:
    """A stride without common factor with the number of columns."""
    step = (seed * 7919 + 104_729) % columns or 1
    while gcd(step, columns) != 1:
        step += 1
    return step


def sparse_rows(
    rows: DataFrame,
    columns: int,
    density: float = 0.1,
    col_density: float | None = None,
    seed: int = 0,
    block: Column | None = None,
) -> DataFrame:
    """Cells (row_id, dim, value) of random 0/1 rows with about ``density * columns`` ones each.

    With ``col_density`` only that share of the columns is ever used, and each value of ``block``
    uses its own.  Every active column is filled on its own, which gives each row a binomial number
    of ones in evenly drawn columns.  Rows are independent, so the job is map-only.
    """
    active, p = active_columns(columns, density, col_density)
    block = F.lit(0) if block is None else block
    # active column j of a block is column (start + j * step) mod columns: distinct by design
    step = _column_step(columns, seed)
    start = F.pmod(seeded_number(seed, F.lit("start"), "_block"), F.lit(columns))
    return (
        rows.withColumn("_block", block)
        .withColumn("_j", F.explode(_drawn_places(active, p, seed)))
        .select(
            "row_id",
            F.pmod(start + F.col("_j") * F.lit(step), F.lit(columns)).alias("dim"),
            F.lit(1.0).alias("value"),
        )
    )


def sparse_rows_sql(source: str, columns: int, density: float, col_density: float | None, seed: int) -> str:
    """The same cells in SQL of DuckDB: common table expressions up to ``made`` (row_id, block, dim).

    ``source`` has (row_id, block).
    """
    active, p = active_columns(columns, density, col_density)
    draw = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
    following = f"j + 1 + CAST(floor(ln(({draw(f"'{seed}|' || row_id || '|' || t")} + 1) / {float(1 << 32)!r}::DOUBLE) / ({log1p(-p)!r}::DOUBLE)) AS BIGINT)"
    return f"""placed AS (SELECT row_id, block, CAST(0 AS BIGINT) AS t, CAST(-1 AS BIGINT) AS j FROM {source}
    UNION ALL SELECT row_id, block, t + 1, {following} FROM placed WHERE j < {active}),
made AS (SELECT row_id, block, ({draw(f"'{seed}|start|' || block")} % {columns} + j * {_column_step(columns, seed)}) % {columns} AS dim
    FROM placed WHERE j >= 0 AND j < {active})"""


def sparse_clusters(
    rows: DataFrame,
    columns: int = 30,
    density: float = 0.1,
    col_density: float | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Cells and true labels for rows (row_id, label): one block of columns per label."""
    cells = sparse_rows(rows, columns, density, col_density, seed, F.col("label"))
    return cells, rows.select("row_id", "label")


def numbered_rows(spark, sizes: list[int]) -> DataFrame:
    """Rows (row_id, label) with the given number of rows per label."""
    bounds = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    label = F.lit(len(sizes) - 1)
    for i in range(len(sizes) - 2, -1, -1):
        label = F.when(F.col("id") < bounds[i], F.lit(i)).otherwise(label)
    return spark.range(bounds[-1]).select(F.col("id").alias("row_id"), label.alias("label"))
