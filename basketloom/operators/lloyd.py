"""K-means on sparse rows whose centres are tables and never dense vectors on the driver.

The steps are those of Spark ML's ``KMeans`` (seeded ``k-means||`` start, Lloyd iterations until no centre
moves further than the tolerance, ties to the lowest label), with the same draws over the same
partitions, so labels and costs agree with it.  Spark ML holds some 4 K candidates and K centres, each of
the matrix's full width, on the driver and in every task; here the driver holds the cells of the drawn
rows and the ``HEAD`` largest entries of each centre.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketloom.runtime import Scratch, shuffled

# entries of a centre that every task knows
HEAD = 1000
# rounds of draws for the start, and rounds over the drawn rows, as in Spark ML
START_STEPS, START_ROUNDS = 2, 30
_LANES = 256


def _step(states: np.ndarray) -> np.ndarray:
    states = states ^ (states << np.uint64(21))
    states = states ^ (states >> np.uint64(35))
    return states ^ (states << np.uint64(4))


def _hashed(seed: int) -> int:
    """The state that Spark's XORShiftRandom begins with: Murmur3 of the seed's bytes, twice."""

    def murmur(data: bytes, h: int) -> int:
        for at in range(0, len(data), 4):
            k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) & 0xFFFFFFFF
            h ^= k * 0x1B873593 & 0xFFFFFFFF
            h = (h << 13 | h >> 19) & 0xFFFFFFFF
            h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= len(data)
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    data = seed.to_bytes(8, "big", signed=True)
    low = murmur(data, 0x3C074A61)
    return murmur(data, low) << 32 | low


class Draws:
    """The numbers of Spark's XORShiftRandom, many at a time."""

    def __init__(self, seed: int) -> None:
        block = np.empty(_LANES + 1, np.uint64)
        block[0] = _hashed(seed)
        for i in range(_LANES):
            block[i + 1 : i + 2] = _step(block[i : i + 1])
        self._block, self._used = block[1:], 0
        # a step is linear in the bits: what _LANES steps make of each byte of a state
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for _ in range(_LANES):
            bits = _step(bits)
        self._jump = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for bit in range(8):
                self._jump[byte, 1 << bit : 2 << bit] = self._jump[byte, : 1 << bit] ^ bits[8 * byte + bit]

    def states(self, n: int) -> np.ndarray:
        found = []
        while n > 0:
            if self._used == _LANES:
                block = np.zeros(_LANES, np.uint64)
                for byte in range(8):
                    block ^= self._jump[byte][(self._block >> np.uint64(8 * byte)) & np.uint64(255)]
                self._block, self._used = block, 0
            found.append(self._block[self._used : self._used + n])
            n -= len(found[-1])
            self._used += len(found[-1])
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    def doubles(self, n: int) -> np.ndarray:
        pairs = self.states(2 * n).reshape(n, 2)
        high, low = pairs[:, 0] & np.uint64((1 << 26) - 1), pairs[:, 1] & np.uint64((1 << 27) - 1)
        return ((high << np.uint64(27)) + low) * 2.0**-53

    def integer(self) -> int:
        """A signed number of 32 bits."""
        return int(np.uint32(self.states(1)[0] & np.uint64(0xFFFFFFFF)).astype(np.int32))


class Heads(NamedTuple):
    """What tasks know of the centres: their largest entries, and a bound of all others."""

    columns: np.ndarray  # sorted columns that any head has, after -1
    values: np.ndarray  # columns x centres
    norms: np.ndarray
    rest: np.ndarray  # no entry outside the head is larger


def _heads(cells: list[tuple[np.ndarray, np.ndarray]], norms: np.ndarray | None = None) -> Heads:
    """Heads of vectors that are known in full, by their cells."""
    # no row has column -1, which stands for centres without entries
    columns = np.unique(np.concatenate([np.array([-1]), *[dims for dims, _ in cells]]))
    values = np.zeros((len(columns), len(cells)))
    for label, (dims, own) in enumerate(cells):
        values[np.searchsorted(columns, dims), label] = own
    if norms is None:
        norms = np.sqrt((values * values).sum(axis=0))
    return Heads(columns, values, norms, np.zeros(len(cells)))


class _Batch(NamedTuple):
    dims: np.ndarray
    values: np.ndarray
    row_of: np.ndarray
    n: int

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Batch:
        lists = batch.column("dims")
        row_of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        values = batch.column("values").flatten().to_numpy()
        return _Batch(lists.flatten().to_numpy(), values, row_of, batch.num_rows)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row_of, values, self.n)


def _apart(batch: _Batch, heads: Heads) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows and centres as far as the heads tell, and how far off they may be."""
    places = np.minimum(np.searchsorted(heads.columns, batch.dims), len(heads.columns) - 1)
    hit = heads.columns[places] == batch.dims
    dots = np.zeros((batch.n, len(heads.norms)))
    np.add.at(dots, batch.row_of[hit], heads.values[places[hit]] * batch.values[hit, None])
    norms = np.sqrt(batch.sums(batch.values * batch.values))
    both = (norms * norms)[:, None] + heads.norms * heads.norms
    squares = both - 2.0 * dots
    # what is left of equal vectors is rounding
    squares[squares < 4e-10 * both] = 0.0
    return squares, 2.0 * batch.sums(np.abs(batch.values))[:, None] * heads.rest


def _labels(batch: _Batch, heads: Heads) -> np.ndarray:
    """The nearest centre, the lowest of equally near ones, or -1 where the heads do not decide."""
    squares, off = _apart(batch, heads)
    if not heads.rest.any():
        return squares.argmin(axis=1)
    most, least = squares + off, squares - off
    rows, labels = np.arange(batch.n), most.argmin(axis=1)
    # bounds that touch, or nearly so, decide nothing
    bound = most[rows, labels] + 1e-9 * (1.0 + np.abs(squares).max(axis=1))
    least[rows, labels] = np.inf
    return np.where(bound < least.min(axis=1), labels, -1)


def _mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.select("dims", "values").mapInArrow(run, schema)


def _row(dims: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array(dims, np.int64), np.array(values, float)


def _drawn_heads(drawn: list[tuple[np.ndarray, np.ndarray]]) -> Heads:
    return _heads(drawn, np.array([np.sqrt((v * v).sum()) for _, v in drawn]))


def _costs(batch: _Batch, known: list[Heads]) -> np.ndarray:
    """Squared distance of each row to the nearest of all drawn ones."""
    return np.min([_apart(batch, heads)[0].min(axis=1) for heads in known], axis=0)


def _cost(rows: DataFrame, known: list[Heads]) -> float:
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_costs(_Batch.of(batch), sent.value).sum()])], names=["cost"])

    return _mapped(rows, run, "cost double").agg(F.sum("cost")).first()[0]


class Totals(NamedTuple):
    """What all fits of the same rows and seed share."""

    table: DataFrame  # dim, s: sums over all rows
    rows: int
    squares: float
    seed: int
    first: tuple[np.ndarray, np.ndarray]  # the row that is drawn first
    cost: float  # of all rows to it


def totals(rows: DataFrame, seed: int, scratch: Scratch) -> Totals:
    cells = _cells(rows.select("dims", "values"))
    table = scratch.keep(cells.groupBy("dim").agg(F.sum("value").alias("s")))
    squares = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    repeated = F.size(F.array_distinct("dims")) < F.size("dims")
    n, twice = rows.agg(F.count("*"), F.count_if(repeated)).first()
    if twice:
        raise ValueError(f"{twice} rows have several cells in a column")
    seed = Draws(seed).integer()
    found = list(rows.select("dims", "values")._jdf.toJSON().rdd().takeSample(False, 1, seed))
    if not found:
        raise ValueError("there are no rows to cluster")
    first = _row(**json.loads(found[0]))
    return Totals(table, n, squares, seed, first, _cost(rows, [_drawn_heads([first])]))


def _start(rows: DataFrame, k: int, whole: Totals) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells of up to ``k`` first centres: ``k-means||`` over all rows, then k-means++ over the drawn ones."""
    spark = rows.sparkSession
    jvm, gateway, seed = spark._jvm, spark.sparkContext._gateway, whole.seed
    drawn = fresh = [whole.first]
    known: list[Heads] = []
    for step in range(START_STEPS):
        if fresh:
            known.append(_drawn_heads(fresh))
        total = _cost(rows, known) if step else whole.cost
        sent = spark.sparkContext.broadcast(known)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            draws, at = Draws(seed ^ (step << 16) ^ part), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                share = 2.0 * _costs(_Batch.of(batch), sent.value) * k / total if total else np.zeros(batch.num_rows)
                taken = np.flatnonzero(draws.doubles(batch.num_rows) < share)
                picked = batch.take(pa.array(taken))
                place = [pa.array(np.full(len(taken), part), pa.int64()), pa.array(at + taken, pa.int64())]
                yield pa.RecordBatch.from_arrays([*place, *picked.columns], names=["part", "at", "dims", "values"])
                at += batch.num_rows

        # some 2 k rows
        found = _mapped(rows, chosen, "part long, at long, dims array<int>, values array<double>").collect()
        fresh = [_row(r["dims"], r["values"]) for r in sorted(found, key=lambda r: (r["part"], r["at"]))]
        drawn = drawn + fresh
        sent.unpersist()
    heads = _heads(drawn)
    _, unlike = np.unique(heads.values, axis=1, return_index=True)
    unlike = np.sort(unlike)
    vectors = heads.values[:, unlike]
    heads = Heads(heads.columns, vectors, np.sqrt((vectors * vectors).sum(axis=0)), np.zeros(len(unlike)))
    if len(unlike) > k:
        sent = spark.sparkContext.broadcast(heads)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = np.zeros(len(sent.value.norms), np.int64)
            for batch in batches:
                if batch.num_rows:
                    sizes += np.bincount(_labels(_Batch.of(batch), sent.value), minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes))), pa.array(sizes)], names=["label", "n"])

        sizes = dict(_mapped(rows, nearest, "label long, n long").groupBy("label").agg(F.sum("n")).collect())
        sent.unpersist()
        # the drawn rows alone, in the columns that they have
        linalg, clustering = jvm.org.apache.spark.mllib.linalg, jvm.org.apache.spark.mllib.clustering
        points = gateway.new_array(clustering.VectorWithNorm, len(unlike))
        weights = gateway.new_array(jvm.double, len(unlike))
        for label in range(len(unlike)):
            text = json.dumps({"type": 1, "values": vectors[:, label].tolist()})
            points[label] = clustering.VectorWithNorm(linalg.Vectors.fromJson(text))
            weights[label] = float(sizes[label])
        means = clustering.LocalKMeans.kMeansPlusPlus(0, points, weights, k, START_ROUNDS)
        vectors = np.array([json.loads(mean.vector().toDense().toJson())["values"] for mean in means]).T
    return [(heads.columns[np.flatnonzero(v)], v[np.flatnonzero(v)]) for v in vectors.T]


def _cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_cell", F.explode(F.arrays_zip("dims", "values"))).select(
        *[c for c in rows.columns if c not in ("dims", "values")],
        F.col("_cell.dims").alias("dim"),
        F.col("_cell.values").alias("value"),
    )


def _by_label(numbers: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])[F.col("label")]


class _Centres(NamedTuple):
    table: DataFrame  # label, dim, value
    heads: Heads


def _centres(table: DataFrame, entries: list[int], squares: list[float]) -> _Centres:
    """Centres of a stored table; the heads come to the driver, K x ``HEAD`` entries."""
    largest = Window.partitionBy("label").orderBy(F.abs("value").desc(), "dim")
    top = table.withColumn("_rank", F.row_number().over(largest)).where(F.col("_rank") <= HEAD)
    cells: list = [[] for _ in entries]
    for r in top.select("label", "dim", "value").collect():
        cells[r["label"]].append((r["dim"], r["value"]))
    cells = [(np.array([d for d, _ in own], np.int64), np.array([v for _, v in own], float)) for own in map(sorted, cells)]
    rest = [np.abs(v).min() if n > HEAD else 0.0 for n, (_, v) in zip(entries, cells, strict=True)]
    return _Centres(table, _heads(cells, np.sqrt(squares))._replace(rest=np.array(rest)))


def _exact(rows: DataFrame, centres: _Centres) -> DataFrame:
    """Labels of the rows that heads leave open, by joining their cells to all entries of the centres."""
    norms = centres.heads.norms
    labels = range(len(norms))
    entries = centres.table.groupBy("dim").agg(
        *[F.sum(F.when(F.col("label") == j, F.col("value"))).alias(f"c{j}") for j in labels]
    )
    dots = (
        _cells(rows.select("row_id", "dims", "values"))
        .join(shuffled(entries), "dim", "left")
        .groupBy("row_id")
        .agg(
            F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"),
            *[F.sum(F.col("value") * F.coalesce(f"c{j}", F.lit(0.0))).alias(f"_d{j}") for j in labels],
        )
    )
    own = F.col("_norm") * F.col("_norm")
    squares = F.array(*[own + F.lit(float(norms[j] * norms[j])) - 2 * F.col(f"_d{j}") for j in labels])
    nearest = (F.array_position(squares, F.array_min(squares)) - 1).cast("int")
    found = dots.select(F.col("row_id").alias("_id"), nearest.alias("label"))
    return rows.drop("label").join(shuffled(found), F.col("row_id").eqNullSafe(F.col("_id"))).select(
        "row_id", "dims", "values", "label"
    )


def _elsewhere(rows: DataFrame, centres: _Centres, usual: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (row_id, dims, values, label) that are not nearest to the centre ``usual``, and the stored tables."""
    sent = rows.sparkSession.sparkContext.broadcast(centres.heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = _labels(_Batch.of(batch), sent.value)
            other = np.flatnonzero(labels != usual)
            if len(other):
                taken = batch.take(pa.array(other))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(labels[other], pa.int32())], names=[*batch.schema.names, "label"]
                )

    kind = rows.schema["row_id"].dataType.simpleString()
    found = scratch.keep(
        rows.select("row_id", "dims", "values").mapInArrow(
            run, f"row_id {kind}, dims array<int>, values array<double>, label int"
        )
    )
    sent.unpersist()
    still_open = found.where("label < 0")
    if not centres.heads.rest.any() or still_open.isEmpty():
        return found, [found]
    settled = scratch.keep(_exact(still_open, centres).where(F.col("label") != usual))
    return found.where("label >= 0").unionByName(settled), [found, settled]


class Fit(NamedTuple):
    centres: DataFrame  # label, dim, value
    labels: DataFrame  # row_id, label
    cost: float  # of the last iteration, to the centres before it
    iterations: int
    stored: DataFrame  # what the centres are read from, to be dropped after them


def fit(
    rows: DataFrame, k: int, max_iter: int, whole: Totals, scratch: Scratch, tolerance: float = 1e-4
) -> Fit:
    """K-means of stored rows (row_id, dims, values).

    An iteration reads the rows once and stores those that leave the largest cluster; a row whose
    heads do not decide is joined to the centres' entries.  The sums of the largest cluster are all
    sums without the others'.
    """
    spark = rows.sparkSession
    first = _start(rows, k, whole)
    table = scratch.keep(
        spark.createDataFrame(
            [(label, int(d), float(v)) for label, own in enumerate(first) for d, v in zip(*own, strict=True)],
            "label int, dim int, value double",
        ).coalesce(1)
    )
    centres = _centres(table, [len(d) for d, _ in first], [float((v * v).sum()) for _, v in first])
    sizes = [0] * len(first)
    usual = int(centres.heads.norms.argmin())
    cost, iteration, moved = 0.0, 0, np.inf
    assigned = None
    while iteration < max_iter and moved > tolerance * tolerance:
        if assigned is not None:
            scratch.drop(*assigned[2])
        assigned = usual, *_elsewhere(rows, centres, usual, scratch)
        other = assigned[1]
        counted = dict(other.groupBy("label").count().collect())  # K rows
        sizes = [counted.get(label, 0) for label in range(len(sizes))]
        sizes[usual] = whole.rows - sum(sizes)
        nothing = F.lit(0.0)
        taken = _cells(other.drop("row_id")).select("label", "dim", nothing.alias("old"), F.col("value").alias("s"))
        parts = (
            centres.table.select("label", "dim", F.col("value").alias("old"), nothing.alias("s"))
            .unionByName(taken)
            .unionByName(taken.withColumns({"label": F.lit(usual), "s": -F.col("s")}))
            .unionByName(whole.table.select(F.lit(usual).alias("label"), "dim", nothing.alias("old"), "s"))
        )
        shares = _by_label([1.0 / n if n else 0.0 for n in sizes])
        # a centre without rows stays where it is
        mean = F.when(_by_label(sizes) > 0, F.col("s") * shares).otherwise(F.col("old"))
        both = scratch.keep(
            parts.groupBy("label", "dim")
            .agg(F.sum("old").alias("old"), F.sum("s").alias("s"))
            .withColumn("value", mean)
        )
        step = F.col("value") - F.col("old")
        sums = both.groupBy("label").agg(
            F.sum(step * step).alias("moved"),
            F.sum(F.col("old") * F.col("s")).alias("cross"),
            F.sum(F.col("value") * F.col("value")).alias("squares"),
            F.count_if(F.col("value") != 0).alias("entries"),
        )
        sums = {r["label"]: r for r in sums.collect()}  # K rows
        norms = centres.heads.norms
        cost = whole.squares
        for label, n in enumerate(sizes):
            if label in sums:
                cost += n * norms[label] ** 2 - 2 * sums[label]["cross"]
        moved = max((r["moved"] for r in sums.values()), default=0.0)
        of = lambda field, none: [sums[j][field] if j in sums else none for j in range(len(sizes))]  # noqa: E731, B023
        centres = _centres(both.where("value <> 0").select("label", "dim", "value"), of("entries", 0), of("squares", 0.0))
        scratch.drop(table)
        table = both
        usual = int(np.argmax(sizes))
        iteration += 1
    if assigned is None or moved > 0:
        if assigned is not None:
            scratch.drop(*assigned[2])
        assigned = usual, *_elsewhere(rows, centres, usual, scratch)
    # centres that did not move at all keep their rows
    usual, other, stored = assigned
    found = other.select(F.col("row_id").alias("_id"), F.col("label").alias("_label"))
    labels = scratch.keep(
        rows.select("row_id")
        .join(shuffled(found), F.col("row_id").eqNullSafe(F.col("_id")), "left")
        .select("row_id", F.coalesce("_label", F.lit(usual)).alias("label"))
    )
    scratch.drop(*stored)
    # less is rounding
    cost = float(cost) if cost > 1e-12 * whole.squares else 0.0
    return Fit(centres.table.withColumn("dim", F.col("dim").cast("long")), labels, cost, iteration, table)
