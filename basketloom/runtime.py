"""Session-level helpers: shared scratch space, lineage cuts and hot-key handling.

Iterative jobs write each round as Parquet below the folder the session names in
``spark.checkpoint.dir``.  Parquet (rather than ``Dataset.checkpoint``) keeps column pruning,
footer row counts and size statistics for the next round, and it outlives lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key with more rows than this is split over several tasks.  At most
# rows / HOT_ROWS keys can be hot, which is what bounds the broadcast of hot keys.
HOT_ROWS = 4_000_000

_local_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the session configures it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    in_use = spark.sparkContext._jsc.sc().getCheckpointDir()
    if in_use.isDefined():
        return in_use.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = "file://" + tempfile.mkdtemp(prefix="basketloom-")
    return _local_root[app]


class Scratch:
    """Numbered Parquet tables of one job under the checkpoint folder."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/basketloom/{job}-{uuid.uuid4().hex}"
        self._n = 0
        self._stored: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write ``df`` and return a frame that reads it back, free of lineage."""
        path = f"{self.base}/{self._n:04d}"
        self._n += 1
        df.write.partitionBy(*partition_by).parquet(path)
        # the read schema is given, so no footer is opened for inference
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._stored[id(stored)] = (stored, path)
        return stored

    def next_number(self) -> int:
        self._n += 1
        return self._n

    def path_of(self, stored: DataFrame) -> str:
        return self._stored[id(stored)][1]

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Add ``df`` to the growing table ``name`` and return a frame with the new rows only."""
        path = f"{self.base}/{name}/part={self._n}"
        self._n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def whole(self, name: str, like: DataFrame) -> DataFrame:
        """All rows added to ``name`` so far, as one scan however many rounds there were."""
        table = self.spark.read.schema(like.schema).parquet(f"{self.base}/{name}")
        return table.select(*like.columns)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of superseded rounds that no live frame reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            _, path = self._stored.pop(id(frame), (None, None))
            if path is not None:
                hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
                hadoop_path.getFileSystem(conf).delete(hadoop_path, True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition input that comes in fewer splits than there are cores.

    For work that costs far more per row than moving the row does.  Input of many files or many
    splits is left where it is; only file sizes are looked at.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for file in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df if size >= cores * split else df.repartition(cores)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data and is never broadcast.

    Broadcasts go by the estimated size of files; ids that compress well stay below the limit however
    many rows they are, and all of them would pass through the driver.
    """
    return df.hint("merge")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``hot_rows`` rows, with the number of splits each one needs."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_splits"))
    )


def split_hot(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``_split``: 0 for ordinary keys, a hash of ``by`` for keys above ``hot_rows``."""
    hot = hot_keys(df, keys, hot_rows)
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            "_split",
            F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*by), F.col("_splits")).cast("int")
            ),
        )
        .drop("_splits")
    )


def join_counted(
    rows: DataFrame,
    counted: DataFrame,
    key: str | Sequence[str] = "item_id",
    count: str = "count",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join of rows to one entry per key that also knows how many rows the key has.

    The counts already say which keys are hot, so no extra pass over the rows is needed.  Hot keys
    (at most rows / hot_rows of them) are broadcast to salt their rows and replicated per salt.
    """
    keys = [key] if isinstance(key, str) else list(key)
    splits = F.ceil(F.col(count) / hot_rows).cast("int")
    hot = counted.where(F.col(count) > hot_rows).select(*keys, splits.alias("_splits"))
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*rows.columns), F.col("_splits")).cast("int")
            ),
        )
        .drop("_splits")
    )
    replicated = counted.withColumn(
        "_salt",
        F.explode(
            F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), splits - 1)).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return salted.join(replicated, [*keys, "_salt"]).drop("_salt")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames of numbers side by side (a union and an aggregate, no join)."""
    both = frames[0]
    for frame in frames[1:]:
        both = both.unionByName(frame, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def number_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos"
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... by ``order`` without sorting a hot key in one task.

    The rows are dealt out by ranges of (keys, order) and stored, each range is numbered on its
    own, and the sizes of a key's ranges before it are added.  The numbers are the same however
    many ranges a key falls into.
    """
    scratch = Scratch(df.sparkSession, "numbers")
    ranged = scratch.keep(
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a range begins inside one key at most, so there is at most one offset per shuffle partition
    offsets = (
        sizes.withColumn("_before", F.sum("_n").over(before))
        .where(F.col("_before").isNotNull())
        .select(*keys, "_range", "_before")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn(out, F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), [*keys, "_range"], "left")
        .withColumn(out, (F.col(out) + F.coalesce(F.col("_before"), F.lit(0))).cast("long"))
        .drop("_before", "_range")
    )


def dense_ids(df: DataFrame, order: Sequence[str], out: str, start: int = 1) -> DataFrame:
    """Consecutive ids in ``order`` over the whole frame, numbered range by range in parallel.

    ``order`` must identify a row.  The frame is range-sorted and stored once, so that the sizes
    of the ranges and the numbering see the same boundaries.
    """
    scratch = Scratch(df.sparkSession, "ids")
    ranged = scratch.keep(
        df.repartitionByRange(*[F.col(c) for c in order]).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    # one row per shuffle partition
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_range")
        .withColumn(out, (F.col("_rank") + F.col("_before") + (start - 1)).cast("long"))
        .drop("_rank", "_before", "_range")
    )
