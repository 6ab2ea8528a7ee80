"""Sampling connected baskets by seeded random walks with restart."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketloom.runtime import HOT_ROWS, Scratch, join_counted, number_within, shuffled

# Positions of at most so many walkers are broadcast to the adjacency; more are joined by shuffling.
SENT_WALKERS = 100_000
# After so many steps without a new basket it is checked whether there is any left to find.
IDLE_STEPS = 5


def seeded_number(seed: int, *parts: str | Column) -> Column:
    """A non-negative integer that depends on the seed and the parts only."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(seed).cast("string"), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def random_rows(df: DataFrame, keys: list[str], n: int = 1, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded random order; a top-k, so nothing is sorted as a whole."""
    return df.orderBy(seeded_number(seed, *keys), *keys).limit(n)


class Adjacency(NamedTuple):
    by_basket: DataFrame  # basket_id, canonical_id, pos, degree, shard
    by_item: DataFrame  # canonical_id, basket_id, pos, degree, shard


def adjacency(
    edges: DataFrame, scratch: Scratch, shards: int = 1, hot_rows: int = HOT_ROWS
) -> Adjacency:
    """Both directions of the graph with numbered neighbours.

    A basket lists its distinct items; an item lists its rows.  Tables are stored in ``shards``
    folders by key hash, so that a step opens only the folders its walkers stand in.
    """

    def stored(df: DataFrame, key: str, order: str) -> DataFrame:
        numbered = number_within(df, [key], [order])
        degrees = df.groupBy(key).agg(F.count("*").alias("degree"))
        shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
        table = join_counted(numbered, shuffled(degrees), key, "degree", hot_rows).withColumn("shard", shard)
        return scratch.keep(table, partition_by=["shard"])

    # each direction reads the edges twice
    pairs = scratch.keep(edges.select("basket_id", "canonical_id"))
    graph = Adjacency(
        stored(pairs.distinct(), "basket_id", "canonical_id"),
        stored(pairs, "canonical_id", "basket_id"),
    )
    scratch.drop(pairs)
    return graph


def _hop(
    walkers: DataFrame, table: DataFrame, key: str, to: str, draw: Column, shards: int, n: int
) -> DataFrame:
    """Move every walker from its ``key`` to the neighbour that ``draw`` picks evenly."""
    if shards > 1:
        shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
        visited = [r[0] for r in walkers.select(shard).distinct().collect()]
        table = table.where(F.col("shard").isin(visited))
    drawn = walkers.select("walker", "start", F.col(key).alias("_at"), draw.alias("_draw"))
    # the neighbour is picked inside the join
    return table.join(
        F.broadcast(drawn) if n <= SENT_WALKERS else drawn,
        (table[key] == F.col("_at")) & (table["pos"] == F.pmod("_draw", table["degree"])),
    ).select("walker", "start", to)


def _closed(seen: DataFrame, graph: Adjacency) -> bool:
    """Whether every basket that shares an item with a seen one is seen."""
    items = graph.by_basket.join(seen, "basket_id").select("canonical_id").distinct()
    reached = graph.by_item.join(items, "canonical_id").select("basket_id")
    return reached.join(seen, "basket_id", "left_anti").isEmpty()


def walk_baskets(
    edges: DataFrame,
    n_samples: int = 50,
    p_restart: float = 0.1,
    first_basket: int | None = None,
    walkers: int = 16,
    steps: int | None = None,
    seed: int = 0,
    shards: int = 1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Baskets reached by ``walkers`` walks, as (walker, step, basket_id).

    Each step restarts with probability ``p_restart``, draws one of the basket's items and then
    one of that item's rows.  Draws are hashes of (seed, walker, step), so a run repeats exactly.
    Walking ends once ``n_samples`` distinct baskets are seen, or when no other basket can be
    reached from those seen; ``steps`` ends it earlier where the caller wants that.
    """
    if walkers < 1:
        raise ValueError("there must be a walker")
    spark = edges.sparkSession
    scratch = Scratch(spark, "walk")
    graph = adjacency(edges, scratch, shards, hot_rows)
    ids = spark.range(walkers).select(F.col("id").alias("walker"))
    if first_basket is None:
        # each walker starts at its own random basket
        drawn = random_rows(
            graph.by_basket.where("pos = 0").select("basket_id"), ["basket_id"], walkers, seed
        )
    else:
        drawn = spark.createDataFrame([(first_basket,)], "basket_id long")
    # one row per walker at most
    order = Window.orderBy(seeded_number(seed, "basket_id"), "basket_id")
    starts = scratch.keep(drawn.withColumn("_k", (F.row_number().over(order) - 1).cast("long")))
    n_starts = starts.count()
    if n_starts == 0:
        raise ValueError("there are no edges to walk on")
    at = scratch.keep(
        ids.withColumn("_k", F.pmod("walker", F.lit(n_starts)))
        .join(starts, "_k")
        .select("walker", F.col("basket_id").alias("start"), "basket_id")
        .coalesce(1)
    )
    visit = scratch.add("visits", at.select("walker", F.lit(0).alias("step"), "basket_id"))
    cut = int(p_restart * 0x100000000)

    def draw(step: int, purpose: str) -> Column:
        return seeded_number(seed, "walker", F.lit(step), F.lit(purpose))

    known, idle, step = 0, 0, 0
    while steps is None or step < steps:
        step += 1
        seen = scratch.whole("visits", visit).select("basket_id").distinct()
        n_seen = seen.count()
        if n_seen >= n_samples:
            break
        idle, known = (0 if n_seen > known else idle + 1), n_seen
        if idle == IDLE_STEPS:
            if _closed(seen, graph):
                break
            idle = 0
        restart = draw(step, "restart") < cut
        here = at.select(
            "walker",
            "start",
            F.when(restart, F.col("start")).otherwise(F.col("basket_id")).alias("basket_id"),
        )
        chosen = _hop(
            here, graph.by_basket, "basket_id", "canonical_id", draw(step, "item"), shards, walkers
        )
        moved = _hop(
            chosen, graph.by_item, "canonical_id", "basket_id", draw(step, "basket"), shards, walkers
        )
        # dealt out anew after the join: coalesced, one task would read the whole adjacency
        previous, at = at, scratch.keep(moved.repartition(-(-walkers // SENT_WALKERS)))
        scratch.drop(previous)
        visit = scratch.add(
            "visits", at.select("walker", F.lit(step).alias("step"), "basket_id")
        )
    return scratch.whole("visits", visit)


def sampled_baskets(visits: DataFrame, n_samples: int) -> DataFrame:
    """The first ``n_samples`` distinct baskets in order of (step, walker)."""
    first_seen = visits.groupBy("basket_id").agg(F.min(F.struct("step", "walker")).alias("_at"))
    return first_seen.orderBy("_at", "basket_id").limit(n_samples).select("basket_id")
