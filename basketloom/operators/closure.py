"""Fixpoints over relations: validity, alias closure and cycles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.operators.curate import alias_map, canonical_map, named_alias_edges
from basketloom.runtime import Scratch, shuffled


# rounds that look at the next names only, before whole chains are followed
NEAR_ROUNDS = 4


def contract(edges: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of an undirected graph, for every node that has an edge.

    Every node moves to the neighbour, or itself, that the round's hash puts first, and the edges
    between the nodes left over form the next graph.  That leaves at most three quarters of the nodes
    in expectation, whatever the graph, so the rounds grow with the logarithm of the nodes.
    """
    current = scratch.keep(
        edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    )
    moves: list[DataFrame] = []
    while not current.isEmpty():
        salt = F.lit(len(moves))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64(salt, "b").alias("h"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64(salt, F.col("a")).alias("h"), F.col("a").alias("to"))
        moved = scratch.keep(
            both.groupBy("a").agg(first.alias("first")).select("a", F.least("first", own)["to"].alias("to"))
        )
        moves.append(moved)
        ends = current.join(moved, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        ends = ends.join(moved, "a").select("x", F.col("to").alias("y"))
        left_over = scratch.keep(
            ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        scratch.drop(current)
        current = left_over
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # from the last graph back: where the nodes that were left over went in the end
    ends = moves[-1]
    for n, moved in enumerate(reversed(moves[:-1]), 1):
        later = ends.select(F.col("a").alias("to"), F.col("to").alias("end"))
        ends = moved.join(later, "to", "left").select("a", F.coalesce("end", "to").alias("to"))
        # a few joins go into one plan
        ends = scratch.keep(ends) if n % 4 == 0 else ends
    return ends.select(F.col("a").alias("node"), F.col("to").alias("component"))


def reachable(arrows: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """All nodes that ``sources`` (node) lead to along ``arrows`` (node, to), sources included.

    A few rounds follow the next arrow of what was found last.  Where that does not end, pointers are
    doubled: every open node points to one of its predecessors, drawn anew each time, and takes over
    its pointer until a found node, an end or a cycle is met.  A chain of length n is thereby found in
    log2(n) rounds.
    """
    name = f"found-{scratch.next_number()}"
    arrows = scratch.keep(arrows.select("node", "to").where("node <> to").distinct())
    # what was found last, whose next arrows have not been followed yet
    fresh = scratch.add(name, sources.select("node").distinct())
    near = draws = 0
    while True:
        found = scratch.whole(name, fresh)
        if near < NEAR_ROUNDS:
            near += 1
            next_nodes = arrows.join(fresh, "node", "left_semi").select(F.col("to").alias("node")).distinct()
            fresh = scratch.add(name, next_nodes.join(found, "node", "left_anti"))
            if fresh.isEmpty():
                break
            continue
        near, draws = 0, draws + 1
        one = F.min(F.struct(F.xxhash64(F.lit(draws), "node").alias("h"), "node"))["node"]
        pointers = (
            arrows.join(found.withColumnRenamed("node", "to"), "to", "left_anti")
            .groupBy("to")
            .agg(one.alias("from"))
            .select(F.col("to").alias("node"), "from")
        )
        hit = found.select(F.col("node").alias("from"), F.lit(True).alias("hit"))
        current = scratch.keep(
            pointers.join(hit, "from", "left").select("node", "from", F.coalesce("hit", F.lit(False)).alias("hit"), F.lit(True).alias("moved"))
        )
        for _ in range(max(current.count(), 1).bit_length() + 1):
            step = current.select(F.col("node").alias("from"), F.col("from").alias("_from"), F.col("hit").alias("_hit"))
            follows = ~F.col("hit") & F.col("_from").isNotNull()
            jumped = scratch.keep(
                current.join(shuffled(step), "from", "left").select(
                    "node",
                    F.when(follows, F.col("_from")).otherwise(F.col("from")).alias("from"),
                    F.when(follows, F.col("_hit")).otherwise(F.col("hit")).alias("hit"),
                    follows.alias("moved"),
                )
            )
            scratch.drop(current)
            current = jumped
            if current.where("moved").isEmpty():
                break
        fresh = fresh.unionByName(scratch.add(name, current.where("hit").select("node")))
    return scratch.whole(name, fresh)


def propagate_validity(
    vocabulary: DataFrame, aliases: DataFrame, childofs: DataFrame
) -> DataFrame:
    """Spread validity over aliases (both ways) and from parents to children until it is stable.

    ``aliases`` has (alias, ingredient) and ``childofs`` has (child, parent).  Invalid entries
    neither change nor pass anything on.  Open names that aliases connect share one fate, so they are
    contracted to components first; what remains are arrows from parents to children between them.
    """
    scratch = Scratch(vocabulary.sparkSession, "validity")
    open_names = scratch.keep(vocabulary.where(F.col("valid") == 0).select("name").distinct())
    valid_names = vocabulary.where(F.col("valid") == 1).select("name").distinct()
    both = aliases.select(F.col("alias").alias("from"), F.col("ingredient").alias("name"))
    both = both.unionByName(both.select(F.col("name").alias("from"), F.col("from").alias("name")))
    both = scratch.keep(both.where(F.col("from") != F.col("name")).join(open_names, "name", "left_semi"))
    down = childofs.select(F.col("parent").alias("from"), F.col("child").alias("name"))
    down = scratch.keep(down.where(F.col("from") != F.col("name")).join(open_names, "name", "left_semi"))
    among = lambda rows: rows.join(open_names.withColumnRenamed("name", "from"), "from", "left_semi")
    components = contract(among(both), scratch, "from", "name")
    component = open_names.join(components.withColumnRenamed("node", "name"), "name", "left").select(
        "name", F.coalesce("component", "name").alias("component")
    )
    component = scratch.keep(component)
    given = both.unionByName(down).join(valid_names.withColumnRenamed("name", "from"), "from", "left_semi")
    sources = given.join(component, "name").select(F.col("component").alias("node"))
    arrows = (
        among(down)
        .join(component, "name")
        .select("from", F.col("component").alias("to"))
        .join(component.select(F.col("name").alias("from"), "component"), "from")
        .select(F.col("component").alias("node"), "to")
    )
    reached = component.join(
        reachable(arrows, sources, scratch).withColumnRenamed("node", "component"), "component", "left_semi"
    ).select("name")
    return (
        vocabulary.join(reached.withColumn("_reached", F.lit(1)), "name", "left")
        .withColumn(
            "valid",
            F.when(F.col("_reached").isNotNull(), F.lit(1))
            .otherwise(F.col("valid"))
            .cast("tinyint"),
        )
        .select(*vocabulary.columns)
    )


class Closure(NamedTuple):
    mapping: DataFrame
    cycles: DataFrame


def close_mapping(mapping: DataFrame, key: str = "subject_id", value: str = "object_id") -> Closure:
    """Follow a one-valued mapping to its ends by pointer doubling.

    Every round joins the mapping to itself, so a chain of length n takes log2(n) rounds.  Keys
    that come back to themselves are returned as cycles; when there are any, the mapping is the
    one that was given.
    """
    scratch = Scratch(mapping.sparkSession, "closure")
    current = scratch.keep(mapping.select(key, value))
    # a chain without a cycle has settled by then
    for _ in range(max(current.count(), 1).bit_length() + 2):
        step = current.select(F.col(key).alias(value), F.col(value).alias("_next"))
        jumped = scratch.keep(
            current.join(shuffled(step), value, "left").select(
                key,
                F.coalesce("_next", value).alias(value),
                F.col("_next").isNotNull().alias("_moved"),
            )
        )
        scratch.drop(current)
        current = jumped
        if current.where("_moved").isEmpty():
            return Closure(current.select(key, value), current.limit(0).select(key))
    return Closure(mapping, cycle_members(mapping, key, value))


def cycle_members(
    mapping: DataFrame, key: str = "subject_id", value: str = "object_id"
) -> DataFrame:
    """All keys that come back to themselves under a one-valued mapping.

    After enough doublings every pointer that still leads to a key points into a cycle, and the
    keys of a cycle are exactly the ones that are pointed to.
    """
    scratch = Scratch(mapping.sparkSession, "cycles")
    current = scratch.keep(mapping.select(key, value))
    for _ in range(max(current.count(), 1).bit_length() + 1):
        step = current.select(F.col(key).alias(value), F.col(value).alias("_next"))
        # pointers that leave the keys can not come back and are dropped
        jumped = scratch.keep(
            current.join(shuffled(step), value).select(key, F.col("_next").alias(value))
        )
        scratch.drop(current)
        current = jumped
    return current.select(F.col(value).alias(key)).distinct()


def named_cycles(cycles: DataFrame, items: DataFrame, key: str = "subject_id") -> DataFrame:
    return cycles.join(shuffled(items.withColumnRenamed("item_id", key)), key).select(key, "item_name")


def canonical_items_job(relations: DataFrame, validated: DataFrame, items: DataFrame) -> DataFrame:
    """Alias relations -> canonical map; raises with the names on a cycle if there is one."""
    closure = close_mapping(alias_map(named_alias_edges(relations, items)))
    scratch = Scratch(relations.sparkSession, "alias-cycles")
    on_cycle = scratch.keep(named_cycles(closure.cycles, items))
    if not on_cycle.isEmpty():
        raise ValueError(
            f"{on_cycle.count()} items are on alias cycles, such as {on_cycle.first()['item_name']};"
            f" all of them are in {scratch.path_of(on_cycle)}"
        )
    return canonical_map(validated, items, closure.mapping)
