"""Counting, core extraction, closures and walks against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketloom.operators import closure, core, counts, curate, walk
from basketloom.runtime import Scratch, dense_ids, join_counted, number_within, spread


def skewed_edges(spark, n=3000, hot_share=0.4, seed=1):
    """Edges in which item 0 holds a large share of all rows."""
    rng = random.Random(seed)
    rows = [
        (i, rng.randrange(n // 4), 0 if rng.random() < hot_share else 1 + int(rng.random() ** 2 * 60))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "edge_id long, basket_id long, item_id long")


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_numbering_is_the_same_for_any_number_of_ranges(spark, ranges):
    rows, edges = skewed_edges(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        numbered = number_within(edges, ["item_id"], ["edge_id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_item = defaultdict(list)
    for edge, _, item in sorted(rows):
        by_item[item].append(edge)
    assert len(numbered) == len(rows)
    assert all(by_item[r["item_id"]][r["pos"]] == r["edge_id"] for r in numbered)


def test_numbering_without_hot_keys_follows_the_order(spark):
    _, edges = skewed_edges(spark, 300)
    numbered = number_within(edges, ["item_id"], ["edge_id"]).collect()
    by_item = defaultdict(list)
    for r in numbered:
        by_item[r["item_id"]].append((r["pos"], r["edge_id"]))
    for pairs in by_item.values():
        ids = [e for _, e in sorted(pairs)]
        assert ids == sorted(ids)


def test_salted_join_equals_plain_join(spark):
    _, edges = skewed_edges(spark)
    per_item = edges.groupBy("item_id").agg(F.count("*").alias("count"))
    salted = join_counted(edges, per_item, hot_rows=50)
    assert sorted(map(tuple, salted.select("edge_id", "item_id", "count").collect())) == sorted(
        map(tuple, edges.join(per_item, "item_id").select("edge_id", "item_id", "count").collect())
    )
    assert sorted(map(tuple, counts.basket_scores(edges, per_item, hot_rows=50).collect())) == sorted(
        map(tuple, counts.basket_scores(edges, per_item).collect())
    )


def test_dense_ids_are_consecutive_in_order(spark):
    names = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("name"))
    rows = dense_ids(names, ["name"], "id", start=7).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["name"])] == list(range(7, 5007))


def test_spread_leaves_frames_without_files_alone(spark):
    df = spark.range(10)
    assert spread(df) is df


@pytest.mark.parametrize("fraction", [0.05, 0.3, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_exact_threshold(spark, fraction, bins):
    rng = random.Random(5)
    scores = [rng.choice([1, 2, 3, 50, 51, 1000, 10**6]) for _ in range(500)]
    histogram = spark.createDataFrame(list(Counter(scores).items()), "score long, n long")
    rank = max(math.ceil((1.0 - fraction) * len(scores)), 1)
    assert counts.exact_threshold(histogram, fraction, bins) == sorted(scores)[rank - 1]


def test_thresholds_of_nothing(spark):
    empty = spark.createDataFrame([], "score long, n long")
    assert counts.exact_threshold(empty, 0.5) is None
    assert counts.halving_threshold(empty, 0.5) is None


def brute_halving(scores, fraction):
    low, high = min(scores), max(scores)
    t, step, sign = low // 2, (high - low) // 4, 1
    while step > 0:
        t += sign * step
        sign = 1 if sum(s >= t for s in scores) > int(len(scores) * fraction) else -1
        step //= 2
    return t


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.9])
def test_halving_threshold(spark, fraction):
    scores = [(i * i) % 97 + 3 for i in range(400)]
    histogram = spark.createDataFrame(list(Counter(scores).items()), "score long, n long")
    assert counts.halving_threshold(histogram, fraction) == brute_halving(scores, fraction)


def test_core_shrinks_and_stays_consistent(spark):
    _, edges = skewed_edges(spark)
    baskets = edges.select("basket_id").distinct()
    items = edges.select("item_id").distinct().withColumn(
        "item_name", F.concat(F.lit("item "), F.translate(F.col("item_id").cast("string"), "0123456789", "abcdefghij"))
    )
    found = core.extract_core(
        spark, baskets, counts.count_items(items, edges), edges, wanted=100, rounds=3
    )
    sizes = [(r["baskets"], r["edges"], r["items"]) for r in found.rounds.orderBy("round").collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert found.edges.join(found.baskets, "basket_id", "left_anti").isEmpty()
    kept = {r["item_id"]: r["count"] for r in found.items.collect()}
    assert kept == dict(
        (r["item_id"], r["count"]) for r in found.edges.groupBy("item_id").count().collect()
    )


def test_core_of_nothing(spark):
    none = spark.createDataFrame([], "edge_id long, basket_id long, item_id long")
    items = spark.createDataFrame([], "item_id long, item_name string, count long")
    found = core.extract_core(spark, none.select("basket_id"), items, none, wanted=5)
    assert found.rounds.count() == 0


def test_good_names(spark):
    names = ["red widget", "salt, fine", "Oil & fat", "each apple", "peach", "2 eggs", "a or b", "or b",
             "chef's mix", "mix*", "(x", "some more left", "any kind", "company x", None]
    df = spark.createDataFrame([(n,) for n in names], "item_name string")
    kept = {r["item_name"] for r in counts.filter_item_names(df).collect()}
    assert kept == {"red widget", "peach", "or b"}


def mapping_frame(spark, mapping):
    return spark.createDataFrame(list(mapping.items()), "subject_id long, object_id long")


def test_long_chain_closes(spark):
    found = closure.close_mapping(mapping_frame(spark, {i: i + 1 for i in range(200)}))
    assert found.cycles.isEmpty()
    assert {r["object_id"] for r in found.mapping.collect()} == {200}
    again = closure.close_mapping(found.mapping)
    assert sorted(again.mapping.collect()) == sorted(found.mapping.collect())


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 12])
def test_cycles_of_any_length_are_found(spark, length):
    mapping = {i: (i + 1) % length for i in range(length)}
    mapping |= {100: 0, 101: 100, 300: 301, 301: 302}
    found = closure.close_mapping(mapping_frame(spark, mapping))
    assert {r["subject_id"] for r in found.cycles.collect()} == set(range(length))
    assert dict(map(tuple, found.mapping.collect())) == mapping


def test_doubling_does_not_pass_through_the_driver(spark, monkeypatch):
    plans, keep = [], Scratch.keep

    def watched(self, df, *more, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, *more, **named)

    monkeypatch.setattr(Scratch, "keep", watched)
    mapping = mapping_frame(spark, {0: 1, 1: 0} | {i: i + 1 for i in range(2, 20)})
    found = closure.close_mapping(mapping)
    assert {r["subject_id"] for r in found.cycles.collect()} == {0, 1}
    doubled = [p for p in plans if "_next" in p]
    assert doubled and not any("BroadcastHashJoin" in p for p in doubled)


def test_canonical_job_names_a_cycle(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, item_name string")
    relations = spark.createDataFrame(
        [(1, "alias:spacing", 2), (2, "alias:plural-of", 1), (3, "alias:singular-of", 1)],
        "subject_id long, predicate string, object_id long",
    )
    with pytest.raises(ValueError, match="a.*b"):
        closure.canonical_items_job(relations, items.select("item_id"), items)


def brute_validity(vocabulary, aliases, childofs):
    valid = dict(vocabulary)
    arrows = [*aliases, *((b, a) for a, b in aliases), *((p, c) for c, p in childofs)]
    todo = [n for n, v in valid.items() if v == 1]
    into = defaultdict(list)
    for a, b in arrows:
        into[a].append(b)
    while todo:
        for b in into[todo.pop()]:
            if valid.get(b) == 0:
                valid[b] = 1
                todo.append(b)
    return valid


@pytest.mark.parametrize("near_rounds", [0, 2])
@pytest.mark.parametrize("seed", range(3))
def test_validity_equals_brute_force(spark, monkeypatch, near_rounds, seed):
    monkeypatch.setattr(closure, "NEAR_ROUNDS", max(near_rounds, 1))
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(150)]
    vocabulary = [(n, rng.choice([0] * 12 + [-1, 1])) for n in names]
    pick = lambda: (rng.choice([*names, "unknown"]), rng.choice(names))
    aliases, childofs = [pick() for _ in range(25 + 30 * seed)], [pick() for _ in range(100)]
    found = closure.propagate_validity(
        spark.createDataFrame(vocabulary, "name string, valid tinyint"),
        spark.createDataFrame(aliases, "alias string, ingredient string"),
        spark.createDataFrame(childofs, "child string, parent string"),
    )
    assert dict(found.select("name", "valid").collect()) == brute_validity(vocabulary, aliases, childofs)


@pytest.mark.parametrize("kind", ["childof", "alias", "ladder"])
def test_long_chains_take_few_rounds(spark, monkeypatch, kind):
    n = 10_000
    rows = spark.range(n)
    vocabulary = rows.select(
        F.col("id").cast("string").alias("name"), F.when(F.col("id") == 0, 1).otherwise(0).cast("tinyint").alias("valid")
    )
    step = lambda by: rows.select(
        (F.col("id") + by).cast("string").alias("child"), F.col("id").cast("string").alias("parent")
    )
    arrows = step(1).unionByName(step(3)) if kind == "ladder" else step(1)
    nothing = arrows.limit(0)
    aliases = (arrows if kind == "alias" else nothing).toDF("alias", "ingredient")
    rounds = []
    for name in ("keep", "add"):
        plain = getattr(Scratch, name)
        monkeypatch.setattr(
            Scratch, name, lambda *a, plain=plain, **k: (rounds.append(1), plain(*a, **k))[1]
        )
    found = closure.propagate_validity(vocabulary, aliases, nothing if kind == "alias" else arrows)
    assert found.where("valid <> 1").count() == 0
    # a round of contraction stores two tables, and one when it is played back
    assert len(rounds) <= (70 if kind == "alias" else 30)


def test_validity_is_monotone_and_skips_invalid_names(spark):
    rng = random.Random(3)
    valid = {f"n{i}": rng.choice([-1, 0, 0, 0, 1]) for i in range(80)}
    names = list(valid)
    aliases = [(rng.choice(names), rng.choice(names)) for _ in range(50)]
    children = [(rng.choice(names), rng.choice(names)) for _ in range(50)]
    expected = dict(valid)
    changed = True
    while changed:
        changed = False
        links = [(a, b) for a, b in aliases] + [(b, a) for a, b in aliases]
        for source, target in links + [(p, c) for c, p in children]:
            if expected[source] == 1 and expected[target] == 0:
                expected[target], changed = 1, True
    vocabulary = spark.createDataFrame(list(valid.items()), "name string, valid byte")
    found = closure.propagate_validity(
        vocabulary,
        spark.createDataFrame(aliases, "alias string, ingredient string"),
        spark.createDataFrame(children, "child string, parent string"),
    )
    assert {r["name"]: r["valid"] for r in found.collect()} == expected


def test_validated_baskets_need_all_items(spark):
    edges = spark.createDataFrame(
        [(1, 1, 10), (2, 1, 11), (3, 2, 10), (4, 2, 12), (5, 3, 12), (6, None, 10), (7, 4, None)],
        "edge_id long, basket_id long, item_id long",
    )
    ok = spark.createDataFrame([(10,), (11,), (10,)], "item_id long")
    assert [r["basket_id"] for r in curate.validated_baskets(edges, ok).collect()] == [1]


def test_respecting_invalid_names(spark):
    vocabulary = spark.createDataFrame([("a", -1), ("b", 0)], "name string, valid byte")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    marked, unmatched = curate.mark_known_valid(vocabulary, known, respect_invalid=True)
    assert sorted(map(tuple, marked.collect())) == [("a", -1), ("b", 1)]
    assert [r["name"] for r in unmatched.collect()] == ["c"]


def walk_edges(spark):
    rows, _ = skewed_edges(spark, 600)
    return {(b, i) for _, b, i in rows}, spark.createDataFrame(
        [(e, b, i) for e, b, i in rows], "edge_id long, basket_id long, canonical_id long"
    )


@pytest.mark.parametrize(("shards", "hot_rows"), [(1, 4_000_000), (4, 20)])
def test_walks_follow_edges_and_repeat(spark, shards, hot_rows):
    pairs, edges = walk_edges(spark)
    options = dict(n_samples=10**6, walkers=5, steps=4, seed=9, shards=shards, hot_rows=hot_rows, p_restart=0.3)
    visits = [sorted(map(tuple, walk.walk_baskets(edges, **options).collect())) for _ in range(2)]
    assert visits[0] == visits[1]
    assert len(visits[0]) == 5 * 5
    items_of = defaultdict(set)
    for basket, item in pairs:
        items_of[basket].add(item)
    at = {(w, s): basket for w, s, basket in visits[0]}
    for (walker, step), basket in at.items():
        if step:
            # one step away from where the walker was, or from its start
            assert items_of[basket] & (items_of[at[walker, step - 1]] | items_of[at[walker, 0]])


def test_walk_from_a_given_basket_stops_at_the_sample_size(spark):
    _, edges = walk_edges(spark)
    first = edges.first()["basket_id"]
    visits = walk.walk_baskets(edges, n_samples=6, walkers=2, steps=30, first_basket=first)
    chosen = [r["basket_id"] for r in walk.sampled_baskets(visits, 6).collect()]
    assert len(set(chosen)) == 6 and first in chosen
    assert visits.where("step = 0").select("basket_id").distinct().count() == 1


def test_draws_are_even(spark):
    draws = spark.range(20000).select(F.pmod(walk.seeded_number(4, "id"), F.lit(8)).alias("d"))
    sizes = [r["count"] for r in draws.groupBy("d").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.15 * min(sizes)


def test_scratch_drops_only_its_own_tables(spark):
    scratch = Scratch(spark, "test")
    a, b = scratch.keep(spark.range(5)), scratch.keep(spark.range(7))
    scratch.drop(a, spark.range(3))
    assert b.count() == 7
    with pytest.raises(Exception):
        a.count()


def test_a_step_of_a_walk_does_not_read_the_adjacency_in_one_task(spark, monkeypatch):
    plans, keep = [], walk.Scratch.keep

    def noted(self, df, partition_by=()):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, df, partition_by)

    monkeypatch.setattr(walk.Scratch, "keep", noted)
    edges = spark.createDataFrame([(k, k % 3) for k in range(12)], "basket_id long, canonical_id long")
    walk.walk_baskets(edges, n_samples=100, walkers=2, steps=2)
    steps = [plan for plan in plans if "degree" in plan and "walker" in plan]
    assert len(steps) == 2
    # "Repartition 1, false" is a coalesce: it takes the scan below it along into its task
    assert not any("Repartition 1, false" in plan for plan in steps)


def test_canonical_edges_and_adjacency_do_not_pass_through_the_driver(spark, monkeypatch):
    plans, keep = [], Scratch.keep

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(self, df, partition_by=()):
        plans.append(plan(df))
        return keep(self, df, partition_by)

    monkeypatch.setattr(Scratch, "keep", noted)
    # ranges are known to be small, so they would be broadcast
    items = spark.range(20).select(F.col("id").alias("item_id"), F.format_string("item %d", "id").alias("item_name"))
    valid = items.where("item_id <> 13").select("item_id")
    edges = spark.range(100).selectExpr("id AS edge_id", "id % 30 AS basket_id", "id % 20 AS item_id")
    relations = spark.range(5).selectExpr("id AS subject_id", "'alias:spacing' AS predicate", "id + 1 AS object_id")
    canonical = closure.canonical_items_job(relations, valid, items)
    chosen = curate.canonical_edges(edges, curate.validated_baskets(edges, valid), canonical)
    assert "BroadcastHashJoin" not in plan(chosen)
    assert not any("BroadcastHashJoin" in p for p in plans)
    baskets = {e % 30 for e in range(100)} - {e % 30 for e in range(100) if e % 20 == 13}
    wanted = {(e, e % 30, 5 if e % 20 < 5 else e % 20) for e in range(100) if e % 30 in baskets}
    assert sorted(map(tuple, chosen.collect())) == sorted(wanted)
    plans.clear()
    walk.adjacency(chosen, Scratch(spark, "test"))
    salted = [line for p in plans for line in p.splitlines() if "_salt" in line and "Join" in line]
    assert len(salted) == 2 and not any("BroadcastHashJoin" in line for line in salted)
    # the edges are worked out once
    assert sum("edge_id" in p for p in plans) == 1
