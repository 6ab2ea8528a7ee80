"""Readers, writers and whole jobs on small files."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from basketloom.operators import curate, relations as rel, star
from basketloom.operators.lines import parse_documents
from basketloom.plans.curation import curate as curate_job, sample
from basketloom.plans.warehouse import build_star, core_export
from basketloom.schemas import DOCUMENT
from basketloom.sources import exports, tables, vocabulary


def write(path, text):
    path.write_text(text)
    return str(path)


def test_vocabulary_files(spark, tmp_path):
    named = write(tmp_path / "v.csv", 'id,name,count,length,valid\n7,"salt, fine",3,10,1\n8,oil,2,3,-1\n')
    rows = {r["name"]: r for r in vocabulary.read_vocabulary(spark, named).collect()}
    assert rows["salt, fine"]["id"] == 7 and rows["oil"]["valid"] == -1
    first_column = write(tmp_path / "w.csv", "ingredient,id,count,length,valid\noil,8,2,3,0\n")
    assert vocabulary.read_vocabulary(spark, first_column).first()["name"] == "oil"
    vocabulary.write_vocabulary(vocabulary.read_vocabulary(spark, named), f"{tmp_path}/out")
    assert vocabulary.read_vocabulary(spark, f"{tmp_path}/out").count() == 2


def test_small_dictionaries(spark, tmp_path):
    modifiers = write(tmp_path / "m.csv", "word\nred\nnew\n")
    assert {r["modifier"] for r in vocabulary.read_modifiers(spark, modifiers).collect()} == {"red", "new"}
    short = write(tmp_path / "a.csv", "abbreviations,expanded\nlg.,large\nevoo,olive oil\n")
    pairs = vocabulary.read_abbreviations(spark, short)
    table = rel.abbreviation_table(spark, pairs).orderBy("pos").collect()
    assert [(r["short"], r["full"]) for r in table] == [("lg.", "large"), ("evoo", "olive oil")]
    names = spark.createDataFrame([("lg. egg",), ("evoo",), ("lg.egg",), ("$ lg.",)], "name string")
    found = {r["subject"]: r["object"] for r in rel.abbreviation_aliases(names, pairs).collect()}
    assert found == {"lg. egg": "large egg", "evoo": "olive oil", "$ lg.": "$ large"}


def test_abbreviations_apply_in_order(spark):
    names = spark.createDataFrame([("a x",)], "name string")
    chained = rel.abbreviation_aliases(names, [("a", "b"), ("b", "c")]).first()
    assert chained["object"] == "c x"
    reverse = rel.abbreviation_aliases(names, [("b", "c"), ("a", "b")]).first()
    assert reverse["object"] == "b x"


def test_abbreviations_equal_replacing_one_by_one(spark):
    rng = random.Random(2)
    parts = ["a", "b", "c", "d.", "(e)", "$f", "g\\h", "tab\tx"]
    phrases = [" ".join(rng.choices(parts, k=rng.choice([1, 1, 2, 3]))) for _ in range(25)]
    entries = [(p, " ".join(rng.choices(parts, k=rng.choice([1, 2])))) for p in phrases]
    names = {" ".join(rng.choices([*parts, ""], k=rng.randint(1, 7))) for _ in range(300)} | {"", " ", "  a  b "}

    def replaced(name):
        for short, full in entries:
            name = re.sub(rf"(?<!\S){re.escape(short)}(?!\S)", lambda _: full, name)
        return name

    frame = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    expected = {n: replaced(n) for n in names if replaced(n) != n}
    assert dict(rel.expand_abbreviations(frame, entries).collect()) == expected
    rows = [(k, *e) for k, e in enumerate(entries)]
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "pos int, s string, f string")
    assert dict(rel.expand_abbreviations(frame, table).collect()) == expected


def test_large_dictionaries_are_joined(spark):
    entries = spark.range(100_000).select(
        F.col("id").alias("pos"), F.concat(F.lit("w"), "id").alias("short"), F.concat(F.lit("word "), "id").alias("full")
    )
    names = spark.createDataFrame([("w7 and w99999 w100000",), ("none",)], "name string")
    found = [tuple(r) for r in rel.abbreviation_aliases(names, entries).collect()]
    assert found == [("w7 and w99999 w100000", "alias:abbreviation", "word 7 and word 99999 w100000")]


def test_edges_and_triples(spark, tmp_path):
    child = vocabulary.read_child_of(spark, write(tmp_path / "c.csv", "child,parent\na,b\na,c\na,b\n"))
    maps = vocabulary.multimap(child, "child", "parent").collect()
    assert [(r["child"], r["values"]) for r in maps] == [("a", ["b", "c"])]
    aliases = vocabulary.read_aliases(spark, write(tmp_path / "al.csv", "alias,ingredient\nx,y\n"))
    assert aliases.first()["ingredient"] == "y"
    triples = vocabulary.read_triples(spark, write(tmp_path / "t.csv", "a,alias:spacing,b\n"))
    assert tuple(triples.first()) == ("a", "alias:spacing", "b")
    pairs = vocabulary.read_pairs(spark, write(tmp_path / "p.csv", "1,2\n1,3\n"))
    assert pairs.count() == 2


def test_a_key_of_any_size_is_one_row(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("v"),
    )
    sets = {r["k"]: r["values"] for r in vocabulary.multimap(rows.union(rows), "k", "v").collect()}
    assert len(sets) == 8 and sets["hot"] == list(range(0, 1000, 2))


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/items"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    tables.create_table(df, path)
    with pytest.raises(Exception):
        tables.create_table(df, path)
    tables.create_table(df.limit(0), path, fragile=False)
    more = spark.createDataFrame([(3, "b"), (5, "c"), (4, "c")], "id long, name string")
    tables.insert_new(more, path, "name")
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1, "a"), (2, "b"), (4, "c")]
    tables.copy_table(spark, path, "copied_items")
    assert spark.table("copied_items").count() == 3
    assert tables.read_table(spark, "copied_items").count() == 3
    spark.sql("DROP TABLE copied_items")


def documents(spark):
    def doc(key, *lines):
        return (key, f"title {key}", f"url/{key}", "train", [(t,) for t in lines], [("mix",), ("bake",)])

    return spark.createDataFrame(
        [
            doc("d3", "2 cups flour", "1 tsp salt", "Equipment: whisk"),
            doc("d1", "1 cup butter or 1 cup margarine", "2 cups Flour"),
            doc("d2", "1 tsp salt", "3 red apples", "1 cup flour"),
        ],
        DOCUMENT,
    )


def test_star_core_and_export(spark, tmp_path):
    parsed = parse_documents(documents(spark))
    built = build_star(parsed, "dataset:test")
    baskets = {r["lid"]: r for r in built.baskets.collect()}
    assert [baskets[k]["basket_id"] for k in ("d1", "d2", "d3")] == [1, 2, 3]
    items = {r["item_name"]: r["item_id"] for r in built.items.collect()}
    assert list(items) == sorted(items) or sorted(items.values()) == list(range(1, 6))
    assert set(items) == {"butter", "flour", "margarine", "red apples", "salt"}
    edges = built.edges.collect()
    assert len(edges) == 7  # substitutes are items but not edges
    assert len({e["edge_id"] for e in edges}) == 7
    assert {e["quantity_low"] for e in edges if e["item_id"] == items["salt"]} == {1.0}
    equipment, bridge = star.equipment_tables(parsed, built.baskets)
    assert [r["equipment_name"] for r in equipment.collect()] == ["whisk"]
    assert [r["basket_id"] for r in bridge.collect()] == [3]
    steps = star.instruction_steps(parsed, built.baskets)
    assert steps.where("basket_id = 1").orderBy("step").collect()[1]["text"] == "bake"
    assert star.unresolved_lines(parsed, built.baskets, built.items).isEmpty()

    core, path = core_export(spark, built, wanted=1, rounds=1, folder=str(tmp_path))
    assert path.endswith(f"baskets_b{core.baskets.count()}i{core.items.count()}e{core.edges.count()}.json")
    exported = spark.read.json(path).collect()
    assert {r["title"] for r in exported} <= {"title d1", "title d2", "title d3"}


def test_nested_export_keeps_empty_baskets(spark):
    baskets = spark.createDataFrame([(1, "a"), (2, "b")], "basket_id long, basket_name string")
    items = spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, item_name string")
    edges = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (2, 9)], "basket_id long, item_id long")
    rows = {r["title"]: r["ingredients"] for r in exports.nested_baskets(baskets, items, edges).collect()}
    assert rows == {"a": ["x", "y", "y"], "b": []}
    bare = exports.nested_baskets(baskets, items, edges, include_items=False)
    assert bare.columns == ["basket_id", "title"]


def test_curation_job_and_sample(spark, tmp_path):
    items = spark.createDataFrame([(1, "apples"), (2, "apple"), (3, "salt")], "item_id long, item_name string")
    edges = spark.createDataFrame(
        [(10, 1, 1), (11, 1, 3), (12, 2, 2), (13, 3, 3), (14, 3, 4)],
        "edge_id long, basket_id long, item_id long",
    )
    working = spark.createDataFrame(
        [("apples", 901, 1), ("apple", 902, 1), ("salt", 903, 1), ("pepper", 904, 1), ("junk", 905, -1)],
        "name string, id long, valid byte",
    )
    triples = spark.createDataFrame(
        [("apples", "alias:plural-of", "apple"), ("apple", "alias:singular-of", "apples"), ("junk", "alias:x", "salt")],
        "subject string, relation string, object string",
    )
    done = curate_job(working, triples, items, edges)
    assert {r["item_id"] for r in done.validated.collect()} == {1, 2, 3, 904}
    assert {r["basket_id"] for r in done.baskets.collect()} == {1, 2}
    assert dict(map(tuple, done.canonical.collect())) == {1: 2, 2: 2, 3: 3, 904: 904}
    assert sorted(map(tuple, done.edges.collect())) == [(10, 1, 2), (11, 1, 3), (12, 2, 2)]
    names = spark.createDataFrame([(1, "one"), (2, "two")], "basket_id long, basket_name string")
    titles, pairs, kept = sample(done.edges, names, done.items, 2, walkers=2, steps=20, first_basket=1)
    assert {r["basket_name"] for r in titles.collect()} == {"one", "two"}
    path = exports.write_sample(titles, pairs, kept, str(tmp_path))
    assert spark.read.json(f"{path}/items").count() == kept.count() == 2


def test_hyphens_and_trademarks(spark):
    names = spark.createDataFrame(
        [("half-and-half",), ("cheese cake",), ("cheese-cake",), ("cheesecake",), ("Brand® oil",), ("Brandy",), ("® x",)],
        "name string",
    )
    found = {tuple(r) for r in rel.hyphen_aliases(names).collect()}
    assert ("cheese-cake", "alias:hypenation", "cheese cake") in found
    assert ("cheesecake", "alias:spacing", "cheese cake") in found
    assert [r["name"] for r in rel.discovered(rel.hyphen_aliases(names), names).collect()] == ["half and half"]
    marked = {(r["subject"], r["object"]) for r in rel.trademark_relations(names).collect()}
    assert marked == {("Brand® oil", "Brand"), ("Brandy", "Brand")}
    none = spark.createDataFrame([("plain",)], "name string")
    assert rel.trademark_relations(none).isEmpty()


def test_child_of_closure_reaches_fresh_parents(spark):
    names = spark.createDataFrame([("new red hot sauce",), ("red and blue",), ("red",)], "name string")
    modifiers = spark.createDataFrame([("new",), ("red",), ("hot",), ("new red",)], "modifier string")
    relations, found = rel.all_child_of(names, modifiers)
    assert {r["name"] for r in found.collect()} == {"red hot sauce", "hot sauce", "sauce"}
    assert ("new red hot sauce", "child-of:starts-with:new red", "hot sauce") in {
        tuple(r) for r in relations.collect()
    }
    assert relations.where("subject = 'red and blue'").isEmpty()


def test_subtypes(spark):
    roots = spark.createDataFrame(
        [("sauce",), ("apple",), ("apples sauce",), ("salt and sauce",), ("hot sauces",)], "name string"
    )
    found = {tuple(r) for r in rel.subtypes_of_roots(roots).collect()}
    assert found == {
        ("apples sauce", "subtype-of:last-word", "sauce"),
        ("apples sauce", "subtype-or-composite-of:first-word", "apple"),
        ("hot sauces", "subtype-of:last-word", "sauce"),
    }


def test_duplicate_names_keep_the_lowest(spark):
    rows = spark.createDataFrame(
        [("a", 5, 0), ("a", 2, 1), ("a", 9, -1), ("b", 3, 0), ("b", 1, 0)], "name string, id long, valid byte"
    )
    assert sorted(map(tuple, curate.drop_duplicate_names(rows).collect())) == [("a", 9, -1), ("b", 1, 0)]
