from __future__ import annotations

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import porter
from basketloom.functions import stems
from basketloom.functions.fixed_values import JUICED, STANDARD_UNITS
from basketloom.functions.lines import is_note, parse_line, take_parentheses
from basketloom.functions.quantities import written_forms
from basketloom.functions.stems import stem as stem_of
from basketloom.functions.text import plural, singular
from basketloom.catalog import line_parsing, load, star_tables
from basketloom.operators.lines import (
    equipment_rows,
    parse_documents,
    parse_lines,
    read_distinct,
    rejected_documents,
    route_documents,
)
from basketloom.plans.documents import parse_document_files
from basketloom.schemas import DOCUMENT

def fields(row):
    """Set fields, with ``high`` only where it is not ``low``."""
    found = {k: v for k, v in row.asDict(recursive=True).items() if v is not None and k != "text"}
    low, high = found.pop("quantity_low", None), found.pop("quantity_high", None)
    if low is not None:
        found["low"] = low
    if high != low:
        found["high"] = high
    return found


def parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r for r in parse_lines(df).collect()}


# how a quantity may be written: low, high (none where it has no value)
NUMBERS = {
    "3": (3.0, 3.0),
    "2.5": (2.5, 2.5),
    "2 1/2": (2.5, 2.5),
    "3-4": (3.0, 4.0),
    "3 to 4": (3.0, 4.0),
    "1/0": None,
    "seven": (7.0, 7.0),
}
# written without its slash before a singular unit
LOST_SLASH = {"12": 0.5, "14": 0.25, "13": 0.33, "34": 0.75}
NAMES = ("zorp", "blue quib", "zorp of vim")
# neither a word of the quantity nor one that needs more than a letter to end
ODD_SPELLINGS = {'"', "half", "halves", "whole", "in", "inch"}


def unit_spellings():
    for unit, patterns in STANDARD_UNITS:
        for pattern in patterns:
            for form in written_forms(pattern):
                if form not in ODD_SPELLINGS:
                    yield unit, form


def test_numbers_units_and_names(spark):
    texts = {
        f"{number} {unit} {name}": (bounds, name)
        for number, bounds in NUMBERS.items()
        for unit in ("cups", "kg", "tablespoons")
        for name in NAMES
    }
    parsed = parse(spark, texts)
    for text, (bounds, name) in texts.items():
        row = parsed[text]
        assert row["name"] == name, text
        assert (row["quantity_low"], row["quantity_high"]) == (bounds or (None, None)), text


def test_every_spelling_of_a_unit(spark):
    forms = {f"3 {form} zorp": unit for unit, form in unit_spellings()}
    parsed = parse(spark, forms)
    for text, unit in forms.items():
        assert (parsed[text]["name"], parsed[text]["unit"]) == ("zorp", unit), text


def test_a_lost_slash(spark):
    texts = [f"{number} {unit} zorp" for number in LOST_SLASH for unit in ("cup", "teaspoon")]
    parsed = parse(spark, [*texts, "12 cups zorp", "18 cup zorp"])
    for text in texts:
        assert parsed[text]["quantity_low"] == LOST_SLASH[text[:2]], text
    # a plural means the number as it is, and eighteen is no fraction that is ever meant
    assert parsed["12 cups zorp"]["quantity_low"] == 12.0
    assert parsed["18 cup zorp"]["quantity_low"] == 18.0


def test_delimiters_part_name_and_modifier(spark):
    texts = {f"3 cups zorp{d} vimmed": d for d in (",", ":", ";", "-")}
    parsed = parse(spark, texts)
    for text in texts:
        assert (parsed[text]["name"], parsed[text]["modifier"]) == ("zorp", "vimmed"), text


def test_sized_containers(spark):
    forms = {
        f"2 ({size} {unit}) {container} zorp": f"{size} {canonical} {many}"
        for size in (7, 28)
        for unit, canonical in (("ounce", "oz"), ("g", "g"))
        for container, many in (("can", "cans"), ("jars", "jars"), ("packet", "packets"))
    }
    parsed = parse(spark, forms)
    for text, unit in forms.items():
        row = parsed[text]
        assert (row["name"], row["unit"], row["quantity_low"]) == ("zorp", unit, 2.0), text


def test_parentheses_are_taken_out(spark):
    texts = {f"3 cups {'(vim) ' * k}zorp": k for k in range(4)}
    parsed = parse(spark, texts)
    for text, k in texts.items():
        assert parsed[text]["name"] == "zorp"
        assert parsed[text]["parenthetic"] == (["vim"] * k or None)


def test_lines_without_a_measure(spark):
    parsed = parse(spark, ["blue zorp", "zorp, vimmed", "possibly 2 cups zorp"])
    assert fields(parsed["blue zorp"]) == {"name": "blue zorp"}
    assert fields(parsed["zorp, vimmed"]) == {"name": "zorp", "modifier": " vimmed"}
    assert parsed["possibly 2 cups zorp"]["quantity_low"] == 2.0


def test_juice(spark):
    forms = [form for p in JUICED if "(" not in p for form in written_forms(p)]
    # the first spelling that fits is taken, so none that another one begins
    fruits = [f for f in forms if not any(f != o and f.startswith(o) and f != o + "s" for o in forms)]
    texts = [f"juice of {n} {one}" for n in ("2", "three") for one in fruits]
    parsed = parse(spark, texts)
    for text in texts:
        row = parsed[text]
        assert row["matched"] == text and row["name"].endswith(", juice of"), text
        assert row["quantity_str"].strip() == text.split()[2]


def test_first_unit_wins(spark):
    # every unit is taken out of the quantity, and the first one is kept
    row = parse(spark, ["a half cup zorp"])["a half cup zorp"]
    assert (row["name"], row["unit"], row["quantity_str"]) == ("zorp", "half", "a")
    assert row["quantity_low"] == 1.0


SHAPES = {"2 cups {}": ("cups", True), "3 {}": (None, True), "{}": (None, False)}


def test_alternatives_split_only_if_their_shapes_agree(spark):
    lines = {
        f"{a.format('zorp')} or {b.format('quib')} or {c.format('vim')}": (a, b, c)
        for a in SHAPES for b in SHAPES for c in SHAPES
    }
    parsed = parse(spark, lines)
    for text, (a, b, c) in lines.items():
        others = parsed[text]["substitutions"]
        if SHAPES[a] == SHAPES[b] == SHAPES[c]:
            assert parsed[text]["name"] == "zorp"
            assert [(s["name"], s["unit"]) for s in others] == [
                ("quib", SHAPES[b][0]), ("vim", SHAPES[c][0]),
            ]
        else:
            assert others is None, text


def test_an_or_in_parentheses_separates_nothing(spark):
    row = parse(spark, ["2 cups zorp (or 2 cups quib)"])["2 cups zorp (or 2 cups quib)"]
    assert row["name"] == "zorp" and row["substitutions"] is None


def test_cut_after_describing_words_can_be_passed_over(spark):
    df = spark.createDataFrame([("2 cups boneless, skinless chicken, diced",)], "text string")
    assert parse_lines(df).first()["name"] == "boneless"
    held = parse_lines(df, keep_after=["boneless"]).first()
    assert (held["name"], held["modifier"]) == ("boneless, skinless chicken", "diced")


def test_nested_parentheses_come_out_in_closing_order(spark):
    text = "2 cups soup (a (b) c) (e) (d"
    row = parse(spark, [text])[text]
    assert row["parenthetic"] == ["b", "a  c", "e"]
    assert row["name"] == "soup   (d"


def test_lines_of_any_length_parse(spark):
    texts = ["cup " * 9000 + "sugar", "-" * 40000 + " z", "a" * 20000 + " b", "juice " * 5000 + "of lemon",
             "x, " * 20000, "(" * 3000 + " 1 cup", "1 cup " + ")" * 300, "oz." * 90 + "X y",
             "half" * 90 + "X y", "1 " + "l." * 90 + "X y"]
    parsed = parse(spark, texts)
    assert parsed[texts[0]]["name"] == "sugar"
    assert parsed[texts[1]]["quantity_str"] == "-" * 39999  # the first one is a bullet
    assert len(parsed) == len(texts)


@pytest.mark.parametrize("n", [90, 400, 401, 5000])
def test_words_of_any_number_of_parts(spark, n):
    texts = {
        f"1 {'half' * n} zorp": ("zorp", "half"),
        f"{'half' * n}y zorp": (f"{'half' * n}y zorp", None),
        f"2 {'lb' * n} zorp, vim": ("zorp", "lb"),
        f"{'half' * n} of zorp": ("zorp", "half"),
        f"2 cups {'q' * n} zorp": (f"{'q' * n} zorp", "cups"),
    }
    parsed = parse(spark, texts)
    for text, (name, unit) in texts.items():
        assert (parsed[text]["name"], parsed[text]["unit"]) == (name, unit), text[:20]


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    rows = {r["id"]: r for r in df.select("id", parse_line(F.col("text")).alias("p")).collect()}
    assert rows[2]["p"]["name"] == ""
    assert rows[1]["p"] is None or rows[1]["p"]["name"] is None


def test_notes_and_equipment(spark):
    rows = [("Special equipment: parchment; a round cutter",), ("Equipment Tongs",), ("2 pans",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r["equipment"] for r in equipment_rows(df).collect()] == [
        "parchment", "a round cutter", "tongs",
    ]
    notes = spark.createDataFrame([("note: chill",), ("no note",)], "text string")
    assert notes.where(is_note(F.col("text"))).count() == 1


def documents(spark):
    def doc(key, *lines):
        return (key, f"t{key}", f"u{key}", "train", [(t,) for t in lines], [("mix",), ("bake",)])

    return spark.createDataFrame(
        [
            doc("1", "2 cups flour", "Special Equipment: Tongs; Rack", "1 egg or 1 duck egg"),
            doc("2", "salt"),
            doc("3", "possibly equipment: spoon", "2 cups rice"),
            doc("4", "1 tsp salt", None),
            ("5", "t5", "u5", "val", None, None),
        ],
        DOCUMENT,
    )


def test_documents_are_routed_and_rejected(spark):
    parsed = {r["id"]: r for r in parse_documents(documents(spark)).collect()}
    first = parsed["1"]
    assert [line["text"] for line in first["ingredients"]] == ["2 cups flour", "1 egg or 1 duck egg"]
    assert [e["text"] for e in first["equipment"]] == ["tongs", "rack"]
    assert first["ingredients"][1]["substitutions"][0]["name"] == "duck egg"
    assert parsed["2"]["equipment"] is None
    # a document that cannot be routed keeps its lines as they were
    assert [line["text"] for line in parsed["3"]["ingredients"]] == [
        "possibly equipment: spoon", "2 cups rice",
    ]
    assert all(line["name"] is None for line in parsed["3"]["ingredients"])
    rejected = rejected_documents(parse_documents(documents(spark)))
    assert sorted(r["id"] for r in rejected.collect()) == ["3", "4", "5"]


def test_routing_alone_agrees_with_parsing(spark):
    def shown(frame):
        texts = F.transform("ingredients", lambda line: line["text"]).alias("texts")
        return sorted(map(str, frame.select("id", texts, "equipment", "parse_ok").collect()))

    assert shown(route_documents(documents(spark))) == shown(parse_documents(documents(spark)))


@pytest.mark.parametrize(
    "name", ["t17_routed_documents", "t18_rejected_documents", "r5_equipment_dimension", "r5_required_equipment"]
)
def test_queries_without_line_fields_do_not_parse_lines(spark, monkeypatch, name):
    def parsed(*_):
        raise AssertionError("lines were parsed")

    for module in (line_parsing, star_tables):
        monkeypatch.setattr(module, "parse_documents", parsed)
    assert load()[0][name](spark, "/root/testdata/sf0.001").count() > 0


def test_lines_one_by_one_agree_with_nested_ones(spark):
    nested = parse_documents(documents(spark)).select("id", "parse_ok", F.posexplode("ingredients").alias("pos", "line"))
    single = parse_documents(documents(spark), by_line=["id"])
    assert single.columns == nested.columns

    def shown(frame):
        # rejected lines have no substitutions, be they empty or absent
        line = F.col("line").withField("substitutions", F.coalesce("line.substitutions", F.array()))
        return sorted(map(str, frame.select("id", "parse_ok", "pos", F.to_json(line)).collect()))

    assert shown(single) == shown(nested)


def test_each_distinct_text_is_read_once(spark):
    rows = [(i, t) for i, t in enumerate(["1 cup rice", "2 eggs", None, "", "1 cup rice", None, "2 eggs"] * 30)]
    df = spark.createDataFrame(rows, "n int, text string")
    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return text and text.upper()

    counted = F.udf(count)
    found = read_distinct(df, "text", lambda t: F.struct(counted(t).alias("loud"))).collect()
    assert sorted((r["n"], r["_line"]["loud"]) for r in found) == [(n, t and t.upper()) for n, t in rows]
    assert read.value == 4
    plain = df.select("n", parse_line(F.col("text")).alias("p")).select("n", "p.*")
    assert sorted(map(str, parse_lines(df).collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", ["t7_t9_quantities", "t13_alternatives"])
def test_queries_read_distinct_texts(spark, name):
    frame = load()[0][name](spark, "/root/testdata/sf0.001")
    assert "Aggregate" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_document_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in (1, 2):
        rows = [
            {"id": f"{part}{i}", "title": "t", "url": "u", "partition": "train",
             "ingredients": [{"text": "2 cups flour"}], "instructions": [{"text": "mix"}]}
            for i in range(3)
        ]
        (tmp_path / "in" / f"layer_{part:02d}.json").write_text(json.dumps(rows, indent=1))
    rejected = parse_document_files(spark, f"{tmp_path}/in/*.json", f"{tmp_path}/out", 4)
    assert rejected.count() == 0
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == 6
    assert back.selectExpr("ingredients[0].name AS n").distinct().collect()[0]["n"] == "flour"


def test_written_forms():
    assert sorted(written_forms(r"lbs?\.?")) == ["lb", "lb.", "lbs", "lbs."]
    assert sorted(written_forms("batch(?:es)?")) == ["batch", "batches"]


def test_number_of_nouns(spark):
    pairs = [
        ("red apple", "red apples"), ("berry", "berries"), ("box", "boxes"), ("dish", "dishes"),
        ("bay leaf", "bay leaves"), ("mango", "mangoes"), ("day", "days"), ("cookie", "cookies"),
    ]
    df = spark.createDataFrame(pairs, "one string, many string")
    for row in df.select("*", singular(F.col("many")).alias("s"), plural(F.col("one")).alias("p")).collect():
        assert (row["s"], row["p"]) == (row["one"], row["many"])
    kept = spark.createDataFrame([("glass",), ("couscous",), ("asparagus",)], "w string")
    assert all(r["s"] == r["w"] for r in kept.select("w", singular(F.col("w")).alias("s")).collect())


def peeled(text):
    """One pair of parentheses after the other, the first that holds no other."""
    inside = []
    while found := re.search(r"\(([^()]*)\)", text):
        inside.append(found[1])
        text = text[: found.start()] + text[found.end() :]
    return text, inside


def test_parentheses_equal_peeling(spark):
    rng = random.Random(4)
    texts = {"".join(rng.choices("((()))ab \n", k=rng.randint(0, 14))) for _ in range(1500)}
    deep = ["(" * 3000 + "x" + ")" * 3000, "(a)" * 5000, ")" * 5000 + "(" * 5000]
    frame = spark.createDataFrame([(t,) for t in [*sorted(texts), *deep]], "text string")
    for text, got in frame.select("text", take_parentheses(F.col("text")).alias("t")).collect():
        if len(text) < 100:
            assert (got["text"], got["inside"]) == peeled(text), text
    assert [len(r["inside"]) for r in frame.where(F.length("text") > 100).select(F.explode(F.array(take_parentheses(F.col("text")))).alias("t")).select("t.*").collect()] == [3000, 5000, 0]


def test_stems(spark):
    pairs = [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"),
        ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"),
        ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"),
        ("roll", "roll"), ("is", "is"),
    ]
    rows = spark.createDataFrame(pairs, "word string, stem string")
    assert [r for r in rows.select("word", "stem", stem_of(F.col("word")).alias("got")).collect() if r[1] != r[2]] == []


def test_stems_equal_the_published_steps(spark):
    rng = random.Random(3)
    endings = [s for s, _ in (*stems._STEP2, *stems._STEP3, *stems._STEP4)]
    endings += "s es ies sses ed ing eed y e ll ly ss yy".split() + [""] * 5
    words = {"", "y", "yy", "a b", "Yellow", "sky-flies", "it's"}
    for _ in range(4000):
        word = "".join(rng.choice(rng.choice(("aeiouy", "bcdfghjklmnpqrstvwxz"))) for _ in range(rng.randint(0, 6)))
        words.add(word + rng.choice(endings) + rng.choice(["", "", "s", "ed", "ing"]))
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "name string")
    got = dict(frame.select("name", stem_of(F.col("name"))).collect())
    assert {w: s for w, s in got.items() if s != porter.porter_stem(w)} == {}
    con = duckdb.connect()
    con.register("words", frame.toPandas())
    assert dict(con.execute(f"WITH {stems.stem_sql('words')} SELECT * FROM stems").fetchall()) == got
