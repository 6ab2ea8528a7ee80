"""Splittable reading of outer lists against the json module."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from basketloom.sources import documents


def value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind == 0:
        return "".join(rng.choices('ab{}[]",:\\\n\té"', k=rng.randint(0, 12)))
    if kind == 1:
        return rng.choice([1, -2.5, None, True])
    if kind == 2:
        return rng.choice(["", "}", "{", '"', "\\", '\\"}', "]"])
    if kind == 3:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {f"k{j}{rng.choice(['', '}', chr(34)])}": value(rng, depth - 1) for j in range(rng.randint(0, 3))}


def made(rng, n):
    return [{"id": k, "v": value(rng, 4)} for k in range(n)]


@pytest.fixture(params=[None, 64, 1000])
def split_size(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    if request.param:
        for n in names:
            spark.conf.set(n, str(request.param))
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_lists_are_read_whole_in_splits(spark, tmp_path, split_size, indent):
    rng = random.Random(7)
    wanted = []
    for name, n in (("a", 60), ("b", 1), ("c", 0), ("d", 25)):
        rows = made(rng, n)
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=rng.random() < 0.5))
        wanted += [(name, r) for r in rows]
    texts = documents.document_texts(spark, f"{tmp_path}/*.json")
    if split_size == 64:
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/a.json").rdd.getNumPartitions() > 20
    got = [(r.file.rsplit("/", 1)[1][0], json.loads(r.text)) for r in texts.collect()]
    key = lambda pair: (pair[0], pair[1]["id"])
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_one_document_over_many_splits(spark, tmp_path, split_size):
    rows = [{"id": 1}, {"id": 2, "v": ["x}" * 3000, {"y": "[" * 500}]}, {"id": 3}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = [json.loads(r.text) for r in documents.document_texts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


def test_objects_side_by_side_and_empty_files(spark, tmp_path, split_size):
    rows = made(random.Random(3), 20)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "none.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n")
    got = [json.loads(r.text) for r in documents.document_texts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


def test_written_lists_are_read_back(spark, tmp_path):
    rows = [(str(k), f'title "{k}" }}', [(f"line {j}",) for j in range(k % 4)]) for k in range(50)]
    frame = spark.createDataFrame(rows, "id string, title string, ingredients array<struct<text:string>>").repartition(3)
    documents.write_document_lists(frame, f"{tmp_path}/out")
    for part in (tmp_path / "out").glob("part-*"):
        assert part.stat().st_size == 0 or isinstance(json.loads(part.read_text()), list)
    read = documents.read_documents(spark, f"{tmp_path}/out").select(
        "id", "title", F.transform("ingredients", lambda i: i["text"]).alias("lines")
    )
    assert sorted(map(tuple, read.collect())) == sorted((i, t, [x for (x,) in n]) for i, t, n in rows)
