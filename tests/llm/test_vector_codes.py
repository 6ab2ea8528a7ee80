"""Product codes against numpy, and the mask search against all distances."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from basketloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, vector string, error string, code int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "clash", "clash", 1) for i, v, l in rows], SCHEMA)


def brute(rows, parts, entries, rounds, scale=4096):
    usable = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    longest = max(len(v) for _, v, _ in usable)
    width = -(-longest // parts)
    ints = [([int(np.floor(scale * x)) for x in v] + [0] * (parts * width))[: parts * width] for _, v, _ in usable]
    order = sorted(range(len(usable)), key=lambda k: (usable[k][0] is None, usable[k][0] or 0, ints[k][: len(usable[k][1])]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[k], p) for k in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            row = []
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
                row.append((d.index(min(d)), min(d)))
            out.append(row)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for v, row in zip(ints, found) if row[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    errors = [sum(d for _, d in row) for row in found]
    by_label = {}
    for (_, _, label), e in zip(usable, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for k, _ in row), min(e, 2**63 - 1), min(by_label[label], 2**63 - 1), digest)
         for (i, _, label), row, e in zip(usable, found, errors)),
        key=str,
    )


def made_rows(n=60, width=16, seed=3, size=1.0):
    r = random.Random(seed)
    rows = [(i, [r.choice([-size, 0.0, size]) + r.gauss(0, 0.2) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]
    rows += [rows[5], rows[6], (rows[7][0], rows[8][1], 2), (None, rows[9][1], None)]
    rows += [(900, None, 1), (901, [float("nan")] * width, 1), (902, [float("inf")] * width, 1), (903, [None] * width, 1)]
    return rows


@pytest.mark.parametrize("parts,entries,rounds,width,size", [(8, 16, 6, 16, 1.0), (4, 3, 2, 10, 1.0), (2, 70, 1, 4, 1.0), (2, 5, 2, 4, 1e9)])
def test_codes_equal_brute_force(spark, parts, entries, rounds, width, size):
    rows = made_rows(width=width, size=size)
    got = vector_codes.product_codes(table(spark, rows), parts, entries, rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, parts, entries, rounds)


def test_short_and_empty_vectors_are_filled_up(spark):
    rows = [(1, [0.5] * 9, 1), (2, [], 1), (3, [0.25], None), (4, [0.5] * 16, None)]
    got = vector_codes.product_codes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 8, 16, 6)


def test_no_usable_vector_gives_no_rows(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        got = vector_codes.product_codes(table(spark, rows))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert got.count() == 0


@pytest.mark.parametrize("entries", [1, 16, 64, 65, 200])
@pytest.mark.parametrize("radius", [1, 7, 10_000])
def test_mask_search_finds_the_first_nearest(entries, radius):
    r = np.random.default_rng(entries)
    # few different values, so that many distances are equal
    index = vector_codes.MaskIndex(r.integers(-4, 5, (entries, 5)))
    parts = r.integers(-6, 7, (300, 5))
    code, error = index.nearest(parts, radius)
    apart = ((parts[:, None] - index.entries[None]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all()


def test_box_holds_exactly_the_entries_within_the_radius():
    r = np.random.default_rng(0)
    index = vector_codes.MaskIndex(r.integers(0, 50, (100, 3)))
    parts, reach = r.integers(0, 50, (80, 3)), r.integers(0, 30, 80)
    rows, found = index._members(index.box(parts, reach))
    inside = (np.abs(parts[:, None] - index.entries[None]) <= reach[:, None, None]).all(2)
    assert set(zip(rows.tolist(), found.tolist())) == set(map(tuple, np.argwhere(inside).tolist()))


def test_errors_of_many_labels_are_joined_by_shuffling(spark):
    rows = spark.createDataFrame(
        [(i, i % 7 or None, "00", i) for i in range(200)], "vec_id long, label long, code string, error long"
    )
    both = [
        sorted(map(tuple, vector_codes.label_errors(rows, n).select("vec_id", "label_error").collect()))
        for n in (0, 100)
    ]
    assert both[0] == both[1] and len(both[0]) == 200
