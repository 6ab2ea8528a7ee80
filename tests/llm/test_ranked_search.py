"""Ranked search against scores of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from basketloom.llm import bit_sliced_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(documents, items, top=10):
    docs = [(i, Counter(terms_of(t))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for doc_id, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if c[t]
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def made_documents(n=150, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "ÉTÉ", "Été", "a_b", "x1", "THE", "the"]
    docs = [(k, " ".join(r.choices(words, weights=range(len(words), 0, -1), k=r.choice([1, 5, 30, 200])))) for k in range(n)]
    docs += [docs[3]] * 3 + [(docs[4][0], docs[9][1]), (None, docs[5][1]), (None, docs[5][1]), (1000, None), (1001, ""), (1002, ".,;")]
    docs += [(2000 + k, "copy of w50 w51 w52") for k in range(30)]
    docs.append((3000, "w1 " * 9000 + " ".join(f"long{k}" for k in range(2000))))
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 3, 20])))) for k in range(12)]
    items += [(12, "w50 W51 w52"), (13, None), (14, ""), (15, "unknown"), (3, "w7 w8"), (None, "w9"), (16, "the THE w1")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, rank int, item string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


@pytest.mark.parametrize("options", [{}, {"sent_documents": 0}, {"pass_terms": 9}, {"top": 3}])
def test_search_equals_brute_force(spark, options):
    docs, items = made_documents()
    got = search.ranked_search(*frames(spark, docs, items), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("top", 10))


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert search.ranked_search(*frames(spark, docs, items)).count() == 0


def test_bounds_are_never_below_the_scores(spark):
    docs, items = made_documents(seed=5)
    documents, wanted = frames(spark, docs, items)
    blocks = search.build_signatures(documents).collect()
    passes = list(search.item_passes(wanted, 10_000))
    terms = sorted(set().union(*[t for _, t in passes[0]]))
    df = search.document_counts(documents, terms)
    n = sum(len(b.doc_ids) for b in blocks)
    total = sum(sum(b.n_terms) for b in blocks)
    numbers = {t: k for k, t in enumerate(terms)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms], np.int64)
    s = search.Searched([(i, [numbers[t] for t in held]) for i, held in passes[0]], numbers, weights, n, total)
    repeated = {i for i, n in Counter(i for i, _ in docs).items() if n > 1}
    exact = {}
    for item, _, doc_id, score in brute(docs, items, 10**6):
        exact.setdefault((item, doc_id), []).append(score)
    tight = []
    for b in blocks:
        for first, bounds in search.upper_bounds(b.asDict(), s, search._term_keys(s)):
            for row, values in enumerate(bounds):
                for doc_id, bound in zip(b.doc_ids, values):
                    if doc_id in repeated:
                        continue
                    found = exact.get((s.items[first + row][0], doc_id), [0])
                    assert bound >= min(found), (first, row, doc_id, b.width, b.n_terms, s.items[first + row])
                    tight.append(bound <= 1.5 * max(found))
    assert np.mean(tight) > 0.9


def test_only_documents_that_may_win_are_scored(spark):
    r = random.Random(2)
    docs = [(k, " ".join(r.choices([f"v{j}" for j in range(400)], k=50))) for k in range(1500)]
    documents, wanted = frames(spark, docs, [(1, "v1 v2 v3 v4"), (2, "v9")])
    scored = []
    plain = search.possible_documents

    def counted(*args):
        found = plain(*args)
        scored.append(found.count())
        return found

    search.possible_documents = counted
    try:
        got = search.ranked_search(documents, wanted)
    finally:
        search.possible_documents = plain
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, [(1, "v1 v2 v3 v4"), (2, "v9")])
    assert scored[0] < 100
