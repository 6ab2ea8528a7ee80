"""Trained operators, packing and the pipeline: exact parts against brute force, the rest held out."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from basketloom.llm import packing, pseudo_likelihood, weak_labels

SYLLABLES = "ka lo mi re tu shi no va".split()


def prose(rng, n):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + "." * (k % 12 == 11) for k, w in enumerate(words))


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_are_those_of_the_tokenizer(tokenizer_path):
    ids = packing.WordIds(tokenizer_path)
    texts = [
        "", "It's we'LL o'd 12½, don’t", "<|endoftext|> hi", "İstanbul ΣΑΣ Σ", "a\x1cb\x85c", "é é Å",
        "日本 ﬁ x", "THE!! | a%%% b###", "\n\t ", "x" * 3000,
    ]
    for text in texts:
        expected = [*ids.whole.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert np.frombuffer(ids.of(text), "<u4").tolist() == expected, text


def test_packing_is_whole_and_tight(documents, tokenizer_path, edge_rows):
    rng = random.Random(1)
    rows = [*edge_rows, *((k, prose(rng, rng.randint(0, 900))) for k in range(100, 240))]
    pieces = packing.pack(documents(rows), tokenizer_path, keep_ids=True).collect()
    ids = packing.WordIds(tokenizer_path)
    wanted = sorted((str(i), ids.of(t or "")) for i, t in rows)
    by_doc: dict = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        raw = np.asarray(p["ids"], "<u4").tobytes()
        assert (p["length"], p["ids_crc32"]) == (len(raw) // 4, zlib.crc32(raw))
        by_doc.setdefault(p["doc_id"], []).append(p)
    got = []
    for doc_id, mine in by_doc.items():
        # rows of one id are told apart by where they start anew
        if sum(p["start"] == 0 for p in mine) == 1:
            got.append((str(doc_id), b"".join(np.asarray(p["ids"], "<u4").tobytes() for p in mine)))
        else:
            got += [(str(doc_id), np.asarray(p["ids"], "<u4").tobytes()) for p in mine if p["length"] == p["doc_tokens"]]
    assert set(got) <= set(wanted) and len({d for d, _ in got}) == len(by_doc)
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(sequences) == list(range(len(sequences)))
    used = sum(p["length"] for p in pieces)
    assert used == sum(len(raw) // 4 for _, raw in wanted)
    assert used / (len(sequences) * packing.CAPACITY) > 0.9


def test_packing_of_no_documents(documents, tokenizer_path):
    assert packing.pack(documents([]), tokenizer_path).count() == 0


def test_best_fill_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 12, 4))
        worth = rng.random(len(sizes))
        counts, value = packing.best_fill(30, sizes, worth)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + w for s, w in zip(sizes, worth) if s <= c)])
        assert counts @ sizes <= 30 and abs(value - best[30]) < 1e-9
        assert abs(counts @ worth - value) < 1e-9


def test_column_generation_meets_its_bound():
    rng = np.random.default_rng(3)
    sizes = np.unique(rng.integers(3, 100, 25))
    wanted = rng.integers(1, 400, len(sizes))
    patterns, use = packing.column_generation(sizes, wanted, 100)
    assert (patterns @ sizes <= 100).all()
    assert (use @ patterns >= wanted - 1e-6).all()
    plan = packing.cutting_plan(sizes, wanted, 100)
    assert (sum(times * counts for times, counts in plan) == wanted).all()


# pseudo-likelihood


def test_probabilities_add_up_and_scores_are_their_sums(documents, edge_rows):
    rng = np.random.default_rng(4)
    flat = rng.normal(0, 0.3, pseudo_likelihood.N_PARAMETERS).astype(np.float32)
    parts = pseudo_likelihood.unpacked(flat)
    ids, around, of = pseudo_likelihood.windows(pa.array(["one two three four five six", "", "seven"]))
    assert len(ids) == 7 and around[6].tolist() == [pseudo_likelihood.WORDS] * 4
    every = np.arange(pseudo_likelihood.WORDS)
    total = np.exp(pseudo_likelihood.log_probabilities(parts, every, np.tile(around[2], (len(every), 1))))
    assert abs(total.sum() - 1) < 1e-3
    # one word at a time, straight from the definition
    given = pseudo_likelihood.log_probabilities(parts, ids, around)
    for k in range(7):
        hidden = np.append(np.tanh(parts["embedding"][around[k]].ravel() @ parts["mixing"]), 1)
        c, w = divmod(int(ids[k]), pseudo_likelihood.IN_CLASS)
        a, b = hidden @ parts["class_out"], hidden @ parts["word_out"][c]
        expected = a[c] - np.log(np.exp(a).sum()) + b[w] - np.log(np.exp(b).sum())
        assert abs(given[k] - expected) < 1e-3
    rows = pseudo_likelihood.score(documents(edge_rows), flat).collect()
    assert len(rows) == len(edge_rows)
    assert all((r["n_words"] == 0) == (r["per_word"] is None) for r in rows)


def test_training_predicts_held_out_text_better(documents):
    rng = random.Random(5)
    phrases = [prose(rng, 8) for _ in range(12)]
    text = lambda: " ".join(rng.choices(phrases, k=40))
    trained = pseudo_likelihood.train(documents([(k, text()) for k in range(120)]), size=64)
    held_out = documents([(0, text()), (1, "zq xw vb " * 30)])
    before = pseudo_likelihood.score(held_out, pseudo_likelihood.fresh_parameters()).collect()
    after = {r["doc_id"]: r["per_word"] for r in pseudo_likelihood.score(held_out, trained).collect()}
    assert after[0] > before[0]["per_word"] + 1 and after[0] > after[1] + 1
    assert pseudo_likelihood.pseudo_likelihood(documents([])).count() == 0


def test_vocabulary_grows_and_shared_ids_are_spread_by_counts(documents, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "OWN_COUNT", 5)
    sizes = []
    for n in (300, 9000):
        # n frequent words, and rare ones seen 1 to 4 times
        rare = [f"r{k}" for k in range(n) for _ in range(1 + k % 4)]
        text = " ".join([f"w{k}" for k in range(n) for _ in range(6)] + rare)
        words = pseudo_likelihood.count_words(documents([(1, text), (2, None)]))
        sizes.append((words.words, words.n_parameters))
        everything = [*(f"w{k}" for k in range(n)), *dict.fromkeys(rare)]
        ids, _, _, share = pseudo_likelihood._windows(pa.array([" ".join(everything)]), words)
        assert len(set(ids[:n])) == n and not share[:n].any() and ids.max() < words.words
        # what is left of a shared id is one more occurrence, for words never seen
        sums = np.bincount(ids[n:], np.exp(share[n:]), minlength=words.words)
        mass = np.bincount(ids[n:], [1 + k % 4 for k in range(n)], minlength=words.words)
        assert np.allclose(sums, mass / (mass + 1))
        assert not set(ids[:n]) & set(ids[n:])
        unseen, _, _, share = pseudo_likelihood._windows(pa.array(["never"]), words)
        assert share[0] == -np.log(mass[unseen[0]] + 1)
        parts = pseudo_likelihood.unpacked(pseudo_likelihood.fresh_parameters(vocabulary=words), words)
        every = np.arange(words.words)
        total = np.exp(pseudo_likelihood.log_probabilities(parts, every, np.zeros((len(every), 4), int)))
        assert abs(total.sum() - 1) < 1e-3
    assert sizes[1][0] > 9000 and sizes[1][1] > 20 * sizes[0][1]


def test_model_does_not_depend_on_the_layout(documents, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "OWN_COUNT", 5)
    monkeypatch.setattr(pseudo_likelihood.Sizes, "learners", 3)
    rng = random.Random(8)
    rows = [(k, prose(rng, 60)) for k in range(60)] + [(None, None), (1, "")]
    table = documents(rows)
    # one batch per learner, so that every document is in the mini-batches it always is in
    models = [pseudo_likelihood.train(table.repartition(n, "text"), size=64) for n in (1, 7)]
    assert models[0].vocabulary.words == models[1].vocabulary.words
    assert np.allclose(models[0].flat, models[1].flat, atol=1e-5)
    assert not np.allclose(models[0].flat, pseudo_likelihood.fresh_parameters(vocabulary=models[0].vocabulary))


def test_ids_and_learners_grow_with_the_root_of_the_corpus():
    for words in (10**7, 10**9, 10**12, 10**14):
        one, four = pseudo_likelihood.Sizes(words), pseudo_likelihood.Sizes(4 * words)
        # the most ids and known words there can be;
        # rounding down adds less than a tenth
        assert words / one.own <= 1.1 * 18 * words**0.5 and words / one.known <= 1.1 * 200 * words**0.5
        assert four.learners in (2 * one.learners, 2 * one.learners + 1)
        assert 4 * words / four.own >= words / one.own


def test_large_weights_do_not_overflow():
    rng = np.random.default_rng(9)
    flat = rng.normal(0, 40, pseudo_likelihood.N_PARAMETERS).astype(np.float32)
    parts = pseudo_likelihood.unpacked(flat)
    assert not pseudo_likelihood._bounded(parts)
    every, around = np.arange(pseudo_likelihood.WORDS), np.full((pseudo_likelihood.WORDS, 4), 7)
    given = pseudo_likelihood.log_probabilities(parts, every, around)
    # far beyond what a probability can hold
    assert np.isfinite(given).all() and given.min() < -200 and abs(np.exp(given).sum() - 1) < 1e-3


# weak labels


def junk(rng, kind):
    words = prose(rng, 120).split()
    if kind == 0:
        return " ".join(w + "%%%" for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join([words[0]] * 80 + words[:20])


def test_classifier_on_held_out_documents(spark, documents):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        bad, toxic = k % 4 == 0, k % 5 == 1
        text = junk(rng, k // 4 % 3) if bad else prose(rng, rng.randint(60, 200))
        if toxic:
            text += f" you {rng.choice(weak_labels.INSULTS[0])} and {rng.choice(weak_labels.INSULTS[1])}"
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    given = spark.createDataFrame([x for x in labels if x[0] // 4 % 2], "doc_id long, quality int, toxic int")
    for people in (None, given):
        scored = weak_labels.quality_classifier(documents(rows), people).collect()
        held_out = [r for r in scored if r["doc_id"] // 4 % 2 == 0]
        toxic = sum((r["toxic_score"] >= 0.5) == bool(labels[r["doc_id"]][2]) for r in held_out)
        assert toxic >= 180
        # heuristics alone do not tell a kind of junk that a single one of them sees
        good = sum((r["quality_score"] >= 0.5) == bool(labels[r["doc_id"]][1]) for r in held_out)
        assert good >= (180 if people is not None else 160)


def test_classifier_edges(documents, edge_rows):
    scored = weak_labels.quality_classifier(documents(edge_rows)).collect()
    assert len(scored) == len(edge_rows)
    assert not any(r["kept"] for r in scored if r["n_words"] == 0)
    assert weak_labels.quality_classifier(documents([])).count() == 0


def test_labels_that_name_nothing_or_little(spark, documents):
    rng = random.Random(13)
    rows = [(k, junk(rng, k // 4 % 3) if k % 4 == 0 else prose(rng, 120)) for k in range(200)]
    without = {r["doc_id"]: r for r in weak_labels.quality_classifier(documents(rows)).collect()}
    assert sum(r["kept"] for r in without.values()) > 100
    for labels in ([], [(-5, 1, 0)], [(None, 1, 0)], [(1, 1, 0)]):
        given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        scored = {r["doc_id"]: r for r in weak_labels.quality_classifier(documents(rows), given).collect()}
        assert sum(scored[k]["kept"] != without[k]["kept"] for k in scored) <= 20
        if labels != [(1, 1, 0)]:
            assert scored == without


def test_variety_does_not_fall_with_length():
    words = prose(random.Random(14), 10).replace(".", "").split()
    many = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words * 2000), " ".join(words * 20), " ".join(many), " ".join(many * 20), ""]  # the last but one has 40,000 words, 40 % of each part are different
    variety = weak_labels.describe(pa.array(texts), hashed=False).quality[:, weak_labels.QUALITY.index("variety")]
    assert variety.tolist() == [-1, -1, 1, 1, 0]


def test_expectation_maximisation_finds_the_reliable_voter():
    rng = np.random.default_rng(7)
    good = rng.random(20_000) < 0.8
    sharp = np.where(good, 1, np.where(rng.random(len(good)) < 0.9, -1, 1))
    second = np.where(good, 1, np.where(rng.random(len(good)) < 0.8, -1, 1))
    noise = np.where(rng.random(len(good)) < 0.1, -1, 1)
    votes = np.stack([sharp, second, noise], axis=1)
    codes, counts = np.unique(weak_labels.pattern_codes(votes), return_counts=True)
    fitted = weak_labels.expectation_maximisation(codes, counts, 3)
    weights = fitted[:-1].reshape(3, 3)
    assert weights[0, 0] < -3 and weights[1, 0] < -3 and weights[2, 0] > -1
    assert ((weak_labels.posterior(votes, fitted) >= 0.5) == good).mean() > 0.95


# pipeline


def test_pipeline_stages(spark, documents, tokenizer_path, tmp_path):
    rng = random.Random(8)
    clean = [prose(rng, 150) for _ in range(12)]
    bench = prose(rng, 40)
    rows = list(enumerate(clean))
    rows += [(20, clean[0]), (21, clean[1] + " tail"), (22, junk(rng, 2)), (23, None), (24, "short")]
    rows += [(25, bench + " " + prose(rng, 60)), (26, prose(rng, 80) + " mail me a@b.example.org")]
    sf = str(tmp_path)
    table = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        assert docs.columns == table.columns
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    everything = set(range(12))
    assert set(left[0]) == everything | {20, 21, 25, 26}
    assert set(left[1]) == everything | {25, 26}
    assert set(left[2]) == set(left[3]) == everything | {26}
    assert left[3][26].endswith("mail me <EMAIL>")
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(left[3])


def near_rows(rng):
    """A text, one whose 5-word similarity to it is between 80 and 85 %, a shorter one and another."""
    words = [f"w{k}" for k in range(404)]
    rng.shuffle(words)

    def without(n):
        return " ".join(words[: len(words) - n])

    # 400 shingles; without 70 words 330 are left, without 170 words 230
    return [(1, " ".join(words)), (2, without(70)), (3, "other " + prose(rng, 100)), (4, without(170))]


def kept_rows(spark, rows):
    table = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = corpus_pipeline.keep_one_of_each_group(spark, table, "")
    assert kept.columns == table.columns
    return sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)


def test_near_copies_of_five_words_and_eighty_percent(spark):
    rows = near_rows(random.Random(9))
    # 330 / 400 is 82.5 %, 230 / 330 is 69.7 %
    assert [i for i, _ in kept_rows(spark, rows)] == [1, 3, 4]


def test_near_copies_with_missing_and_repeated_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    rows = [
        # a group without ids, and one with
        (None, a), (None, a + " tail"), (None, b), (7, b + " tail"),
        # a row twice, and an id with two texts of which one is a copy of another document's
        (8, c), (8, c), (9, d), (9, e), (5, e + " tail"), (None, None), (10, ""),
    ]
    kept = kept_rows(spark, rows)
    assert len(kept) == 7
    assert sum(t in (a, a + " tail") for _, t in kept) == 1
    expected = [(7, b + " tail"), (8, c), (9, d), (5, e + " tail"), (None, None), (10, "")]
    assert [x for x in kept if x[1] not in (a, a + " tail")] == sorted(expected, key=str)


@pytest.mark.parametrize("labelled", [200, 100, 0])
def test_linear_models_see_a_bounded_sample(spark, documents, monkeypatch, labelled):
    rng = random.Random(15)
    rows = [(k, prose(rng, 30)) for k in range(200)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(labelled)]
    # conflicting labels of one document count once
    labels += [(k, 1 - k % 2, True) for k in range(0, labelled, 5)]
    given = spark.createDataFrame([(a, int(b), int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")
    seen = []
    plain = weak_labels.fit_linear

    def counted(flat, starts, cast, target):
        seen.append(len(target))
        return plain(flat, starts, cast, target)

    monkeypatch.setattr(weak_labels, "fit_linear", counted)
    weak_labels.fit(documents(rows), given, sample=50)
    assert seen and max(seen) < 90


@pytest.mark.parametrize("bounded", [True, False])
def test_slices_of_classes_are_short_and_their_gradients_those_of_the_softmax(bounded):
    # one class has nearly all rows
    kind = np.sort(np.where(np.arange(5000) % 50 == 0, 3, 1))
    slices = pseudo_likelihood._class_slices(kind)
    assert max(rows.stop - rows.start for _, rows in slices) <= pseudo_likelihood.SLICE
    assert np.array_equal(np.concatenate([np.arange(5000)[rows] for _, rows in slices]), np.arange(5000))
    assert all((kind[rows] == c).all() for c, rows in slices)
    rng = np.random.default_rng(1)
    full, weights = rng.normal(size=(40, 5)).astype(np.float32), rng.normal(size=(5, 7)).astype(np.float32)
    full[:, -1], at = 1, rng.integers(0, 7, 40)
    back, gradient = pseudo_likelihood._back(full, weights, pseudo_likelihood._summing(weights), at, bounded)
    error = np.exp(full @ weights)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(40), at] -= 1
    assert np.allclose(back, error @ weights[:-1].T, atol=1e-4)
    assert np.allclose(gradient, full.T @ error, atol=1e-4)
