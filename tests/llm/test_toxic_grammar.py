"""The grammar against a plain reading of its rules, and learned lexicons on held-out documents."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from basketloom.llm import toxic_grammar as t


def plain_outcomes(symbols):
    """The rules read clause by clause, without transducers."""
    out = []
    sentence, clause, kinds, reported = [], [], [], False

    def end_clause():
        targeted_at = [k for k, s in enumerate(clause) if s == "g"]
        said, negated = [], False
        for k, s in enumerate(clause):
            if s == "n":
                negated = not negated
            elif s in "imt":
                said.append((k, s, negated))
                negated = False
        for place, (_, s, negated) in enumerate(said):
            # a target counts up to the next insult or threat
            until = said[place + 1][0] if place + 1 < len(said) else len(clause)
            if negated:
                sentence.append("negated threat" if s == "t" else "negated insult")
            else:
                name = {"i": "strong", "m": "mild", "t": "threat"}[s]
                sentence.append(("targeted " if any(g < until for g in targeted_at) else "bare ") + name)
        clause.clear()

    # a report counts for an outcome unless a later outcome of the sentence comes first
    events = []
    for s in [*symbols, "."]:
        if s == "r":
            events.append(("r", len(clause)))
        if s in ",.":
            end_clause()
            kinds.append((s, list(sentence)))
            sentence.clear()
        elif s != "r":
            clause.append(s)
    return kinds, events, out


def test_outcomes_without_reports_follow_the_rules():
    machine = t.Machine.build()
    for n in range(1, 6):
        for symbols in itertools.product("imtgn,.", repeat=n):
            kinds, _, _ = plain_outcomes(symbols)
            expected = [k for _, found in kinds for k in found]
            assert [t.OUTCOMES[o] for o in machine.run(symbols)] == expected, symbols


@pytest.mark.parametrize(
    "text,expected",
    [
        ("You are an idiot.", ["targeted strong"]),
        ("Idiot!", ["bare strong"]),
        ("You are not an idiot.", ["negated insult"]),
        ("You are not clever, you idiot.", ["targeted strong"]),
        ("He said that you are an idiot. Fine.", ["reported targeted strong"]),
        ("\"You idiot\", he said.", ["reported targeted strong"]),
        ("He said so. You are an idiot.", ["targeted strong"]),
        ("I will kill you", ["targeted threat"]),
        ("I will never kill you", ["negated threat"]),
        ("how to kill a process", ["bare threat"]),
        ("you idiot moron", ["targeted strong", "targeted strong"]),
        ("IDIOTISCH", ["bare strong"]),
        ("", []),
        ("a clean sentence, said you", []),
    ],
)
def test_sentences(text, expected):
    found = t.clauses(text, t.Lexicon(t.seed_entries()), t.Machine.build())
    assert [t.OUTCOMES[o] for _, _, o in found] == expected
    for start, end, _ in found:
        assert text.lower()[start:end].strip(" ,.!\"") == text.lower()[start:end] != ""


def test_longest_entry_wins_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 3)
    lexicon = t.Lexicon({"ab*": "m", "abcd*": "i", "abcde": "g", "x": "n"})
    words = {"ab": "m", "abc": "m", "abcd": "i", "abcdef": "i", "abcde": "g", "a": "", "x": "n", "xx": "", ".": ".", ",": ","}
    for word, symbol in [*words.items(), *words.items()]:
        assert lexicon[word] == symbol
        assert len(lexicon) <= 3


def test_composition_equals_running_one_after_the_other():
    first, second = t.negation_transducer(), t.target_transducer()
    both = t.compose(first, second)

    def run(machine, symbols):
        state, out = machine.start, []
        for s in symbols:
            state, said = machine.arcs[state, s]
            out += said
        return out

    for symbols in itertools.product("imtgnr,.", repeat=4):
        assert run(both, symbols) == run(second, run(first, symbols))


def test_learned_entries_need_more_than_chance():
    units = [(f"noise{k}", k % 3, 4 + k % 5) for k in range(500)] + [("slur", 30, 0), ("slur*", 30, 0), ("slu*", 40, 300)]
    units += [("bad1", 9, 0), ("bad2", 9, 0), ("bad*", 40, 1), ("common", 90, 900)]
    learned = t.learned_entries(units, 100, 1000)
    assert set(learned) == {"slur*", "bad*"} or set(learned) == {"slur", "bad*"}
    assert t.learned_entries(units, 0, 10) == {} == t.learned_entries([], 5, 5)


def labelled(spark, n=600):
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = list(r.choice(words, 40))
        toxic = k % 6 == 0
        if toxic:
            text[7], text[30] = f"zorg{words[k % 50]}", "kwerf"
        rows.append((k, " ".join(text), "clash", 0.5))
        labels.append((k, 1, int(toxic)))
    labels += [(5, 1, None), (None, 1, 1), (0, 1, 0), (10**6, 1, 1)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, half string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_words_learned_from_labels_find_held_out_documents(spark):
    documents, labels = labelled(spark)
    got = t.toxicity(documents, labels).where("held_out").collect()
    assert len(got) > 80
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in got)


def test_held_out_labels_are_not_looked_at(spark):
    from pyspark.sql import functions as F

    documents, labels = labelled(spark, 200)
    turned = labels.withColumn("toxic", F.when(t.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain, other = (
        sorted(t.toxicity(documents, x).select("doc_id", "score").collect()) for x in (labels, turned)
    )
    assert plain == other


def test_sample_is_bounded(spark):
    documents, labels = labelled(spark)
    assert t.labelled_sample(documents, labels, 100).count() < 150
    assert t.labelled_sample(documents, labels, 10**6).count() > 400


def test_toxicity_edges(spark, documents, edge_rows):
    given = documents(edge_rows)
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    for labels in (None, empty, one_kind):
        got = t.toxicity(given, labels).collect()
        assert len(got) == len(edge_rows)
        assert all(0 <= r.score < 0.5 and r.predicted == 0 and r.clauses == [] for r in got)
    assert t.toxicity(given.limit(0), one_kind).count() == 0
    insulted = documents([(1, "You are an idiot. " * 3), (None, "You are an idiot. " * 3)])
    assert [r.predicted for r in t.toxicity(insulted).collect()] == [1, 1]
