"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads words and writes symbols: insult (strong or mild), threat, target, negation,
reporting verb.  Punctuation writes the ends of clauses and sentences.  Three small transducers follow:

* negation consumes a negating word and turns the next insult or threat of its clause into a negated one;
* target joins an insult or threat with a person addressed or spoken of in the same clause;
* report holds back what a sentence says until it is known whether the sentence reports another's words.

They are composed into one machine, which writes one outcome for every insult or threat, in order: what
was said, whether it had a target, was negated, or was reported.  The weights of the outcomes and words
of the lexicon beyond the seeds are learned from labelled documents.  Words and beginnings of words
that stand in toxic documents far more often than chance allows join the lexicon.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import small_batches, without_nulls

# labelled documents that the lexicon and the weights are learned from, at most about so many
FIT_ROWS = 20_000
# learned entries of the lexicon at most
LEXICON = 20_000
# documents an entry must stand in, log-odds it must reach, and log-odds of a strong insult
LEAST_DOCUMENTS, LEAST_ODDS, STRONG_ODDS = 4, 2.0, 4.0
# code points of learned beginnings of words
STEMS = range(3, 7)
# a seed that stands in so many documents must be found more often in toxic ones
SEED_DOCUMENTS, SEED_ODDS = 20, 0.5
FOLDS, HELD_OUT = 5, 0
# precision of the Gaussian priors on the weights, steps of the fit
PRECISION, STEPS = 1.0, 25
# words whose symbols a task remembers
REMEMBERED = 500_000

# seeds of the lexical transducer; a star stands for any ending
SEEDS = {
    "i": """idiot* moron* imbecile* scum* loser* stupid pathetic worthless disgusting trash clown* pig* dumb*
        vermin filth* parasite* bastard* bitch* asshole* retard* degenerate* dummkopf* arschloch* abschaum
        trottel* vollidiot* versager* connard* salope* ordure* débile* crétin* estúpid* imbécil* basura
        escoria inútil* asqueros*""",
    "t": """kill* murder* stab* shoot* strangle* slaughter* hang* burn* punch* beat* destroy* hurt* umbringen
        töten töte ermorden erschießen schlagen tuer tuerai frapper crever égorger matar mataré golpear""",
    "g": """you your yours yourself u ya they them their these those people everyone him her he she du dich dir
        dein* ihr euch sie tu toi vous votre vos ils elles eux usted ustedes tú tus ellos ellas""",
    "n": """not no never none nobody neither nor without isn't aren't wasn't don't doesn't didn't won't can't
        cannot kein* nicht nie niemals ohne pas jamais aucun* sans nunca jamás ningun* sin tampoco""",
    "r": """said says say told tells called calls wrote writes quoted quotes claimed claims stated reported
        reports alleged according sagte sagt schrieb behauptete nannte laut dit disait écrit déclaré selon
        dijo dice escribió afirmó según""",
}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?\n\r;:,()\[\]\"“”„«»]")
MINOR, MAJOR = set(";:,()[]\"“”„«»"), set(".!?\n\r")

SAID = ("strong", "mild", "threat")
# outcome kinds of the machine: what was said, how, and whether it is reported
PLAIN = [f"{how} {what}" for what in SAID for how in ("targeted", "bare")] + ["negated insult", "negated threat"]
OUTCOMES = [*PLAIN, *(f"reported {p}" for p in PLAIN)]
# prior means of the weights: bias, then per outcome
_PRIOR = {
    "targeted strong": 3.0, "bare strong": 2.0, "targeted mild": 1.0, "bare mild": 0.5,
    "targeted threat": 2.5, "bare threat": 0.3, "negated insult": 0.2, "negated threat": 0.0,
}
BIAS = -2.5
PRIOR = np.array([BIAS, *(_PRIOR[o] for o in PLAIN), *(0.3 * _PRIOR[o] for o in PLAIN)])


@dataclass
class Transducer:
    """A sequential transducer: (state, symbol) to the next state and the symbols written."""

    start: object
    arcs: dict[tuple, tuple[object, tuple]] = field(default_factory=dict)

    def symbols(self) -> list:
        return sorted({symbol for _, symbol in self.arcs})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what ``first`` writes to ``second``; reachable states only."""
    out = Transducer((first.start, second.start))
    symbols, todo, seen = first.symbols(), [out.start], {out.start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            a, between = first.arcs[state[0], symbol]
            b, written = state[1], []
            for middle in between:
                b, said = second.arcs[b, middle]
                written.extend(said)
            out.arcs[state, symbol] = ((a, b), tuple(written))
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return out


def negation_transducer() -> Transducer:
    """i, m, t become x (insult) or y (threat) after an n of their clause; a second n takes it back."""
    t = Transducer(False)
    for negated in (False, True):
        for s in "imtg":
            said = {"i": "x", "m": "x", "t": "y"}.get(s) if negated else None
            t.arcs[negated, s] = (False, (said,)) if said else (negated, (s,))
        t.arcs[negated, "n"] = (not negated, ())
        t.arcs[negated, "r"] = (negated, ("r",))
        t.arcs[negated, ","] = (False, (",",))
        t.arcs[negated, "."] = (False, (".",))
    return t


def target_transducer() -> Transducer:
    """Holds an insult or threat until its clause ends or another one comes, then writes its kind."""
    names = {"i": "strong", "m": "mild", "t": "threat"}

    def kind(held: str, targeted: bool) -> tuple:
        if not held:
            return ()
        if held in "xy":
            return ("negated insult" if held == "x" else "negated threat",)
        return (f"{'targeted' if targeted else 'bare'} {names[held]}",)

    t = Transducer(("", False))
    for held in ("", *"imtxy"):
        for targeted in (False, True):
            for s in "imtxy":
                t.arcs[(held, targeted), s] = ((s, targeted), kind(held, targeted))
            t.arcs[(held, targeted), "g"] = ((held, True), ())
            t.arcs[(held, targeted), "r"] = ((held, targeted), ("r",))
            for s in ",.":
                end = (".",) if s == "." else ()
                t.arcs[(held, targeted), s] = (("", False), (*kind(held, targeted), *end))
    return t


def report_transducer() -> Transducer:
    """Writes the number of an outcome once its sentence has ended or gone on to another outcome."""

    def outcome(held: str, reported: bool) -> tuple:
        return (OUTCOMES.index(f"reported {held}" if reported else held),) if held else ()

    t = Transducer(("", False))
    for held in ("", *PLAIN):
        for reported in (False, True):
            for s in PLAIN:
                t.arcs[(held, reported), s] = ((s, reported), outcome(held, reported))
            t.arcs[(held, reported), "r"] = ((held, True), ())
            t.arcs[(held, reported), "."] = (("", False), outcome(held, reported))
    return t


@dataclass
class Machine:
    """The composed transducers with numbered states."""

    arcs: list[dict[str, tuple[int, tuple[int, ...]]]]

    @classmethod
    def build(cls) -> Machine:
        whole = compose(compose(negation_transducer(), target_transducer()), report_transducer())
        numbers = {whole.start: 0}
        for state, _ in whole.arcs:
            numbers.setdefault(state, len(numbers))
        arcs: list[dict] = [{} for _ in numbers]
        for (state, symbol), (following, written) in whole.arcs.items():
            arcs[numbers[state]][symbol] = (numbers[following], written)
        return cls(arcs)

    def run(self, symbols: Iterator[str]) -> list[int]:
        """Outcomes in the order of the insults and threats; a text ends like a sentence."""
        arcs, state, found = self.arcs, 0, []
        for s in symbols:
            state, written = arcs[state][s]
            if written:
                found.extend(written)
        found.extend(arcs[state]["."][1])
        return found


class Lexicon(dict):
    """Lexical transducer from words to symbols, "" for other words; longer entries win.

    Beginnings of words are a trie walked letter by letter; results are remembered.
    """

    def __init__(self, entries: dict[str, str]) -> None:
        super().__init__()
        self.entries = entries
        self.trie: dict = {}
        for entry, symbol in entries.items():
            if entry.endswith("*"):
                node = self.trie
                for letter in entry[:-1]:
                    node = node.setdefault(letter, {})
                node[""] = symbol

    def __missing__(self, word: str) -> str:
        found = self.entries.get(word)
        if found is None:
            found = ""
            if word in MAJOR:
                found = "."
            elif word in MINOR:
                found = ","
            else:
                node = self.trie
                for letter in word:
                    node = node.get(letter)
                    if node is None:
                        break
                    found = node.get("", found)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.entries,)


def seed_entries() -> dict[str, str]:
    return {word: symbol for symbol, words in SEEDS.items() for word in words.split()}


def clauses(text: str, lexicon: Lexicon, machine: Machine) -> list[tuple[int, int, int]]:
    """Start, end (code points of the lower-cased text) and outcome of every insult or threat."""
    lowered = text.lower()
    symbols = [lexicon[w] for w in _TOKEN.findall(lowered)]
    evaluated = [k for k, s in enumerate(symbols) if s and s in "imt"]
    if not evaluated:
        return []
    outcomes = machine.run(s for s in symbols if s)
    wanted, places = set(evaluated), []
    for k, match in enumerate(_TOKEN.finditer(lowered)):
        if k in wanted:
            places.append(match.span())
    return [(start, end, o) for (start, end), o in zip(places, outcomes, strict=True)]


def features(found: list[tuple[int, int, int]]) -> np.ndarray:
    """1, then the damped count of every outcome."""
    counts = np.bincount([o for _, _, o in found], minlength=len(OUTCOMES)) if found else np.zeros(len(OUTCOMES))
    return np.append(1.0, np.log2(1.0 + counts))


def units_of(text: str) -> set[str]:
    """Different words of a text, and their beginnings marked with a star."""
    words = {w for w in _TOKEN.findall(text.lower()) if w not in MINOR and w not in MAJOR}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def family(text: str) -> int:
    """The smallest hash of three words in a row; most near copies of a text share it."""
    words = text.lower().split()
    return min((crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(len(words) - 2, 1))), default=0)


def learned_entries(units: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, str]:
    """Insults that the counts (unit, toxic documents, clean documents) tell from chance.

    A unit's log-likelihood ratio must be so large that of all units tested about one would reach it
    by chance.  A beginning yields to a longer one that stands in nearly all its toxic documents, a
    whole word to a beginning that is in the lexicon.
    """
    if not toxic or not clean or not units:
        return {}
    names = [u for u, _, _ in units]
    n1, n0 = (np.array([u[k] for u in units], float) for k in (1, 2))
    rate, share = toxic / (toxic + clean), n1 / (n1 + n0)
    side = lambda n, p, q: n * np.log(np.where(n > 0, p, 1.0) / q)
    ratio = 2 * (side(n1, share, rate) + side(n0, 1 - share, 1 - rate))
    odds = np.log((n1 + 0.5) / (toxic + 1)) - np.log((n0 + 0.5) / (clean + 1))
    good = (odds >= LEAST_ODDS) & (ratio >= 2 * np.log(len(units)))
    order = sorted(np.flatnonzero(good).tolist(), key=lambda k: (-ratio[k], names[k]))[:LEXICON]
    kept = {names[k]: (n1[k], odds[k]) for k in order}
    held = {u: n for u, (n, _) in kept.items()}
    for unit in held:
        for parent in [f"{unit.rstrip('*')[:n]}*" for n in STEMS]:
            if parent != unit and parent in kept and held[unit] >= 0.9 * held[parent]:
                del kept[parent]
    known = {u[:-1] for u in kept if u.endswith("*")}
    covered = lambda u: not u.endswith("*") and any(u[:n] in known and len(u) > n for n in STEMS)
    return {u: "i" if o >= STRONG_ODDS else "m" for u, (_, o) in kept.items() if not covered(u)}


def lexicon_of(units: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
    """Seeds that the labels do not speak against, and learned entries."""
    entries = seed_entries()
    for unit, a, b in units:
        if entries.get(unit) in ("i", "t") and a + b >= SEED_DOCUMENTS:
            if np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)) < SEED_ODDS:
                del entries[unit]
    learned = learned_entries(units, toxic, clean)
    # roles other than insults are the grammar's own
    roles = {u for u, s in entries.items() if s in "gnrt"}
    return Lexicon(entries | {u: s for u, s in learned.items() if u not in roles})


def fit_weights(rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights with Gaussian priors around ``PRIOR``, by Newton's method."""
    w = PRIOR.copy()
    for _ in range(STEPS if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -500, 500)))
        slope = rows.T @ (toxic - p) - PRECISION * (w - PRIOR)
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + PRECISION * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return w


@dataclass
class Grammar:
    lexicon: Lexicon
    machine: Machine
    weights: np.ndarray


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo ``FOLDS``; rows without an id are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT).cast("long"))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, half: about ``most`` labelled documents outside the held-out fold, at most.

    Rows of ``labels`` that share an id count as one, toxic if any of them is; null labels are none.
    """
    said = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
        .where(fold(F.col("doc_id")) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    n, parts = said.count(), 1_000_000
    place = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    taken = said.where(place < (parts if n <= most else int(parts * most / n)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).cast("int")
    return rows.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic", half.alias("half"))


def fit(documents: DataFrame, labels: DataFrame | None, most: int = FIT_ROWS) -> Grammar:
    """Lexicon and weights from a bounded sample of labelled documents (``most``).

    Weights are fitted on outcomes that a lexicon of the other half of the sample gives, so that words
    learned from a document do not vouch for themselves.  Without labels the seeds and priors stand.
    """
    machine = Machine.build()
    if labels is None:
        return Grammar(Lexicon(seed_entries()), machine, PRIOR)

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = without_nulls(batch.column("text")).to_pylist()
            yield batch.append_column("family", pa.array([family(t) for t in texts], pa.int64()))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            texts = without_nulls(batch.column("text")).to_pylist()
            for text, toxic, half in zip(
                texts, batch.column("toxic").to_pylist(), batch.column("half").to_pylist(), strict=True
            ):
                counts.setdefault((half, toxic), Counter()).update(units_of(text) | {""})
        for (half, toxic), found in counts.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found), pa.string()),
                    pa.array([half] * len(found), pa.int32()),
                    pa.array([toxic] * len(found), pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["unit", "half", "toxic", "n"],
            )

    cells = [(half, toxic) for half in (0, 1) for toxic in (1, 0)]
    rows = labelled_sample(documents, labels, most)
    one = F.min(F.struct("doc_id", "text", "half"))
    distinct = (
        rows.mapInArrow(families, "doc_id long, text string, toxic int, half int, family long")
        .groupBy("family", "toxic")
        .agg(one.alias("one"))
        .select("one.text", "toxic", "one.half")
    )
    # units of at most ``most`` documents
    counted = (
        distinct.mapInArrow(units, "unit string, half int, toxic int, n long")
        .groupBy("unit")
        .agg(
            *[
                F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}")
                for h, t in cells
            ]
        )
        .where((F.col("unit") == "") | (sum(F.col(f"n{h}{t}") for h, t in cells) >= LEAST_DOCUMENTS))
        .toPandas()
    )
    seen = counted[counted.unit == ""]
    counted = counted[counted.unit != ""]
    total = lambda c: int(seen[c].sum())

    def lexicon(halves: tuple[int, ...]) -> Lexicon:
        a, b = (sum(counted[f"n{h}{t}"] for h in halves) for t in (1, 0))
        enough = (a + b) >= LEAST_DOCUMENTS
        listed = zip(counted.unit[enough], a[enough], b[enough], strict=True)
        toxic, clean = (sum(total(f"n{h}{t}") for h in halves) for t in (1, 0))
        return lexicon_of([(u, int(x), int(y)) for u, x, y in listed], toxic, clean)

    other = documents.sparkSession.sparkContext.broadcast((lexicon((1,)), lexicon((0,)), machine))

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *lexicons, machine = other.value
        for batch in small_batches(batches):
            texts = without_nulls(batch.column("text")).to_pylist()
            halves = batch.column("half").to_pylist()
            found = [features(clauses(t, lexicons[h], machine)) for t, h in zip(texts, halves, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"]
            )

    # at most about ``most`` rows
    fitted = rows.mapInArrow(outcomes, "toxic int, x array<double>").toPandas()
    # in one order, so that the sums do not depend on the layout
    fitted = fitted.iloc[np.lexsort([*np.stack(fitted.x.tolist()).T, fitted.toxic])] if len(fitted) else fitted
    if fitted.toxic.nunique() < 2:
        return Grammar(Lexicon(seed_entries()), machine, PRIOR)
    weights = fit_weights(np.stack(fitted.x.tolist()), fitted.toxic.to_numpy(float))
    return Grammar(lexicon((0, 1)), machine, weights)


SCORED = "doc_id long, score double, clauses array<struct<start:long,end:long,outcome:string>>"


def score(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1), and the matched clauses with their outcomes, of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in small_batches(batches):
            scores, matched = [], []
            for text in without_nulls(batch.column("text")).to_pylist():
                found = clauses(text, g.lexicon, g.machine)
                z = float(features(found) @ g.weights)
                scores.append(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))
                matched.append([{"start": a, "end": b, "outcome": OUTCOMES[o]} for a, b, o in found])
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("outcome", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(matched, pa.list_(kind))],
                names=["doc_id", "score", "clauses"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)


def toxicity(documents: DataFrame, labels: DataFrame | None = None, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses of every document.

    ``documents``: doc_id, text; ``labels``: doc_id, toxic; other columns are ignored.  Labels of the
    held-out fold are never looked at.  Null and empty texts have the score of a text without matches.
    Repeated rows are scored one by one.  Without labels, or with labels of one kind only, seeds and
    prior weights decide.  No rows give no rows.
    """
    scored = score(documents, fit(documents, labels, most))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "clauses",
    )
