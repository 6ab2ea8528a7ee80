"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every document.  The vote patterns of all
documents are counted, expectation-maximisation over the counts estimates how often each heuristic
votes either way on either class, and the posterior of a document is its soft label.  A linear
model over hashed words and word shapes is fitted to the soft labels of a bounded sample and scores
every document.  Quality and toxicity are separate classes with heuristics of their own.  Where
people have labelled documents, their labels vote too, and those documents are in the sample first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import small_batches, text_buffers, without_nulls
from basketloom.llm.shingles import _BLANK, mixed, word_hashes

BUCKETS = 1 << 16
# documents that the linear models are fitted on, at most about this many
SAMPLE = 20_000
# the variety of words is measured in parts of so many words, as it falls with the length of a text
VARIETY_WORDS = 5000
# log-odds that a label given by people adds to those of the heuristics
LABEL_WEIGHT = 5.0
EM_ROUNDS, EPOCHS, RATE, DECAY = 40, 12, 0.5, 1e-7

# words of insult, in two lists that vote apart
INSULTS = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown", "loser", "jerk"),
    ("trash", "scum", "pathetic", "worthless", "disgusting", "filth", "vermin", "garbage"),
)
QUALITY = ("symbols", "capitals", "ends", "variety", "runs", "word_length", "digits")
TOXICITY = ("insults_a", "insults_b", "several")

SCORED = "doc_id long, n_words long, quality_label double, quality_score double, toxic_label double, toxic_score double"


def _of_words(words: Sequence[str]) -> np.ndarray:
    offsets, raw = text_buffers(pa.array(list(words)))
    return np.sort(word_hashes(offsets, raw)[0])


@dataclass
class Batch:
    """What the heuristics and the models see of a batch of texts."""

    n_words: np.ndarray
    quality: np.ndarray
    toxicity: np.ndarray
    # distinct features of each text, and where each text begins
    features: np.ndarray
    starts: np.ndarray


def describe(texts: pa.Array, hashed: bool = True) -> Batch:
    """Votes and, where ``hashed`` is set, the features of the linear models."""
    n = len(texts)
    offsets, raw = text_buffers(texts)
    words, of = word_hashes(offsets, raw)
    stripped, stripped_of = word_hashes(offsets, np.where(_LETTERS[raw], raw, 0x20).astype(np.uint8))
    n_words = np.bincount(of, minlength=n)
    at_least = np.maximum(n_words, 1)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags[raw]))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    # continuation bytes are not characters of their own
    chars = count(~_BLANK & ~_CONTINUES)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n)
    if hashed:
        shapes = _shapes(offsets, raw, n)
        features, starts = _distinct([(words, of), (stripped, stripped_of), shapes], n)
    else:
        features, starts = np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    # distinct words part by part
    n_parts = -(-at_least // VARIETY_WORDS)
    first_part, first_word = np.cumsum(n_parts) - n_parts, np.cumsum(n_words) - n_words
    part = first_part[of] + (np.arange(len(of)) - first_word[of]) // VARIETY_WORDS
    different = _distinct([(words, part)], int(n_parts.sum()))[1]
    variety = (different[first_part + n_parts] - different[first_part]) / at_least

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(n_words == 0, 0, np.where(bad, -1, np.where(good, 1, 0)))

    symbols, ends = count(_SYMBOLS) / at_least, count(_ENDS) / at_least
    capitals, digits = count(_CAPITALS) / np.maximum(chars, 1), count(_DIGITS) / np.maximum(chars, 1)
    length, runs = chars / at_least, again / at_least
    quality = np.stack(
        [
            vote(symbols <= 0.02, symbols > 0.2),
            vote(capitals < 0.15, capitals > 0.4),
            vote((ends >= 0.02) & (ends <= 0.25), ends > 1),
            vote(variety > 0.3, variety < 0.1),
            vote(runs < 0.05, runs > 0.2),
            vote((length >= 3) & (length <= 9), (length < 2) | (length > 20)),
            vote(digits < 0.1, digits > 0.5),
        ],
        axis=1,
    )
    hits = [
        np.bincount(stripped_of[np.isin(stripped, lexicon)], minlength=n) for lexicon in _INSULTS
    ]
    toxicity = np.stack(
        [
            np.where(hits[0] > 0, -1, 0),
            np.where(hits[1] > 0, -1, 0),
            np.where(hits[0] + hits[1] > 1, -1, np.where(hits[0] + hits[1] == 0, 1, 0)),
        ],
        axis=1,
    )
    return Batch(n_words, quality, toxicity, features, starts)


def _flags(characters: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters.encode())] = True
    return flags


_SYMBOLS, _ENDS, _DIGITS = _flags("#*$%&|<>"), _flags(".!?"), _flags("0123456789")
_CAPITALS = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_LETTERS = _CAPITALS | _flags("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_KIND = np.zeros(256, np.uint8)
for _k, _one in enumerate((_LETTERS & ~_CAPITALS, _CAPITALS, _DIGITS, _SYMBOLS, _ENDS)):
    _KIND[_one] = 0x61 + _k
_KIND[_BLANK] = 0x20
_KIND[_KIND == 0] = 0x7A
_INSULTS = [_of_words(words) for words in INSULTS]


def _shapes(offsets: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word's kinds of characters, repetitions left out by keeping both ends."""
    kinds = _KIND[raw]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    kept_before = np.append(0, np.cumsum(keep))
    hashes, of = word_hashes(kept_before[offsets], kinds[keep])
    return mixed(hashes + np.uint64(7)), of


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    buckets = np.concatenate([h % np.uint64(BUCKETS) for h, _ in parts]).astype(np.int64)
    of = np.concatenate([t for _, t in parts])
    keys = np.unique(of * BUCKETS + buckets)
    return keys % BUCKETS, np.searchsorted(keys // BUCKETS, np.arange(n + 1))


def pattern_codes(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ (3 ** np.arange(votes.shape[1]))


def expectation_maximisation(
    codes: np.ndarray, counts: np.ndarray, m: int, given: np.ndarray | float = 0
) -> np.ndarray:
    """Log-likelihood ratios (good over bad) by heuristic and vote (bad, none, good), then log-odds.

    A vote never counts against its own side, abstaining counts for nothing, and passing a
    heuristic, which most documents of either class do, counts little.  ``given`` is 1 or -1 where
    people said good or bad, 0 elsewhere.
    """
    votes = (codes[:, None] // 3 ** np.arange(m)) % 3
    # one bad vote is trusted at first, and only the counts can make it weak
    weights = np.tile([-6.0, 0.0, 0.2], (m, 1))
    odds = 1.0
    for _ in range(EM_ROUNDS):
        good = 1 / (1 + np.exp(-(odds + weights[np.arange(m), votes].sum(axis=1) + LABEL_WEIGHT * given)))
        mass_good, mass_bad = counts * good, counts * (1 - good)
        for j in range(m):
            p = np.bincount(votes[:, j], mass_good, minlength=3) + 1
            q = np.bincount(votes[:, j], mass_bad, minlength=3) + 1
            ratio = np.log(p / p.sum()) - np.log(q / q.sum())
            weights[j] = np.clip(ratio[0], -8, -0.5), 0.0, np.clip(ratio[2], 0, 0.5)
        odds = float(np.clip(np.log((mass_good.sum() + 1) / (mass_bad.sum() + 1)), -2, 3))
    return np.append(weights.ravel(), odds)


def posterior(votes: np.ndarray, fitted: np.ndarray, given: np.ndarray | float = 0) -> np.ndarray:
    """Probability of good; ``given`` is 1 or -1 where people said good or bad, 0 elsewhere."""
    m = votes.shape[1]
    weights = fitted[:-1].reshape(m, 3)
    odds = fitted[-1] + weights[np.arange(m), votes + 1].sum(axis=1)
    return 1 / (1 + np.exp(-(odds + LABEL_WEIGHT * given)))


def votes_cast(quality: np.ndarray, toxicity: np.ndarray) -> np.ndarray:
    """Which heuristic voted which way: the features beside the hashed ones."""
    votes = np.concatenate([quality, toxicity], axis=1)
    return np.concatenate([votes > 0, votes < 0], axis=1).astype(float)


VOTES = 2 * (len(QUALITY) + len(TOXICITY))


def linear_score(batch: Batch, weights: np.ndarray) -> np.ndarray:
    """Probability by the linear model: weights of distinct hashed features, of votes, and a bias."""
    size = np.diff(batch.starts)
    sums = np.append(0, np.cumsum(weights[batch.features]))
    total = sums[batch.starts[1:]] - sums[batch.starts[:-1]]
    cast = votes_cast(batch.quality, batch.toxicity)
    z = weights[-1] + cast @ weights[BUCKETS:-1] + total / np.sqrt(np.maximum(size, 1))
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(
    features: np.ndarray, starts: np.ndarray, cast: np.ndarray, target: np.ndarray
) -> np.ndarray:
    """Logistic regression on soft targets by AdaGrad over mini-batches; both classes weigh alike."""
    weights, squares = np.zeros(BUCKETS + VOTES + 1), np.full(BUCKETS + VOTES + 1, 1e-6)
    n = len(target)
    rng = np.random.default_rng(5)
    share = np.clip(target.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    # balanced, but not beyond tenfold
    cost = np.where(target >= 0.5, min(0.5 / share, 10), min(0.5 / (1 - share), 10))
    order = np.arange(n)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for first in range(0, n, 256):
            mine = order[first : first + 256]
            size = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            idx, row = features[at], np.repeat(np.arange(len(mine)), size)
            scale = 1 / np.sqrt(np.maximum(size, 1))
            z = weights[-1] + cast[mine] @ weights[BUCKETS:-1]
            z += np.bincount(row, weights[idx], minlength=len(mine)) * scale
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[mine]) * cost[mine] / len(mine)
            gradient = np.bincount(idx, (error * scale)[row], minlength=BUCKETS + VOTES + 1)
            gradient[BUCKETS:-1] = error @ cast[mine]
            gradient[-1] = error.sum()
            gradient += DECAY * weights
            squares += gradient**2
            weights -= RATE * gradient / np.sqrt(squares)
    return weights


@dataclass
class Models:
    quality_votes: np.ndarray
    toxic_votes: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray


def _vote_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        seen = describe(without_nulls(batch.column("text")), hashed=False)
        out = []
        for kind, (votes, c) in enumerate(((seen.quality, "quality"), (seen.toxicity, "toxic"))):
            both = np.stack([pattern_codes(votes), batch.column(c).to_numpy()], axis=1)
            both, counts = np.unique(both, axis=0, return_counts=True)
            out.append((np.full(len(both), kind), both[:, 0], both[:, 1], counts))
        columns = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in columns], names=["kind", "code", "said", "n"]
        )


def fit(
    documents: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE
) -> Models:
    """Vote models from all documents, linear models from about ``sample`` documents at most.

    ``labels`` (doc_id, quality, toxic), where given, vote in the posterior of their documents; null
    labels do not vote.  Labelled documents are sampled first, up to ``sample``, then others.  A hash
    of the id (of the text where there is none) selects, so the sample depends on nothing else.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if labels is None:
        pool = rows.select("doc_id").limit(0).select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    else:
        said = lambda c, yes: F.coalesce(F.when(F.col(c) == yes, 1).otherwise(-1), F.lit(0))
        pool = (
            labels.where("doc_id IS NOT NULL")
            .select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.when(F.col("quality").isNull(), 0).otherwise(said("quality", 1)).alias("quality"),
                F.when(F.col("toxic").isNull(), 0).otherwise(said("toxic", 0)).alias("toxic"),
            )
            # of conflicting labels the worse one counts
            .groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
            .join(rows.select("doc_id"), "doc_id", "left_semi")
        )
    parts = 1_000_000
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(parts))
    labelled, total = 0 if labels is None else pool.count(), rows.count()
    kept = parts if labelled <= sample else int(parts * sample / labelled)
    others, room = max(total - labelled, 0), max(sample - labelled, 0)
    if others == 0:
        kept_others = 0
    else:
        kept_others = parts if others <= room else int(parts * room / others)
    by_id = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts))
    # about ``sample`` rows at most; no others are taken where labelled ones had to be left out
    pool = pool.where(by_id < kept).withColumn("given", F.lit(True))
    none = F.lit(0)
    rows = rows.join(F.broadcast(pool), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("quality", none).alias("quality"),
        F.coalesce("toxic", none).alias("toxic"), F.coalesce("given", F.lit(False)).alias("given"),
    )
    # at most 3 ** heuristics rows for each class and label
    counted = (
        rows.select("text", "quality", "toxic")
        .mapInArrow(_vote_counts, "kind long, code long, said long, n long")
        .groupBy("kind", "code", "said")
        .agg(F.sum("n").alias("n"))
        .orderBy("kind", "code", "said")
        .toPandas()
    )
    fitted = []
    for kind, m in enumerate((len(QUALITY), len(TOXICITY))):
        mine = counted[counted.kind == kind]
        fitted.append(
            expectation_maximisation(
                mine.code.to_numpy(), mine.n.to_numpy(float), m, mine.said.to_numpy()
            )
        )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            seen = describe(without_nulls(batch.column("text")))
            quality, toxic = (batch.column(c).to_numpy() for c in ("quality", "toxic"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(
                        pa.array(seen.starts, pa.int32()), pa.array(seen.features, pa.int32())
                    ),
                    pa.array(list(votes_cast(seen.quality, seen.toxicity)), pa.list_(pa.float64())),
                    pa.array(posterior(seen.quality, fitted[0], quality)),
                    pa.array(1 - posterior(seen.toxicity, fitted[1], toxic)),
                ],
                names=["doc_id", "features", "cast", "quality", "toxic"],
            )

    taken = (
        rows.where(F.col("given") | (place < kept_others))
        .drop("given")
        .mapInArrow(features, "doc_id long, features array<int>, cast array<double>, quality double, toxic double")
        .toArrow()
        .sort_by([("doc_id", "ascending")])
        .combine_chunks()
    )
    if not taken.num_rows:
        nothing = np.zeros(BUCKETS + VOTES + 1)
        return Models(*fitted, nothing, nothing)
    lists = taken.column("features").combine_chunks()
    flat = lists.flatten().to_numpy().astype(np.int64)
    starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy())).astype(np.int64)
    cast = taken.column("cast").combine_chunks().flatten().to_numpy().reshape(-1, VOTES)
    return Models(
        *fitted,
        *(fit_linear(flat, starts, cast, taken.column(c).to_numpy()) for c in ("quality", "toxic")),
    )


def classify(documents: DataFrame, models: Models) -> DataFrame:
    """Soft labels and linear scores of every document, and ``kept``: good and not toxic.

    ``documents``: doc_id, text; other columns are ignored.  All heuristics abstain on a null or
    empty text, which is never kept.  Repeated rows are scored one by one.  No rows give no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in small_batches(batches):
            seen = describe(without_nulls(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(seen.n_words, pa.int64()),
                    pa.array(posterior(seen.quality, m.quality_votes)),
                    pa.array(linear_score(seen, m.quality)),
                    pa.array(1 - posterior(seen.toxicity, m.toxic_votes)),
                    pa.array(linear_score(seen, m.toxic)),
                ],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
    good = (F.col("n_words") > 0) & (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return scored.withColumn("kept", good)


def quality_classifier(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return classify(documents, fit(documents, labels))
