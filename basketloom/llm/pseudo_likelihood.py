"""Masked pseudo-likelihood of documents by a bidirectional window network.

The network sees the two words on either side of a word and predicts the word itself, which it
never sees.  A document's score is the sum of the log-probabilities of its words.  The words of all
documents are counted first.  Every frequent word has an id of its own (``Sizes`` says which), so the
ids, the classes of the two-level softmax (class, word within class) and the parameters grow with
the corpus.  Rarer words share ids by hash, and the probability of a shared id is spread over its
words by their counts, with one more for words never seen.

Ids, counted words and learners grow with the square root of the corpus, as the vocabulary of natural
text does: what is broadcast has a proven bound, and what all learners send together, learners times
parameters, grows like the corpus and no faster.

Every document trains the network once: in each round the learners start from the shared parameters,
run mini-batches over their part of that round's documents, and the parameters are averaged by the
number of words, block by block on the executors.  Documents are dealt to the learners, and ordered
there, by the hash of id and text, so the model does not depend on how the input is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.llm.common import small_batches, text_buffers, without_nulls
from basketloom.llm.shingles import word_hashes
from basketloom.runtime import Scratch

# sizes without a counted vocabulary: all words share ids by hash
CLASSES, IN_CLASS = 64, 64
WORDS = CLASSES * IN_CLASS
# at least so often occurs a word with an id of its own; a shared id stands for ten times as much
OWN_COUNT, SHARED = 200, 10
SIDE, EMBEDDING, HIDDEN = 2, 8, 16
ROUNDS, BATCH, RATE = 2, 8192, 0.05
BLOCKS = 64
# probabilities need no order of training, so larger batches serve as well
SCORED, SLICE = 65536, 512


@dataclass(frozen=True)
class Sizes:
    """What follows from the number of words of a corpus.

    Words that occur ``own`` times have an id of their own: at most 18 times the root of the corpus.
    Words that occur ``known`` times, at most 200 times the root, are sent to the tasks.
    ``learners`` train side by side on about 200 times the root each.
    """

    words: int

    @property
    def own(self) -> int:
        return max(OWN_COUNT, isqrt(OWN_COUNT * self.words) // 250)

    @property
    def shared(self) -> int:
        return SHARED * self.own

    @property
    def known(self) -> int:
        return min(self.own, max(2, isqrt(self.words) // 200))

    @property
    def learners(self) -> int:
        return max(1, isqrt(self.words) // 200)


@dataclass
class Vocabulary:
    """Which id a word has, and which share of the id's probability.

    ``hashes`` are the known words, ascending, with their ``counts`` and their ``own`` ids (-1: shared).
    ``mass`` is how often the words of each shared id occur together, ``low`` how often its words
    that are not known occur on average, and so often as well the words never seen; shared ids come
    after the own ones.  Without any mass all words share the ids by hash, unspread.
    """

    classes: int = CLASSES
    in_class: int = IN_CLASS
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    own: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    mass: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    low: np.ndarray = field(default_factory=lambda: np.empty(0, float))
    learners: int = 1

    @property
    def words(self) -> int:
        return self.classes * self.in_class

    @property
    def shapes(self) -> tuple[tuple[str, tuple[int, ...]], ...]:
        """Parameter arrays; the last embedding stands for what lies beyond the text."""
        return (
            ("embedding", (self.words + 1, EMBEDDING)),
            ("mixing", (2 * SIDE * EMBEDDING, HIDDEN)),
            ("class_out", (HIDDEN + 1, self.classes)),
            ("word_out", (self.classes, HIDDEN + 1, self.in_class)),
        )

    @property
    def n_parameters(self) -> int:
        return sum(int(np.prod(shape)) for _, shape in self.shapes)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of each word and the logarithm of its share of the id."""
        if not len(self.mass):
            return (hashes % np.uint64(self.words)).astype(np.int64), np.zeros(len(hashes))
        n_own = self.words - len(self.mass)
        # a text repeats its words: each is looked up once
        found, place = np.unique(hashes, return_inverse=True)
        ids, share = np.full(len(found), -1), np.zeros(len(found))
        counts = np.zeros(len(found))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            known = self.hashes[at] == found
            ids[known], counts[known] = self.own[at[known]], self.counts[at[known]]
        shared = ids < 0
        bucket = (found[shared] % np.uint64(len(self.mass))).astype(np.int64)
        low = self.low[bucket]
        count = np.where(counts[shared] > 0, counts[shared], low)
        share[shared] = np.log(count / (self.mass[bucket] + low))
        ids[shared] = n_own + bucket
        return ids[place], share[place]


HASHED = Vocabulary()
SHAPES, N_PARAMETERS = HASHED.shapes, HASHED.n_parameters


@dataclass
class Model:
    vocabulary: Vocabulary
    flat: np.ndarray


def unpacked(flat: np.ndarray, vocabulary: Vocabulary = HASHED) -> dict[str, np.ndarray]:
    """Views of the parameter arrays inside one flat array."""
    out, at = {}, 0
    for name, shape in vocabulary.shapes:
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh_parameters(seed: int = 3, vocabulary: Vocabulary = HASHED) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.1, vocabulary.n_parameters).astype(np.float32)
    parts = unpacked(flat, vocabulary)
    parts["class_out"][:] = 0
    parts["word_out"][:] = 0
    return flat


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        offsets, raw = text_buffers(without_nulls(batch.column("text")))
        words, counts = np.unique(word_hashes(offsets, raw)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64)), pa.array(counts, pa.int64())], names=["word", "n"]
        )


def count_words(documents: DataFrame) -> Vocabulary:
    """The vocabulary of all documents.

    The driver and every task hold the known words, 24 bytes each; ``Sizes`` bounds their number.
    """
    scratch = Scratch(documents.sparkSession, "words")
    counted = scratch.keep(
        documents.select("text")
        .mapInArrow(_word_counts, "word long, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    sizes = Sizes(counted.agg(F.sum("n")).first()[0] or 0)
    rare, low = F.col("n") < sizes.own, F.col("n") < sizes.known
    n_own, rare_mass = counted.agg(F.count_if(~rare), F.sum(F.when(rare, F.col("n")))).first()
    # at least one shared id, for words never seen
    n_shared = max(1, -(-(rare_mass or 0) // sizes.shared))
    in_class = max(1, int(np.ceil(np.sqrt(n_own + n_shared))))
    classes = -(-(n_own + n_shared) // in_class)
    # no id is left without a word
    n_shared = classes * in_class - n_own
    # hashes are unsigned
    split = F.lit(1 << 32)
    high, rest = F.shiftrightunsigned("word", 32), F.col("word").bitwiseAND(F.lit((1 << 32) - 1))
    bucket = ((high % n_shared) * (split % n_shared) + rest) % n_shared
    masses = (
        counted.where(rare)
        .groupBy(bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"), F.avg(F.when(low, F.col("n"))).alias("low"))
        .select("bucket", "n", F.coalesce("low", F.lit(1.0)).alias("low"))
        .toArrow()
    )
    mass, average = np.zeros(n_shared, np.int64), np.ones(n_shared)
    mass[masses.column("bucket").to_numpy()] = masses.column("n").to_numpy()
    average[masses.column("bucket").to_numpy()] = masses.column("low").to_numpy()
    known = counted.where(~low).toArrow()
    hashes, counts = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    # words of a class are about equally frequent
    own = np.full(len(hashes), -1)
    by_count = np.lexsort((hashes, -counts))[:n_own]
    own[by_count] = np.arange(n_own)
    scratch.drop(counted)
    return Vocabulary(classes, in_class, hashes, counts, own, mass, average, sizes.learners)


def windows(
    texts: pa.Array, vocabulary: Vocabulary = HASHED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, the ids around each (two left, two right) and the text of each word."""
    return _windows(texts, vocabulary)[:3]


def _windows(texts: pa.Array, vocabulary: Vocabulary):
    """``windows``, and the logarithm of each word's share of its id."""
    offsets, raw = text_buffers(texts)
    hashes, of = word_hashes(offsets, raw)
    ids, share = vocabulary.look_up(hashes)
    around = np.full((len(ids), 2 * SIDE), vocabulary.words)
    for k, shift in enumerate((-2, -1, 1, 2)):
        a, b = max(0, -shift), min(len(ids), len(ids) - shift)
        if a < b:
            same = of[a:b] == of[a + shift : b + shift]
            around[a:b, k] = np.where(same, ids[a + shift : b + shift], vocabulary.words)
    return ids, around, of, share


def _with_bias(hidden: np.ndarray) -> np.ndarray:
    return np.concatenate([hidden, np.ones((len(hidden), 1), np.float32)], axis=1)


def _bounded(parts: dict) -> bool:
    """Whether no power of e can overflow: hidden values and the bias are within -1 and 1."""
    return max(np.abs(parts[name]).sum(axis=-2).max() for name in ("class_out", "word_out")) < 60


def _log_chance(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    """Logarithm of the softmax at one place of each row."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(z)), at].astype(float)
    # a product adds up short rows several times faster than a sum does
    return chosen - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _summing(weights: np.ndarray) -> np.ndarray:
    """The weights with ones for the bias: what is multiplied by them has its sums in the last column."""
    out = weights.copy()
    out[..., -1, :] = 1
    return out


def _back(
    full: np.ndarray, weights: np.ndarray, summing: np.ndarray, at: np.ndarray, bounded: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative logarithm of a softmax, by the hidden values and by the weights.

    The powers of e are never divided by their sums: the smaller arrays beside them are.
    """
    z = full @ weights
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    back = z @ summing.T
    sums = back[:, -1:]
    flat = z.ravel()
    flat[np.arange(0, flat.size, z.shape[1]) + at] -= sums[:, 0]
    back = back[:, :-1] / sums
    back -= np.ascontiguousarray(weights[:-1].T).take(at, axis=0)
    return back, (z.T @ (full / sums)).T


def _by_class(kind: np.ndarray) -> np.ndarray:
    """Stable order by class; numbers of 16 bits are sorted by counting."""
    return np.argsort(kind.astype(np.uint16) if kind.max() < 1 << 16 else kind, kind="stable")


def _class_slices(kind: np.ndarray) -> list[tuple[int, slice]]:
    """The rows of each class in ascending ``kind``, at most ``SLICE`` of them at a time.

    The class of the most frequent words has a great part of all rows.
    """
    cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]]).tolist()
    found = kind[cuts[:-1]].tolist()
    return [
        (c, slice(first, min(first + SLICE, b)))
        for c, a, b in zip(found, cuts[:-1], cuts[1:], strict=True)
        for first in range(a, b, SLICE)
    ]


def log_probabilities(parts: dict, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Natural log-probability of each word given the words around it."""
    out, in_class, bounded = np.empty(len(ids)), parts["word_out"].shape[2], _bounded(parts)
    for first in range(0, len(ids), SCORED):
        mine = ids[first : first + SCORED]
        kind = mine // in_class
        order = _by_class(kind)
        mine, kind, seen = mine[order], kind[order], around[first : first + SCORED].take(order, axis=0)
        x = parts["embedding"].take(seen.ravel(), axis=0).reshape(len(mine), -1)
        hidden = _with_bias(np.tanh(x @ parts["mixing"]))
        word = mine - kind * in_class
        chance = np.empty(len(mine))
        # a slice at a time stays in the processor's cache
        for a in range(0, len(mine), SLICE):
            rows = slice(a, a + SLICE)
            chance[rows] = _log_chance(hidden[rows] @ parts["class_out"], kind[rows], bounded)
        for c, rows in _class_slices(kind):
            z = hidden[rows] @ parts["word_out"][c]
            chance[rows] += _log_chance(z, word[rows], bounded)
        out[first + order] = chance
    return out


class Trainer:
    """AdaGrad over mini-batches of one task."""

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary = HASHED) -> None:
        self.flat = flat.copy()
        self.parts = unpacked(self.flat, vocabulary)
        self.squares = unpacked(np.full(len(flat), 1e-4, np.float32), vocabulary)
        self.in_class = vocabulary.in_class
        self.place = np.zeros(vocabulary.words + 1, np.int64)
        self.seen = 0

    def _move(self, name: str, gradient: np.ndarray, where=slice(None)) -> None:
        squares = self.squares[name][where] + gradient * gradient
        self.squares[name][where] = squares
        gradient *= RATE
        gradient /= np.sqrt(squares, out=squares)
        self.parts[name][where] -= gradient

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        p, n = self.parts, len(ids)
        kind = ids // self.in_class
        order = _by_class(kind)
        ids, kind, around = ids[order], kind[order], around.take(order, axis=0)
        x = p["embedding"].take(around.ravel(), axis=0).reshape(n, -1)
        hidden = np.tanh(x @ p["mixing"])
        full = _with_bias(hidden)
        word = ids - kind * self.in_class
        back = np.empty((n, HIDDEN), np.float32)
        gradient, bounded = np.zeros_like(p["class_out"]), _bounded(p)
        weights, summing = p["class_out"], _summing(p["class_out"])
        for a in range(0, n, SLICE):
            rows = slice(a, a + SLICE)
            back[rows], part = _back(full[rows], weights, summing, kind[rows], bounded)
            gradient += part
        self._move("class_out", gradient)
        # classes that do not occur have no gradient and stay
        weights, summing = p["word_out"], _summing(p["word_out"])
        gradient = np.zeros_like(weights)
        for c, rows in _class_slices(kind):
            to_hidden, part = _back(full[rows], weights[c], summing[c], word[rows], bounded)
            back[rows] += to_hidden
            gradient[c] += part
        self._move("word_out", gradient)
        back *= 1 - hidden**2
        to_words = (p["mixing"] @ back.T).reshape(2 * SIDE, EMBEDDING, n)
        self._move("mixing", x.T @ back)
        # only the embeddings that were seen move
        flat = around.T.ravel()
        self.place[flat] = 1
        seen = np.flatnonzero(self.place)
        self.place[seen] = np.arange(len(seen))
        place = self.place[flat]
        self.place[seen] = 0
        gradient = np.empty((len(seen), EMBEDDING), np.float32)
        for d in range(EMBEDDING):
            gradient[:, d] = np.bincount(place, to_words[:, d].ravel(), minlength=len(seen))
        self._move("embedding", gradient, seen)
        self.seen += n

    def run(self, ids: np.ndarray, around: np.ndarray, batch: int = BATCH) -> None:
        for first in range(0, len(ids), batch):
            self.step(ids[first : first + batch], around[first : first + batch])


def _blocks(numbers, weights, values: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, np.float32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int32()),
            pa.array(weights, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float32())),
        ],
        names=["block", "weight", "values"],
    )


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted averages of the blocks of one shuffle partition, held one per block number."""
    sums: dict[int, np.ndarray] = {}
    weights: dict[int, int] = {}
    for batch in batches:
        values = batch.column("values")
        for k, (block, weight) in enumerate(
            zip(batch.column("block").to_pylist(), batch.column("weight").to_pylist(), strict=True)
        ):
            part = weight * values[k].values.to_numpy().astype(float)
            sums[block] = sums.get(block, 0) + part
            weights[block] = weights.get(block, 0) + weight
    means = [(sums[b] / weights[b]).astype(np.float32) for b in sums]
    yield _blocks(list(sums), [weights[b] for b in sums], means)


def train(documents: DataFrame, rounds: int = ROUNDS, size: int = BATCH) -> Model:
    """Vocabulary of all documents, and parameters after every document has been trained on once, in ``rounds`` shares by hash.

    ``size`` is the number of words of a mini-batch.
    """
    spark: SparkSession = documents.sparkSession
    vocabulary = count_words(documents)
    flat = fresh_parameters(vocabulary=vocabulary)
    words = spark.sparkContext.broadcast(vocabulary)
    deal = F.xxhash64("text", "doc_id")
    texts = documents.select("text", deal.alias("deal"))
    share = F.pmod("deal", F.lit(rounds))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value, words.value)
            for batch in small_batches(batches):
                ids, around, _ = windows(without_nulls(batch.column("text")), words.value)
                trainer.run(ids, around, size)
            if trainer.seen:
                parts = np.array_split(trainer.flat, BLOCKS)
                yield _blocks(np.arange(BLOCKS), np.full(BLOCKS, trainer.seen), parts)

        learned = (
            texts.where(share == k)
            .repartition(vocabulary.learners, "deal")
            .sortWithinPartitions("deal")
            .mapInArrow(learn, "block int, weight long, values array<float>")
        )
        # BLOCKS rows, one network in all
        rows = (
            learned.repartition("block")
            .mapInArrow(_averaged, "block int, weight long, values array<float>")
            .toArrow()
        )
        if rows.num_rows:
            values = rows.column("values").combine_chunks()
            flat = np.concatenate(
                [values[k].values.to_numpy() for k in np.argsort(rows.column("block").to_numpy())]
            )
        sent.unpersist()
    return Model(vocabulary, flat)


def score(documents: DataFrame, model: Model | np.ndarray) -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum) and per_word of every document.

    ``documents``: doc_id, text; other columns are ignored.  A null or empty text has no words, a
    sum of 0 and a null mean.  Repeated rows are scored one by one.  No rows give no rows.
    Parameters without a vocabulary are those of hashed ids.
    """
    if not isinstance(model, Model):
        model = Model(HASHED, model)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary
        parts = unpacked(sent.value.flat, vocabulary)
        for batch in small_batches(batches):
            ids, around, of, share = _windows(without_nulls(batch.column("text")), vocabulary)
            n = np.bincount(of, minlength=batch.num_rows)
            total = np.bincount(
                of, log_probabilities(parts, ids, around) + share, minlength=batch.num_rows
            )
            mean = np.where(n > 0, total / np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(total, pa.float64()),
                    pa.array(mean, pa.float64(), mask=n == 0),
                ],
                names=["doc_id", "n_words", "log_likelihood", "per_word"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, log_likelihood double, per_word double"
    )


def pseudo_likelihood(documents: DataFrame) -> DataFrame:
    """Train on all documents, then score all of them."""
    return score(documents, train(documents))
