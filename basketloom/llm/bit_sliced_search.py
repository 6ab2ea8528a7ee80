"""Ranked lexical search by bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms and of (term, level) for every level of
``LEVELS`` that the term's count reaches.  Documents with signatures of one width are gathered in
blocks and a block is stored transposed: slice b is a bitmap with one bit per document.  The slices of
a key's bits, ANDed, give a bitmap of all documents that may hold the key; it overestimates, but never
misses one.  The highest level all of whose lower levels are present bounds the count of a term, so
that weighted sums of the bitmaps are upper bounds of the scores.

Documents with the highest bounds are scored exactly first; their 10th best score is one that the
result reaches in any case.  In a second pass over the slices a document is left out only if its
bound, or its id where the bound is equal, proves that it cannot be among the best.  All others are
scored from their whole texts.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketloom.llm.common import small_batches, without_nulls
from basketloom.llm.decontaminate import words_of
from basketloom.runtime import Scratch

# counts a signature tells apart
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024, 4096)
# bits of a signature for each key, and bits set by a key
BITS_PER_KEY, HASHES = 12, 6
# widest signature; texts with more keys have looser bounds and are scored from their texts more often
WIDEST = 1 << 20
# bytes of one block of slices (or 64 documents), and documents of one block at most
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 512
# terms of the items searched for in one pass
PASS_TERMS = 16_000
# items whose bounds are summed at a time
ITEMS_AT_A_TIME = 256
# documents to be scored that are sent to all tasks; more are joined by shuffling
SENT_DOCUMENTS = 200_000
TOP = 10
UNIT = 1_000_000_000

BLOCKS = "width int, doc_ids array<long>, n_terms array<long>, slices binary"


def level_keys(counts: Counter) -> np.ndarray:
    """32-bit keys of all (term, level) of a document."""
    words = np.fromiter((crc32(w) for w in counts), np.uint64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    reached = [words]
    for k, level in enumerate(LEVELS[1:], 1):
        words, tf = words[tf >= level], tf[tf >= level]
        if not len(words):
            break
        reached.append(_at_level(words, k))
    return np.concatenate(reached)


def _at_level(words: np.ndarray, level: int) -> np.ndarray:
    return (words + np.uint64(level * 0x9E3779B1)) & np.uint64(0xFFFFFFFF)


def bit_positions(keys: np.ndarray, width: int) -> np.ndarray:
    """Positions (keys x HASHES) in signatures of ``width`` bits, a power of two."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(33)) | np.uint64(1)
    at = mixed[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    # the upper bits of a product, so that neighbouring sums end far apart
    at *= np.uint64(0xD6E8FEB86659FD93)
    return (at >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def signature_width(n_keys: int) -> int:
    return min(max(64, 1 << (n_keys * BITS_PER_KEY - 1).bit_length()), WIDEST)


def build_signatures(documents: DataFrame) -> DataFrame:
    """Blocks of bit slices over all documents with a term; ``documents``: doc_id, text."""

    def block(width: int, rows: list[tuple]) -> tuple:
        padded = -(-len(rows) // 64) * 64
        bits = np.zeros((padded, width // 8), np.uint8)
        for r, (_, _, signature) in enumerate(rows):
            bits[r] = signature
        # transposed by strips, whose unpacked bits are eight times as large
        strip = max(1, (1 << 22) // padded)
        slices = [
            np.packbits(
                np.unpackbits(bits[:, k : k + strip], axis=1, bitorder="little").T, axis=1, bitorder="little"
            )
            for k in range(0, width // 8, strip)
        ]
        return width, [r[0] for r in rows], [r[1] for r in rows], np.concatenate(slices).tobytes()

    def as_batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["width", "doc_ids", "n_terms", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = defaultdict(list)
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, without_nulls(batch.column("text")), strict=True):
                words = words_of(text.as_buffer().to_pybytes())
                if not words:
                    continue
                keys = level_keys(Counter(words))
                width = signature_width(len(keys))
                rows = waiting[width]
                signature = np.zeros(width, bool)
                signature[bit_positions(keys, width)] = True
                rows.append((doc_id, len(words), np.packbits(signature, bitorder="little")))
                if len(rows) >= min(BLOCK_ROWS, max(64, BLOCK_BYTES * 8 // width)):
                    yield as_batch([block(width, rows)])
                    waiting[width] = []
        for width, rows in waiting.items():
            if rows:
                yield as_batch([block(width, rows)])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def document_counts(documents: DataFrame, terms: list[bytes]) -> Counter:
    """In how many documents each of ``terms`` stands, counted from the whole texts."""
    sent = documents.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        counts = np.zeros(len(numbers), np.int64)
        for batch in small_batches(batches):
            for text in without_nulls(batch.column("text")):
                held = numbers.keys() & set(words_of(text.as_buffer().to_pybytes()))
                if held:
                    counts[[numbers[t] for t in held]] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["term", "df"])

    rows = (
        documents.select("text")
        .mapInArrow(run, "term long, df long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .collect()
    )
    return Counter({terms[r.term]: r.df for r in rows})


@dataclass
class Searched:
    """Items of one pass with the statistics their scores need."""

    items: list[tuple[int | None, list[int]]]  # item id, its terms by number
    terms: dict[bytes, int]
    weights: np.ndarray
    n_documents: int
    n_words: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        """8 * m of documents with ``n`` terms; Python integers where 64 bits may not do."""
        top = 90 * self.n_documents * int(n.max() if len(n) else 0)
        n = n.astype(object) if top >= 1 << 63 else n
        return (8 * (10 + (90 * n * self.n_documents) // self.n_words)).astype(np.int64)

    def matrix(self, first: int, last: int) -> np.ndarray:
        """Weights (items x terms) of a range of the items."""
        out = np.zeros((last - first, len(self.terms)))
        for row, (_, terms) in enumerate(self.items[first:last]):
            out[row, terms] = self.weights[terms]
        return out


def score_parts(tf, damping):
    return (UNIT * tf) // (1000 * tf + damping)


def upper_bounds(block: dict, s: Searched, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First item and bounds (items x documents of the block), a slice of the items at a time.

    Sums of up to ``PASS_TERMS`` integers of 36 bits are exact in doubles.
    """
    width, n = block["width"], np.array(block["n_terms"], np.int64)
    slices = np.frombuffer(block["slices"], np.uint64).reshape(width, -1)
    damping = s.damping(n)
    highest = min(int(n.max()), LEVELS[-1])
    parts = np.zeros((len(words), len(n)))
    live, before, present = np.arange(len(words)), np.zeros(len(n)), None
    for k, level in enumerate(LEVELS):
        if level > highest or not len(live):
            break
        at = bit_positions(_at_level(words[live], k) if k else words, width)
        maybe = np.bitwise_and.reduce(slices[at], axis=1)
        present = maybe if present is None else present & maybe
        # a count of this level is below the next one, and no count is above the document's length
        most = np.minimum(LEVELS[k + 1] - 1, n) if k + 1 < len(LEVELS) else n
        worth = score_parts(most, damping).astype(float)
        some = present.any(axis=1)
        live, present = live[some], present[some]
        bits = np.unpackbits(present.view(np.uint8), axis=1, bitorder="little")[:, : len(n)]
        parts[live] += bits * (worth - before)
        before = worth
    for first in range(0, len(s.items), ITEMS_AT_A_TIME):
        yield first, s.matrix(first, min(first + ITEMS_AT_A_TIME, len(s.items))) @ parts


def _term_keys(s: Searched) -> np.ndarray:
    return np.array([crc32(t) for t in s.terms], np.uint64)


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _order(score, doc_id) -> tuple:
    """Ascending by rank from the worst: higher scores, then smaller ids, ids before none."""
    return score, doc_id is not None, -(doc_id or 0)


def likely_documents(blocks: DataFrame, s: Searched, top: int) -> DataFrame:
    """The ``top`` documents with the highest bounds for each item: item (its number), doc_id."""
    sent = blocks.sparkSession.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        words = _term_keys(s)
        best: dict[int, list] = defaultdict(list)
        for batch in batches:
            for block in _blocks(batch):
                ids = block["doc_ids"]
                for first, bounds in upper_bounds(block, s, words):
                    high = np.argpartition(-bounds, min(top, len(ids)) - 1, axis=1)[:, :top]
                    for row, places in enumerate(high):
                        for p in places:
                            if bounds[row, p] > 0:
                                entry = (*_order(int(bounds[row, p]), ids[p]), ids[p])
                                _push(best[first + row], entry, top)
        rows = [(item, e[-1], e[0]) for item, entries in best.items() for e in entries]
        yield _rows(rows, ("item", "doc_id", "bound"))

    found = blocks.mapInArrow(run, "item long, doc_id long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last())
    # at most top rows of every item and task reach the window
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).select("item", "doc_id")


def _push(heap: list, entry: tuple, top: int) -> None:
    # the counter-free entries compare by rank; equal ones are the same document id and score
    if len(heap) < top:
        heapq.heappush(heap, entry)
    elif entry[:-1] > heap[0][:-1]:
        heapq.heapreplace(heap, entry)


def _rows(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=list(names))


def possible_documents(blocks: DataFrame, s: Searched, least: dict[int, tuple]) -> DataFrame:
    """doc_id and the items (their numbers) for which a document is not provably excluded.

    ``least`` holds, for an item with enough scored documents, the score and id of the last of its
    best ones; a bound that is lower, or equal with a larger id, excludes.
    """
    sent = blocks.sparkSession.sparkContext.broadcast((s, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, least = sent.value
        words = _term_keys(s)
        nothing = (1, math.inf)
        floors = np.array([least.get(k, nothing)[0] for k in range(len(s.items))], float)[:, None]
        last = np.array([math.inf if (x := least.get(k, nothing)[1]) is None else x for k in range(len(s.items))])
        for batch in batches:
            for block in _blocks(batch):
                ids = block["doc_ids"]
                said = np.array([math.inf if i is None else i for i in ids], float)
                items: list[list[int]] = [[] for _ in ids]
                for first, bounds in upper_bounds(block, s, words):
                    f = floors[first : first + len(bounds)]
                    in_time = said[None, :] <= last[first : first + len(bounds), None]
                    # document by document, so that the items of one come together
                    for p, row in np.argwhere(((bounds > f) | ((bounds == f) & in_time)).T):
                        items[p].append(first + int(row))
                held = [p for p, found in enumerate(items) if found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[p] for p in held], pa.int64()),
                        pa.array([items[p] for p in held], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "items"],
                )

    return blocks.mapInArrow(run, "doc_id long, items array<long>")


def scored(documents: DataFrame, wanted: DataFrame, s: Searched, top: int) -> DataFrame:
    """item, doc_id, score: the best ``top`` of every item and task, of the ``wanted`` (doc_id, items).

    All rows of a wanted id are scored, each from its whole text.
    """
    sent = documents.sparkSession.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        best: dict[int, list] = defaultdict(list)
        for batch in small_batches(batches):
            ids, asked = batch.column("doc_id").to_pylist(), batch.column("items").to_pylist()
            for doc_id, items, text in zip(ids, asked, without_nulls(batch.column("text")), strict=True):
                words = words_of(text.as_buffer().to_pybytes())
                if not words:
                    continue
                damping = int(s.damping(np.array([len(words)], np.int64))[0])
                held = {s.terms[t]: tf for t, tf in Counter(words).items() if t in s.terms}
                worth = {t: int(s.weights[t]) * score_parts(tf, damping) for t, tf in held.items()}
                for item in set(items):
                    score = sum(worth.get(t, 0) for t in s.items[item][1])
                    if score > 0:
                        _push(best[item], (*_order(score, doc_id), doc_id), top)
        rows = [(item, e[-1], e[0]) for item, entries in best.items() for e in entries]
        yield _rows(rows, ("item", "doc_id", "score"))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    joined = rows.join(wanted.alias("w"), same).select("d.doc_id", "text", "items")
    return joined.mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_passes(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with their different terms, in passes; texts that share an item_id are one item."""
    rows = (
        items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
        .orderBy("item_id", "text")
        .toLocalIterator()
    )
    taken, n = [], 0
    for item_id, texts in groupby(rows, key=lambda r: r.item_id):
        terms = {t for r in texts for t in words_of(r.text.encode())}
        if not terms:
            continue
        if taken and n + len(terms) > most_terms:
            yield taken
            taken, n = [], 0
        taken.append((item_id, terms))
        n += len(terms)
    if taken:
        yield taken


def ranked_search(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    pass_terms: int = PASS_TERMS,
    sent_documents: int = SENT_DOCUMENTS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item, with scores above 0.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored.  Null and empty
    texts have no terms: such a document is never found, such an item finds nothing.  Equal scores are
    ranked by id, rows without an id last; repeated rows are ranked one by one.  Rows of items that
    share an id are one item.  Empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "search")
    blocks = scratch.keep(build_signatures(documents))
    size = blocks.select(F.explode("n_terms").alias("n")).agg(F.count("*"), F.sum("n")).head()
    result = None
    for taken in item_passes(items, pass_terms):
        if not size[0]:
            break
        terms = sorted(set().union(*[t for _, t in taken]))
        df = document_counts(documents, terms)
        numbers = {t: k for k, t in enumerate(terms)}
        weight = lambda t: math.floor(1000 * math.log((2 * size[0] + 2) / (2 * df[t] + 1)))
        s = Searched(
            [(item_id, sorted(numbers[t] for t in held if df[t])) for item_id, held in taken],
            numbers,
            np.array([weight(t) if df[t] else 0 for t in terms], np.int64),
            size[0],
            size[1],
        )
        # at most top documents of every item
        likely = scratch.keep(likely_documents(blocks, s, top).groupBy("doc_id").agg(F.collect_set("item").alias("items")))
        first = _best(scored(documents, F.broadcast(likely), s, top), top).where(F.col("rank") == top)
        least = {r.item: (r.score, r.doc_id) for r in first.collect()}
        possible = scratch.keep(
            possible_documents(blocks, s, least)
            .select("doc_id", F.explode("items").alias("item"))
            .groupBy("doc_id")
            .agg(F.collect_set("item").alias("items"))
        )
        if possible.count() <= sent_documents:
            possible = F.broadcast(possible)
        best = _best(scored(documents, possible, s, top), top)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(s.items)], "item long, item_id long")
        best = scratch.keep(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
        result = best if result is None else result.unionByName(best)
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return result
