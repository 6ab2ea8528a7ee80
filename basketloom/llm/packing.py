"""Packing documents into training sequences as a cutting-stock problem.

Every document becomes token ids, is cut into pieces of at most ``CAPACITY`` tokens, and the pieces
are counted by length class.  Over that histogram a linear program chooses how often to use which
pattern of classes: column generation starts from simple patterns, and a knapsack dynamic program
prices new ones with the dual values until none can improve the bound by more than ``GAP``.  The
patterns are rounded down, the small rest of the histogram is filled longest piece first, and the
pieces, ranked within their class, are assigned to the slots of the patterns.

Only the histogram (at most one row per class) and the patterns reach the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketloom.runtime import Scratch

CAPACITY = 2048
END_ID = 1
GAP = 0.002
CACHED_WORDS = 1_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int"
)
PIECES_WITH_IDS = PIECES + ", ids array<int>"

# letters, digits and marks whose lower case and composed form need no look at their neighbours
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-įĲ-ňŊ-ž–—‘-”•…€]*+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class WordIds:
    """Token ids of texts, looking each word up once.

    The tokenizer lower-cases, drops white space and merges inside words only, so a text's ids are
    the ids of its words in order.  Texts with characters outside a plain set, where normalisation
    looks at neighbours, and texts with the tokenizer's own special strings are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        # fixed value: the word pattern of the tokenizer file
        self.parts = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        )
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def look_up(self, word: str) -> bytes:
        """Ids of a lower-case word between blanks; its parts are remembered too."""
        known = self.known_parts
        out = []
        for part in self.parts.findall(word):
            ids = known.get(part)
            if ids is None:
                letters = part.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
                known[part] = ids
            out.append(ids)
        return b"".join(out)

    def of(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers, with the end id."""
        end = END_ID.to_bytes(4, "little")
        if "<|" in text or _PLAIN.fullmatch(text) is None:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, "<u4").tobytes() + end
        words = text.lower().split()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
            self.known_parts.clear()
        for word in set(words).difference(known):
            known[word] = self.look_up(word)
        return b"".join([known[w] for w in words]) + end


_word_ids: dict[str, WordIds] = {}


def tokenized(path: str, capacity: int, keep_ids: bool):
    """A ``mapInArrow`` function: documents to pieces of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _word_ids.get(path) or _word_ids.setdefault(path, WordIds(path))
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                ids = encoder.of(text or "")
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, task)
                    rows.append((*row, np.frombuffer(piece, "<i4")) if keep_ids else row)
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * keep_ids
            names = [c.split()[0] for c in PIECES_WITH_IDS.split(", ")][: len(kinds)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    return run


def class_sizes(capacity: int) -> np.ndarray:
    """Ascending upper lengths of the classes: each is at most 1/32 above the one before."""
    sizes = [1]
    while sizes[-1] < capacity:
        sizes.append(min(capacity, sizes[-1] + max(1, sizes[-1] // 32)))
    return np.asarray(sizes)


def best_fill(capacity: int, sizes: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, float]:
    """The most worthy pattern within ``capacity``, by a knapsack program over the capacity.

    ``sizes`` ascend.  Returns the counts per class and their worth.
    """
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        k = fitting[c]
        if k:
            got = value[c - sizes[:k]] + worth[:k]
            best = int(got.argmax())
            if got[best] > value[c]:
                value[c], choice[c] = got[best], best
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return counts, float(value[capacity])


def column_generation(sizes: np.ndarray, wanted: np.ndarray, capacity: int, gap: float = GAP):
    """Patterns (one row each, counts per class) and their fractional use for ``wanted`` pieces.

    Columns are priced at a mix of the current dual values and the best ones so far, which keeps
    the dual values from swinging; the best ones also bound the optimum from below.
    """
    m = len(sizes)
    per = capacity // sizes
    basis = np.diag(per)
    inverse = np.diag(1.0 / per)
    use = wanted / per

    def enter(column: np.ndarray) -> bool:
        nonlocal inverse, use
        if inverse.sum(axis=0) @ column <= 1 + 1e-9:
            return False
        direction = inverse @ column
        up = direction > 1e-9
        ratio = np.where(up, use / np.where(up, direction, 1), np.inf)
        leaving = int(np.argmin(ratio))
        step = ratio[leaving]
        pivot_row = inverse[leaving] / direction[leaving]
        inverse = inverse - np.outer(direction, pivot_row)
        inverse[leaving] = pivot_row
        use = np.maximum(use - step * direction, 0)
        use[leaving] = step
        basis[leaving] = column
        return True

    for _, column in greedy_fill(sizes, wanted, capacity):
        enter(column)
    # the share of the capacity is a feasible dual value for every class
    center = sizes / capacity
    bound = float(wanted @ center)
    weight = 0.8
    # half a sequence is less than what rounding costs
    while use.sum() > max((1 + gap) * bound, bound + 0.5):
        mixed = weight * center + (1 - weight) * inverse.sum(axis=0)
        column, worth = best_fill(capacity, sizes, mixed)
        if worth > 0 and wanted @ mixed / worth > bound:
            bound, center = float(wanted @ mixed / worth), mixed / worth
        if not enter(column):
            if weight < 1e-6:
                break
            weight /= 2
    return basis, use


def greedy_fill(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple]:
    """Patterns that take the longest piece left, then the longest that still fits, and so on."""
    left = wanted.astype(np.int64).copy()
    plan = []
    while left.any():
        counts = np.zeros(len(sizes), np.int64)
        room = capacity
        for k in range(len(sizes) - 1, -1, -1):
            counts[k] = min(left[k], room // sizes[k])
            room -= int(counts[k] * sizes[k])
        has = counts > 0
        times = int((left[has] // counts[has]).min())
        left -= times * counts
        plan.append((times, counts))
    return plan


def cutting_plan(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple]:
    """Whole patterns for all ``wanted`` pieces: (times, counts per class)."""
    if not len(sizes):
        return []
    patterns, use = column_generation(sizes, wanted, capacity)
    left = wanted.astype(np.int64).copy()
    plan = []
    for k in np.argsort(-use, kind="stable"):
        counts = patterns[k]
        has = counts > 0
        # a class may be over-covered by the linear program, so never take more than there is
        times = min(int(use[k] + 1e-9), int((left[has] // counts[has]).min()))
        if times:
            left -= times * counts
            plan.append((times, counts))
    return plan + greedy_fill(sizes, left, capacity)


def slots_of(plan: list[tuple]) -> list[tuple]:
    """Rows (class, first rank, end rank, per sequence, first sequence, first place)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, counts in plan:
        place = 0
        for k in np.flatnonzero(counts)[::-1]:
            k, per = int(k), int(counts[k])
            first = taken.get(k, 0)
            taken[k] = first + per * int(times)
            rows.append((k, first, taken[k], per, sequence, place))
            place += per
        sequence += int(times)
    return rows


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of documents with the sequence and offset each one gets.

    ``documents``: doc_id, text; other columns are ignored.  Returns doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and ids where ``keep_ids`` is set.  A document's
    ids end with ``END_ID``; a null or empty text has that id alone.  Rows that repeat an id are
    packed each on its own, null ids included.  No rows give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    sizes = class_sizes(capacity)
    pieces = scratch.keep(
        documents.select("doc_id", "text").mapInArrow(
            tokenized(tokenizer_path, capacity, keep_ids), PIECES_WITH_IDS if keep_ids else PIECES
        )
    )
    bounds = F.array(*[F.lit(int(s)) for s in sizes])
    # the first class that is as long as the piece; the bounds ascend
    classed = pieces.withColumn(
        "class", (F.size(F.filter(bounds, lambda b: b < F.col("length")))).cast("int")
    )
    cells = classed.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most one row per class
    histogram = cells.groupBy("class").agg(F.sum("n").alias("n")).orderBy("class").collect()
    live = np.asarray([r["class"] for r in histogram], np.int64)
    wanted = np.asarray([r["n"] for r in histogram], np.int64)
    rows = [
        (int(live[k]), *rest) for k, *rest in slots_of(cutting_plan(sizes[live], wanted, capacity))
    ]
    slots = spark.createDataFrame(
        rows,
        "class int, first long, until long, per long, first_sequence long, first_place long",
    )
    inside = Window.partitionBy("class", "task").orderBy("doc_id", "start")
    ranked = (
        classed.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["class", "task"])
        .withColumn("rank", F.col("rank") - 1 + F.col("before"))
    )
    in_slot = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(slots), "class").where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until"))
    )
    along = Window.partitionBy("sequence_id").orderBy("place", "doc_id", "start")
    return (
        placed.withColumn("sequence_id", F.expr("first_sequence + (rank - first) div per"))
        .withColumn("place", F.col("first_place") + F.pmod(in_slot, F.col("per")))
        .withColumn("offset", F.sum("length").over(along) - F.col("length"))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
            *["ids"] * keep_ids,
        )
    )
