"""Product codes of vectors, nearest entries found by slicing sorted coordinates and intersecting masks.

A vector is cut into equal parts and every part is replaced by the index of the nearest entry of that
part's codebook.  The search for the nearest entry is exact: per dimension the entries' coordinates
are sorted and carry prefix masks (bit e of mask k tells whether entry e is among the k smallest).
Two binary searches cut the range [x - r, x + r] out of a dimension, the two prefix masks at its ends
differ in exactly the entries inside, and the masks of all dimensions are ANDed.  What is left is the
box of radius r around the part, which holds every entry within distance r.  Only those entries are
measured.  Parts whose best distance is above r are searched once more with that distance as the
radius; parts whose box is empty with twice the radius.

Codebooks are trained in rounds over the stored integer vectors.  A task sends one row of sums for
each (part, entry), so a round moves a few thousand numbers whatever the input, and a hot label or a
large group of equal vectors costs what other rows cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.runtime import Scratch, join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# entries held by one word of a mask
WORD = 64
# rows of one search, which bounds the masks and candidates held at a time
SEARCH_ROWS = 8_192
# components up to this size keep squared distances within 64 bits; larger ones are searched as Python integers
EXACT_LIMIT = 1 << 28
LONGEST = (1 << 63) - 1
# labels whose sums are sent to every task; more are joined by shuffling
SENT_LABELS = 100_000


class MaskIndex:
    """The entries of one part: sorted coordinates and prefix masks of every dimension."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        self.words = -(-n // WORD)
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        self.prefix = np.zeros((width, n + 1, self.words), np.uint64)
        for d in range(width):
            for k, e in enumerate(self.order[:, d]):
                self.prefix[d, k + 1] = self.prefix[d, k]
                self.prefix[d, k + 1, e // WORD] |= np.uint64(1) << np.uint64(e % WORD)

    def box(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries within ``radius`` in every dimension."""
        found = None
        for d in range(parts.shape[1]):
            low = np.searchsorted(self.sorted[:, d], parts[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[:, d], parts[:, d] + radius, side="right")
            inside = self.prefix[d, high] ^ self.prefix[d, low]
            found = inside if found is None else found & inside
        return found

    def nearest(self, parts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (the lowest index of equally near ones) and squared distance of each row."""
        n = len(parts)
        best = np.zeros(n, np.int64)
        error = np.zeros(n, parts.dtype)
        if not parts.shape[1]:
            return best, error
        left, reach = np.arange(n), np.full(n, max(radius, 1), parts.dtype)
        while len(left):
            rows, entries = self._members(self.box(parts[left], reach))
            apart = parts[left[rows]] - self.entries[entries]
            squared = (apart * apart).sum(axis=1)
            # members come by row, then by entry: the first smallest one of a row is the lowest index
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            seen = rows[first]
            least = np.minimum.reduceat(squared, first) if len(first) else squared
            counts = np.diff(np.append(first, len(rows)))
            ties = np.flatnonzero(squared == np.repeat(least, counts))
            ties = ties[np.flatnonzero(np.diff(rows[ties], prepend=-1))]
            best[left[seen]], error[left[seen]] = entries[ties], least
            settled = least <= reach[seen] * reach[seen]
            # an entry at distance s lies in the box of radius isqrt(s) + 1
            reach = 2 * reach
            again = seen[~settled]
            reach[again] = [isqrt(int(s)) + 1 for s in least[~settled]]
            open_rows = np.ones(len(left), bool)
            open_rows[seen[settled]] = False
            left, reach = left[open_rows], reach[open_rows]
        return best, error

    def _members(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")
        return np.nonzero(bits[:, : len(self.entries)])


@dataclass
class Codebooks:
    """Entries (parts x entries x width) and a search radius for every part."""

    entries: np.ndarray
    radius: list[int]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def large(self) -> bool:
        return bool(self.entries.size) and int(np.abs(self.entries.astype(object)).max()) >= EXACT_LIMIT


def _as_matrix(column, width: int) -> np.ndarray:
    """Integer vectors of an Arrow list column, filled up with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy().astype(np.int64)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _large(matrix: np.ndarray) -> bool:
    return bool(matrix.size) and max(-int(matrix.min()), int(matrix.max())) >= EXACT_LIMIT


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector: ``floor(scale * x)``; vectors with missing or non-finite numbers go.

    A component beyond 64 bits becomes the largest or smallest 64-bit integer.
    """
    x = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
    return embeddings.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda c: F.floor(x(c) * scale).cast("long")).alias("vector"),
    )


def first_entries(vectors: DataFrame, parts: int, entries: int, width: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; rows without an id come last."""
    first = (
        vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
        .limit(entries)
        .select("vector")
        .toArrow()
    )
    matrix = _as_matrix(first.column("vector"), width)
    books = np.stack(np.split(matrix, parts, axis=1))
    return Codebooks(books, [_least_gap(b) for b in books])


def _least_gap(entries: np.ndarray) -> int:
    """A first radius: the median distance of the entries to the first one."""
    apart = (entries[1:] - entries[0].astype(object)).astype(object)
    gaps = sorted(isqrt(int(s)) for s in (apart * apart).sum(axis=1))
    return max(gaps[len(gaps) // 2], 1) if gaps else 1


def _searched(batches, books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their matrix, codes and errors (rows x parts)."""
    parts, _, width = books.entries.shape
    kinds = {False: [MaskIndex(part) for part in books.entries]}
    # differences of such numbers pass 64 bits
    kinds[True] = [MaskIndex(part.astype(object)) for part in books.entries]
    large = books.large()
    for whole in batches:
        for at in range(0, whole.num_rows, SEARCH_ROWS):
            batch = whole.slice(at, SEARCH_ROWS)
            matrix = _as_matrix(batch.column("vector"), parts * width)
            exact = large or _large(matrix)
            matrix = matrix.astype(object) if exact else matrix
            found = [
                index.nearest(matrix[:, p * width : (p + 1) * width], books.radius[p])
                for p, index in enumerate(kinds[exact])
            ]
            yield batch, matrix, np.stack([c for c, _ in found], 1), np.stack([e for _, e in found], 1)


def train_round(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Assign every part and move every used entry to the floor of its parts' mean."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python integers: the sums of a part may pass 64 bits at any size of input
        total = np.zeros((parts, entries, width + 2), object)
        for _, matrix, codes, errors in _searched(batches, sent.value):
            for p in range(parts):
                rows = np.column_stack([
                    matrix[:, p * width : (p + 1) * width], np.ones(len(matrix), np.int64), errors[:, p]
                ])
                order = np.argsort(codes[:, p], kind="stable")
                sorted_codes = codes[order, p]
                first = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
                # halves keep the sums of a slice within 64 bits
                low, high = rows[order] & 0xFFFFFFFF, rows[order] >> 32
                added = np.add.reduceat(high, first).astype(object) * (1 << 32) + np.add.reduceat(
                    low, first
                ).astype(object)
                total[p, sorted_codes[first]] += added
        used = np.argwhere(total[:, :, width] > 0)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used[:, 0], pa.int32()),
                    pa.array(used[:, 1], pa.int32()),
                    pa.array([[str(x) for x in total[p, e]] for p, e in used], pa.list_(pa.string())),
                ],
                names=["part", "entry", "sums"],
            )

    # parts x entries x width numbers reach the driver
    position = F.posexplode("sums").alias("position", "said")
    rows = (
        vectors.select("vector")
        .mapInArrow(sums, "part int, entry int, sums array<string>")
        .select("part", "entry", position)
        .groupBy("part", "entry", "position")
        .agg(F.sum(F.col("said").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    totals = np.zeros((parts, entries, width + 2), object)
    for r in rows:
        totals[r.part, r.entry, r.position] = int(r.total)
    moved = books.entries.copy()
    for p, e in np.argwhere(totals[:, :, width] > 0):
        moved[p, e] = [x // totals[p, e, width] for x in totals[p, e, :width]]
    means = [int(totals[p, :, width + 1].sum()) // max(int(totals[p, :, width].sum()), 1) for p in range(parts)]
    return Codebooks(moved, [max(isqrt(m), 1) for m in means])


def assign(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    digits = max(2, -(-(books.entries.shape[1] - 1).bit_length() // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, errors in _searched(batches, sent.value):
            said = [f"{k:0{digits}x}" for k in range(sent.value.entries.shape[1])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(["".join(said[k] for k in row) for row in codes.tolist()], pa.string()),
                    pa.array([min(int(e), LONGEST) for e in errors.sum(axis=1)], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return vectors.mapInArrow(run, "vec_id long, label long, code string, error long")


def label_errors(coded: DataFrame, sent_labels: int = SENT_LABELS) -> DataFrame:
    """``coded`` with the sum of ``error`` over equal labels, all null labels together."""
    keyed = coded.withColumn("_none", F.col("label").isNull()).withColumn(
        "_label", F.coalesce("label", F.lit(0).cast("long"))
    )
    scratch = Scratch(coded.sparkSession, "label-errors")
    totals = scratch.keep(
        keyed.groupBy("_none", "_label").agg(
            F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error"),
            F.count("*").alias("_n"),
        )
    )
    if totals.count() <= sent_labels:
        joined = keyed.join(F.broadcast(totals), ["_none", "_label"])
    else:
        joined = join_counted(keyed, totals, ["_none", "_label"], "_n")
    return joined.drop("_none", "_label", "_n")


def product_codes(
    embeddings: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector.

    ``embeddings``: vec_id, embedding, label; other columns are ignored.  Rows whose vector is null or
    has a null or non-finite component are left out; an empty vector has none and is kept.  Vectors
    are filled up with zeros to the longest one, rounded up to a multiple of ``parts``.  Repeated rows
    and ids are coded one by one; among equal ids the smaller vector comes first as a first entry, rows
    without an id come last.  Fewer vectors than ``entries`` give as many entries.  Errors above 64
    bits are reported as the largest 64-bit integer.  No rows give no rows.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "codes")
    vectors = scratch.keep(integer_vectors(embeddings, scale))
    longest = vectors.agg(F.max(F.size("vector"))).head()[0]
    if longest is None:
        return vectors.select(
            "vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"),
        )
    books = first_entries(vectors, parts, entries, -(-longest // parts) * parts)
    for _ in range(rounds):
        books = train_round(vectors, books)
    coded = scratch.keep(assign(vectors, books))
    return label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
