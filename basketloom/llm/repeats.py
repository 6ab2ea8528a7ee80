"""Removal of long repeated byte strings with a run-length index.

Every window of ``LENGTH`` bytes is owned by its anchor, the least of the hashed ``GRAM``-byte
strings in it, so that equal windows have equal anchors.  Consecutive windows with one anchor form
a piece of text.  Anchors that occur once own no repeated window and go first.  Equal pieces are
aggregated to the one that starts first, all others are covered whole.  The different pieces of an
anchor are gathered into bounded shards; each shard builds a run-length index of its pieces,
streams their matching statistics and reports the windows that also start earlier.

An anchor with too many different pieces for a shard is split: half of its windows by how far
before the anchor they start.  The windows of a half share more bytes than the anchor, those bytes
become the new key, and so on down to single windows, where equal keys are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketloom.llm.common import release, text_buffers, without_nulls
from basketloom.llm.run_length_index import repeated_windows
from basketloom.llm.shingles import _scrambled, mixed
from basketloom.runtime import Scratch

LENGTH, GRAM = 100, 24
# different pieces of an anchor that go to one shard; more are split
GROUP_PIECES = 1000
# bytes of pieces that one index holds; three ranks of so many suffixes fit into 63 bits
SHARD_BYTES = 1_500_000
SLICE_BYTES = 2_000_000

ANCHORS = "core long, piece long, doc_id long, variant long, place long"
CUT = (
    "core long, low int, high int, text binary, doc_id long, variant long, start long, before int"
)
MARKS = "doc_id long, variant long, start long, stop long"
KEPT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"

_STEPS = _scrambled(2, 21)
_TABLES = [_scrambled(256, 22), _scrambled(256, 23)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int, n: int) -> np.ndarray:
    """Powers of the inverse of step k, at least n of them."""
    if len(_POWERS.get(k, ())) < n:
        inverse = np.uint64(pow(int(_STEPS[k]), -1, 2**64))
        _POWERS[k] = np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)))
    return _POWERS[k]


def _prefix_sums(k: int, raw: np.ndarray) -> np.ndarray:
    """Sums of table values times powers of a step, mod 2 ** 64."""
    n = len(raw)
    powers = np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), _STEPS[k])))[:n]
    return np.append(np.uint64(0), np.cumsum(_TABLES[k][raw] * powers))


def _range_hash(k: int, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    inverse = _powers(k, len(sums))
    return mixed((sums[stop] - sums[start]) * inverse[start])


def anchored_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows inside texts with one anchor: first window, windows, anchor, both hashes."""
    n = len(raw)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    span = length - gram + 1
    with np.errstate(over="ignore"):
        sums = _prefix_sums(0, raw)
        hashes = mixed((sums[gram:] - sums[:-gram]) * _powers(0, len(sums))[: n - gram + 1])
        # the position breaks ties from the left
        key = hashes & ~np.uint64(0xFFFFFFFF)
        key |= np.arange(len(key), dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        window = np.arange(len(anchor))
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
        window = np.flatnonzero(window + length <= ends)
        anchor = anchor[window]
        if not len(window):
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))
        first = window[new]
        count = np.diff(np.append(np.flatnonzero(new), len(window)))
        at = anchor[new]
        core = hashes[at]
        pieces = _range_hash(1, _prefix_sums(1, raw), first, first + count - 1 + length)
        pieces = mixed(pieces + (at - first).astype(np.uint64) * np.uint64(256) + count.astype(np.uint64))
    return first, count, at, core, pieces


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE_BYTES`` bytes, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, raw = text_buffers(without_nulls(batch.column("text")))
        for a, b in _slices(offsets):
            mine = offsets[a : b + 1] - offsets[a]
            first, count, at, core, piece = anchored_runs(
                raw[offsets[a] : offsets[b]], mine, LENGTH, GRAM
            )
            text = np.searchsorted(mine, first, side="right") - 1
            place = ((first - mine[text]) << 16) | (count << 8) | (at - first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(core.view(np.int64)),
                    pa.array(piece.view(np.int64)),
                    batch.column("doc_id").take(pa.array(text + a)),
                    batch.column("variant").take(pa.array(text + a)),
                    pa.array(place.astype(np.int64)),
                ],
                names=["core", "piece", "doc_id", "variant", "place"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of wanted pieces: rows of a document with its list of (core, place)."""
    for batch in batches:
        rows: list[tuple] = []
        columns = ("doc_id", "variant", "text", "wanted")
        for doc_id, variant, text, wanted in zip(*(batch.column(c).to_pylist() for c in columns)):
            raw = text.encode()
            for w in wanted:
                start, count, before = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                piece = raw[start : start + count - 1 + LENGTH]
                rows.append((w["core"], 0, LENGTH - GRAM, piece, doc_id, variant, start, before))
        yield _cut_batch(rows)


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (
        pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
    )
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
        names=[c.split()[0] for c in CUT.split(", ")],
    )


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both halves of pieces: windows that start at most so far before the anchor, and the rest."""
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        for core, low, high, text, doc_id, variant, start, before in zip(
            *(column.to_pylist() for column in batch.columns)
        ):
            least = before - (len(text) - LENGTH)
            middle = (low + high) // 2
            for lo, hi in ((low, middle), (middle + 1, high)):
                mine_lo, mine_hi = max(lo, least), min(hi, before)
                if lo > hi or mine_lo > mine_hi:
                    continue
                # bytes that all windows of the half have, counted from the piece's first byte
                common = text[before - lo : before - hi + LENGTH]
                key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (core, lo, hi) + common)
                piece = text[before - mine_hi : before - mine_lo + LENGTH]
                rows.append(
                    (key - (1 << 63), lo, hi, piece, doc_id, variant, start + before - mine_hi, mine_hi)
                )
        yield _cut_batch(rows)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of one shard's pieces that start earlier elsewhere, index by index."""
    waiting: list[dict] = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            # an anchor's pieces stay in one index; the rows come sorted by anchor
            if size > SHARD_BYTES and (row["core"], row["low"]) != last:
                yield _marks_of(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row["text"])
            last = (row["core"], row["low"])
    if waiting:
        yield _marks_of(waiting)


def _marks_of(rows: list[dict]) -> pa.RecordBatch:
    # missing ids come first, as in Spark's order
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0, r["variant"]) for r in rows]
    rank = {key: k for k, key in enumerate(sorted(set(ids)))}
    order = np.asarray([rank[key] << 40 | r["start"] for key, r in zip(ids, rows, strict=True)])
    found = repeated_windows([r["text"] for r in rows], order, LENGTH)
    out: list[tuple] = []
    for row, windows in zip(rows, found, strict=True):
        if not len(windows):
            continue
        cuts = np.flatnonzero(np.append(True, np.diff(windows) > 1))
        for a, b in zip(cuts, np.append(cuts[1:], len(windows)), strict=True):
            start = row["start"] + int(windows[a])
            stop = row["start"] + int(windows[b - 1]) + LENGTH
            out.append((row["doc_id"], row["variant"], start, stop))
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.int64()) for c in columns],
        names=["doc_id", "variant", "start", "stop"],
    )


def _first(*more: str) -> Column:
    return F.min(F.struct("doc_id", "variant", *more)).alias("first")


def repeated_spans(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Byte ranges (doc_id, variant, start, stop) covered by strings that also start earlier."""
    spark = documents.sparkSession
    anchors = documents.mapInArrow(_anchors, ANCHORS)
    often = scratch.keep(
        anchors.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    )
    release(spark)
    shared = scratch.keep(anchors.join(often, "core"))
    release(spark)
    firsts = scratch.keep(
        shared.groupBy("core", "piece").agg(_first("place"), F.count("*").alias("n"))
    )
    start = F.shiftright("place", 16)
    stop = start + (F.shiftright("place", 8).bitwiseAND(F.lit(255))) - 1 + LENGTH
    marks = [
        scratch.keep(
            shared.join(
                firsts.where("n > 1").select("core", "piece", F.col("first").alias("f")),
                ["core", "piece"],
            )
            .where(~F.struct("doc_id", "variant", "place").eqNullSafe(F.col("f")))
            .select("doc_id", "variant", start.alias("start"), stop.alias("stop"))
        )
    ]
    scratch.drop(shared, often)
    release(spark)
    several = firsts.groupBy("core").agg(F.count("*").alias("pieces")).where("pieces > 1")
    wanted = (
        firsts.join(several, "core")
        .select("first.*", "core")
        .groupBy("doc_id", "variant")
        .agg(F.collect_list(F.struct("core", "place")).alias("wanted"))
        .withColumnsRenamed({"doc_id": "_id", "variant": "_variant"})
    )
    cut = scratch.keep(
        documents.join(
            wanted,
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("variant") == F.col("_variant")),
        )
        .select("doc_id", "variant", "text", "wanted")
        .mapInArrow(_cut, CUT)
    )
    release(spark)
    group = ["core", "low"]
    for level in range(LENGTH):
        sizes = scratch.keep(cut.groupBy(*group).agg(F.count("*").alias("pieces")))
        ready = cut.join(
            sizes.where((F.col("pieces") > 1) & (F.col("pieces") <= GROUP_PIECES)), group
        ).drop("pieces")
        marks.append(
            scratch.keep(
                ready.repartition("core").sortWithinPartitions(*group).mapInArrow(_indexed, MARKS)
            )
        )
        release(spark)
        crowded = sizes.where(F.col("pieces") > GROUP_PIECES)
        if crowded.isEmpty():
            break
        halves = scratch.keep(
            cut.join(crowded, group).drop("pieces").mapInArrow(_halves, CUT)
        )
        place = ["start", "before"]
        kept = scratch.keep(
            halves.groupBy("core", "low", "high", "text").agg(_first(*place), F.count("*").alias("n"))
        )
        marks.append(
            scratch.keep(
                halves.join(
                    kept.where("n > 1").select("core", "low", "text", F.col("first").alias("f")),
                    ["core", "low", "text"],
                )
                .where(~F.struct("doc_id", "variant", *place).eqNullSafe(F.col("f")))
                .select("doc_id", "variant", "start", (F.col("start") + F.length("text")).alias("stop"))
            )
        )
        cut = kept.select("core", "low", "high", "text", "first.*").select(
            *[c.split()[0] for c in CUT.split(", ")]
        )
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text, spans, again in zip(
            *(batch.column(c).to_pylist() for c in ("text", "marks", "again")), strict=True
        ):
            raw = (text or "").encode()
            # a row that repeats an earlier one whole
            spans = [(0, len(raw))] if again and len(raw) >= LENGTH else sorted(
                (s["start"], s["stop"]) for s in spans or ()
            )
            merged: list[list[int]] = []
            for start, stop in spans:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            digest, at = hashlib.sha256(), 0
            for start, stop in merged:
                digest.update(raw[at:start])
                at = stop
            digest.update(raw[at:])
            rows.append(
                (
                    len(raw),
                    sum(b - a for a, b in merged),
                    len(merged),
                    digest.hexdigest(),
                    [{"start": a, "stop": b} for a, b in merged],
                )
            )
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` of every document.

    ``documents``: doc_id, text; other columns are ignored.  A byte goes if a string of ``LENGTH``
    bytes that covers it also starts earlier: in a document with a smaller id, or further left in
    the same one.  Matches never cross documents.  A null or empty text has no bytes.  Rows without
    an id come first.  Rows that share an id are ordered by a hash of their text; a row that
    repeats another one, id and text, is a later copy.  No rows give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    unique = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("variant", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    lists = scratch.keep(
        repeated_spans(rows, scratch)
        .groupBy("doc_id", "variant")
        .agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
        .withColumnsRenamed({"doc_id": "_id", "variant": "_variant"})
    )
    release(spark)
    joined = rows.join(
        lists,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("variant") == F.col("_variant")),
        "left",
    ).select("doc_id", "variant", "text", "marks")
    if unique:
        joined = joined.withColumn("again", F.lit(False))
    else:
        copies = Window.partitionBy("doc_id", "variant").orderBy("variant")
        joined = joined.withColumn("again", F.row_number().over(copies) > 1)
    return joined.select("doc_id", "text", "marks", "again").mapInArrow(
        _remove, "doc_id long, " + KEPT
    )
