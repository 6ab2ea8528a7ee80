"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the test items are the patterns and words are the symbols.  A table over blocks of
two words tells how far the search may jump: a block that ends in no pattern skips the whole
pattern length, so most positions of a clean text are never looked at.  Where the jump is 0, the
hash of the block selects the few patterns that end with it, and comparing the words confirms an
occurrence.  Patterns of different lengths are searched apart, each length with its own tables.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.llm.common import sha256_hex

WINDOW = 13
# characters of benchmark text searched for in one pass over the documents; their tables take about
# 110 bytes a character in the driver and in every worker
BLOCK_CHARS = 1_000_000
# words of a text that are held at a time
CHUNK_BYTES = 4_000_000

SPANS = "n_words long, spans array<struct<start:long,end:long>>, item_ids array<long>"

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: ASCII letters, digits and everything beyond ASCII."""
    return _WORD.findall(text.lower())


class WuManber:
    """Search tables of all patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[int]]] = defaultdict(dict)

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            jump = m - end
            if jump < self.shift.get(key, m - b + 1):
                self.shift[key] = jump
        self.buckets[pattern[m - b :]].setdefault(pattern, []).append(item)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of every occurrence, starts ascending."""
        m, b = self.length, self.block
        shift, buckets, far, n = self.shift, self.buckets, m - b + 1, len(words)
        last = m - 1
        while last < n:
            key = tuple(words[last - b + 1 : last + 1])
            jump = shift.get(key, far)
            if jump:
                last += jump
                continue
            start = last - m + 1
            items = buckets[key].get(tuple(words[start : last + 1]))
            if items is not None:
                yield start, items
            last += 1


def search_tables(items: list[tuple[int, str]], window: int) -> list[WuManber]:
    tables: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        m = min(window, len(words))
        if m == 0:
            continue
        table = tables.get(m) or tables.setdefault(m, WuManber(m))
        for pattern in {tuple(words[k : k + m]) for k in range(len(words) - m + 1)}:
            table.add(pattern, item)
    return list(tables.values())


def chunks(text: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text with the index of the first one, long texts in overlapping chunks."""
    if len(text) <= CHUNK_BYTES:
        yield 0, words_of(text)
        return
    carried: list[bytes] = []
    at = first = 0
    while at < len(text):
        cut = at + CHUNK_BYTES
        while cut < len(text) and _WORD.match(text, cut - 1, cut) and _WORD.match(text, cut):
            cut += 1
        words = carried + words_of(text[at:cut])
        yield first, words
        carried = words[len(words) - min(overlap, len(words)) :]
        first += len(words) - len(carried)
        at = cut


def _search(tables: list[WuManber], text: bytes) -> tuple[int, list[dict], list[int]]:
    """Number of words, merged hit spans in words, and the items found."""
    overlap = max((t.length for t in tables), default=1) - 1
    found: set[int] = set()
    hits: list[tuple[int, int]] = []
    n_words = 0
    for first, words in chunks(text, overlap):
        n_words = first + len(words)
        for t in tables:
            for start, items in t.occurrences(words):
                hits.append((first + start, first + start + t.length))
                found.update(i for i in items if i is not None)
    spans: list[dict] = []
    for start, end in sorted(hits):
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], end)
        else:
            spans.append({"start": start, "end": end})
    return n_words, spans, sorted(found)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about ``block_chars`` characters."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = benchmark.where(key == k).select("item_id", "text").distinct().collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def _merged(spans: Column) -> Column:
    """Union of spans that may overlap, ascending."""
    nothing = F.array().cast("array<struct<start:long,end:long>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        return F.when(
            touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(spans), nothing, add)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Occurrences of benchmark windows in documents; all columns of ``documents`` plus
    ``n_words``, ``spans`` (hit words, ascending, disjoint) and ``item_ids``.

    ``benchmark`` (item_id, text) is searched for in blocks, one pass over the documents each, so
    that a task holds the tables of one block only.  Null texts have no words; items without words
    have no window; items that share an id count once; an item without id hits words, but is not
    listed.  No items give no spans.  Repeated documents are answered row by row.  Columns of
    ``documents`` with the names of the new ones are replaced.
    """
    new = ("n_words", "spans", "item_ids")
    rows = documents.drop(*new)
    blocks = _blocks(benchmark, block_chars)
    out = _scan(rows, search_tables(next(blocks), window))
    for items in blocks:
        out = _scan(
            out.withColumnsRenamed({"spans": "_spans", "item_ids": "_items"}).drop("n_words"),
            search_tables(items, window),
        )
        out = out.withColumns(
            {
                "spans": _merged(F.concat("_spans", "spans")),
                "item_ids": F.array_sort(F.array_union("_items", "item_ids")),
            }
        ).drop("_spans", "_items")
    return out.select(*rows.columns, *new)


def _scan(documents: DataFrame, tables: list[WuManber]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                _search(tables, (text or "").encode()) for text in batch.column("text").to_pylist()
            ]
            n, spans, items = zip(*found, strict=True) if found else ([], [], [])
            kinds = (pa.int64(), span, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (n, spans, items), kinds)],
                names=[*batch.schema.names, "n_words", "spans", "item_ids"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(run, f"{schema}, {SPANS}")


def verdict(found: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``n_items`` and ``contaminated``: at least a twentieth of the words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("item_ids").cast("long"),
            "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words")),
        }
    )


def decontamination_report(spark: SparkSession, documents: DataFrame, benchmark: DataFrame):
    """One row per document with counts and the digest of the items found."""
    rows = verdict(find_contamination(documents.select("doc_id", "text"), benchmark))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        sha256_hex(F.array_join(ids, ",")).alias("items_sha256"),
        "contaminated",
    )
