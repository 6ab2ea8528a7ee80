"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text </turn>\\n``.  Inside texts and roles the strings that could be
taken for a mark are escaped with a backslash, and so is the backslash, so that every text can be
read back as it was.  A batch of turns is laid out as a whole: the lengths of the five segments of
each turn give cumulative offsets, the offsets give scatter indices, and every segment column is
copied at once into one preallocated buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import ranges, text_buffers, without_nulls

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LEARNED_ROLE = "assistant"

FORMATTED = (
    "conv_id long, turn long, role string, formatted string, loss_start long, loss_length long"
)
READ_BACK = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
    " formatted_chars long"
)

_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*) </turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    """Escape the backslash and the two marks; at most two ``#`` in a row stay bare."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring(texts, "###", "\\#\\#\\#")
    return pc.replace_substring(texts, "</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(segments: list[pa.Array | bytes], rows: int) -> pa.Array:
    """Join the segments of every row; a segment is a string column or the same bytes in each row."""
    sources = []
    lengths = np.empty((rows, len(segments)), np.int64)
    for k, segment in enumerate(segments):
        if isinstance(segment, bytes):
            sources.append((None, np.frombuffer(segment, np.uint8)))
            lengths[:, k] = len(segment)
        else:
            at, raw = text_buffers(segment)
            sources.append((at, raw))
            lengths[:, k] = np.diff(at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if rows else 0, np.uint8)
    for k, (at, raw) in enumerate(sources):
        target = ranges(starts[:, k], lengths[:, k])
        out[target] = np.tile(raw, rows) if at is None else raw
    offsets = np.concatenate([[0], ends[len(segments) - 1 :: len(segments)]]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)]
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_role = without_nulls(batch.column("role"))
        role = pc.replace_substring(escape(raw_role), ":", "\\:")
        text = escape(without_nulls(batch.column("text")))
        formatted = assemble(
            [OPEN.encode(), role, COLON.encode(), text, CLOSE.encode()], batch.num_rows
        )
        learned = pc.equal(raw_role, LEARNED_ROLE)
        start = pc.add(pc.utf8_length(role), len(OPEN) + len(COLON))
        length = pc.if_else(learned, pc.utf8_length(text), 0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                batch.column("role"),
                formatted.cast(pa.string()),
                start.cast(pa.int64()),
                length.cast(pa.int64()),
            ],
            names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_length"],
        )


def format_chat(conversations: DataFrame) -> DataFrame:
    """Formatted turns with their loss mask, conversation by conversation, in order.

    ``conversations``: conv_id, turn, role, text; other columns are ignored.  The text of a
    conversation is its rows' ``formatted`` one after the other, so that a conversation of any
    length is never held whole.  ``loss_start`` and ``loss_length`` (code points of ``formatted``)
    mask the escaped text of assistant turns.

    Null or empty texts give an empty turn, a null role an empty role.  Null ids are a conversation
    of their own, a null turn comes first, rows of the same turn are ordered by role and text, and
    repeated rows stay.  No rows give no rows.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_format, FORMATTED)
    )


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, length: int) -> None:
        role, text = map(unescape, _SEGMENT.fullmatch(formatted).groups())
        self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start : start + length])
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.n_turns += 1
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (
            self.conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
        )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ_BACK.split(",")]
    reader: _Reader | None = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    for batch in batches:
        done = []
        columns = ("conv_id", "formatted", "loss_start", "loss_length")
        for conv_id, *segment in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if reader is None or reader.conv_id != conv_id:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(conv_id)
            reader.add(*segment)
        yield packed(done)
    if reader is not None:
        yield packed([reader.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted turns of ``format_chat`` say, one row per conversation.

    Relies on the order in which ``format_chat`` returns its rows; only running digests are held.
    """
    return formatted.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(
        _read, READ_BACK
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations plus one whose texts look like the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    kept = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return kept.unionByName(probe)
