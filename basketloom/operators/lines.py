"""Parsing tables of lines and nested documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.lines import (
    choose_reading,
    equipment_pieces,
    is_equipment,
    line_class,
    normalise_line,
    parse_candidates,
    parse_line,
)
from basketloom.functions.text import once
from basketloom.runtime import Scratch, spread


def read_distinct(
    lines: DataFrame, text: str, reading: Callable[[Column], Column], wanted: Column | None = None
) -> DataFrame:
    """Add ``_line``, the struct ``reading`` of column ``text``; NULL where a line is not ``wanted``.

    Reading costs far more than moving a line, and lines repeat, so each distinct text is read
    once.  Texts meet by their hash, which sorts faster than they do; a text that very many lines
    share only makes one side long, which the adaptive skew join splits.
    """
    texts = lines if wanted is None else lines.where(wanted)
    texts = texts.select(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).distinct()
    read = texts.select("_hash", "_text", once(reading(F.col("_text"))))
    fields = [c for c in read.columns if c not in ("_hash", "_text")]
    read = read.select(F.col("_hash").alias("_h"), "_text", F.struct(*fields).alias("_line"))
    key = F.xxhash64(text)
    if wanted is not None:
        # lines that look nothing up are spread over the tasks
        key = F.when(wanted, key).otherwise(F.xxhash64(*[c for c in lines.columns if c != text]))
    same = (F.col("_hash") == F.col("_h")) & F.col(text).eqNullSafe(F.col("_text"))
    found = lines.withColumn("_hash", key).join(read, same, "left").drop("_hash", "_h", "_text")
    return found if wanted is None else found.withColumn("_line", F.when(wanted, F.col("_line")))


def parse_lines(lines: DataFrame, text: str = "text", keep_after: Sequence[str] = ()) -> DataFrame:
    """Add the parsed fields of column ``text``; one row in, one row out, each distinct text parsed once.

    Input of a few small splits is spread over the cores first.
    """
    others = [c for c in lines.columns if c != text]
    read = read_distinct(spread(lines), text, lambda t: parse_line(t, keep_after))
    return read.select(*others, "_line.*")


def classify_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.withColumn("line_class", line_class(normalise_line(F.col(text))))


def equipment_rows(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row per piece of equipment, in place of the line that lists it."""
    listed = lines.where(is_equipment(normalise_line(F.col(text))))
    return listed.withColumn("equipment", F.explode(equipment_pieces(F.col(text)))).drop(text)


def _routed(documents: DataFrame) -> DataFrame:
    """Documents with ``parse_ok``, ``_equipment`` (pieces) and ``_items`` (the other lines)."""
    lines = F.col("ingredients")
    equipment = F.filter(lines, lambda line: is_equipment(normalise_line(line["text"])))
    items = F.filter(lines, lambda line: ~is_equipment(normalise_line(line["text"])))
    parse_ok = (
        lines.isNotNull()
        & F.forall(lines, lambda line: line["text"].isNotNull())
        & F.forall(equipment, lambda line: equipment_pieces(line["text"]).isNotNull())
    )
    return spread(documents).select(
        *documents.columns,
        once(
            F.struct(
                F.coalesce(parse_ok, F.lit(False)).alias("parse_ok"),
                F.flatten(
                    F.transform(equipment, lambda line: equipment_pieces(line["text"]))
                ).alias("_equipment"),
                items.alias("_items"),
            )
        ),
    )


def _listed_equipment() -> Column:
    return F.when(
        F.col("parse_ok") & (F.size("_equipment") > 0),
        F.transform("_equipment", lambda piece: F.struct(piece.alias("text"))),
    )


def route_documents(documents: DataFrame) -> DataFrame:
    """What ``parse_documents`` does apart from parsing the item lines, which stay as they are."""
    return (
        _routed(documents)
        .withColumns(
            {
                "ingredients": F.when(F.col("parse_ok"), F.col("_items")).otherwise(F.col("ingredients")),
                "equipment": _listed_equipment(),
            }
        )
        .drop("_equipment", "_items")
    )


def _parsed_lines(documents: DataFrame, keep_after: Sequence[str], columns: Sequence[str]) -> DataFrame:
    routed = _routed(documents)
    kept = F.when(F.col("parse_ok"), F.col("_items")).otherwise(F.col("ingredients"))
    lines = routed.select(*columns, "parse_ok", F.posexplode(kept).alias("pos", "_given"))
    # stored, as they are read for their texts first and for their readings then
    lines = Scratch(documents.sparkSession, "document-lines").keep(
        lines.select(*columns, "parse_ok", "pos", F.col("_given.text").alias("text"))
    )
    # the stored file is far smaller than its rows, so the planner would broadcast readings too soon
    found = read_distinct(
        lines.hint("merge"), "text", lambda t: parse_line(t, keep_after), F.col("parse_ok")
    )
    fields = [f for f in found.schema["_line"].dataType.names if f != "text"]
    line = F.struct("text", *[F.col("_line")[f].alias(f) for f in fields])
    return found.select(*columns, "parse_ok", "pos", line.alias("line"))


def parse_documents(
    documents: DataFrame, keep_after: Sequence[str] = (), by_line: Sequence[str] = ()
) -> DataFrame:
    """Parse every line of every document where it lies: a map-only job.

    Input of a few small splits is spread over the cores first.  With ``by_line``, columns of the
    documents, the result has these, ``parse_ok``, ``pos`` and ``line`` for each line that would be in
    ``ingredients``, and each distinct text is parsed once, which is faster wherever lines repeat.

    Item lines gain their parsed fields, equipment lines leave ``ingredients`` for ``equipment``,
    and ``parse_ok`` is false for documents whose lines cannot be told apart (no lines, a line
    without text, or an equipment line that does not open as one).  Rejected documents keep their
    lines unparsed.  Where the fields of lines are not needed, ``route_documents`` is far cheaper.
    """
    if by_line:
        return _parsed_lines(documents, keep_after, by_line)
    lines = F.col("ingredients")
    routed = _routed(documents)
    candidates = F.transform(
        F.when(F.col("parse_ok"), F.col("_items")).otherwise(lines),
        lambda line: F.struct(
            line["text"].alias("text"),
            parse_candidates(normalise_line(line["text"]), keep_after).alias("candidates"),
        ),
    )
    parsed = routed.select(
        *routed.columns,
        once(
            F.struct(
                F.transform(
                    candidates, lambda line: choose_reading(line["text"], line["candidates"])
                ).alias("_parsed")
            )
        ),
    )
    unparsed = F.transform(
        "_parsed",
        lambda line: line.withField("name", F.lit(None).cast("string"))
        .withField("unit", F.lit(None).cast("string"))
        .withField("quantity_str", F.lit(None).cast("string"))
        .withField("quantity_low", F.lit(None).cast("double"))
        .withField("quantity_high", F.lit(None).cast("double"))
        .withField("modifier", F.lit(None).cast("string"))
        .withField("parenthetic", F.lit(None).cast("array<string>"))
        .withField("matched", F.lit(None).cast("string"))
        .withField("substitutions", F.slice(line["substitutions"], 1, 0)),
    )
    return parsed.withColumns(
        {
            "ingredients": F.when(F.col("parse_ok"), F.col("_parsed")).otherwise(unparsed),
            "equipment": _listed_equipment(),
        }
    ).drop("_equipment", "_items", "_parsed")


def rejected_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("parse_ok"))
