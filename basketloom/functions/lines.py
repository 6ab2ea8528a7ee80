"""Parsing one line of text: measure, unit, quantity, name, modifier, alternatives.

Everything here is a column expression.  A line's alternatives are an array of structs that goes
through a few ``transform`` steps, so a line (or a document's whole list of lines) is parsed where
it lies: no shuffle, no regrouping, and no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketloom.functions.fixed_values import (
    COUNT_UNITS,
    EQUIPMENT_OPENINGS,
    JUICE_PARTS,
    JUICED,
    NOTE_OPENING,
    NUMBER_WORDS,
    STANDARD_UNITS,
)
from basketloom.functions.quantities import (
    by_first_letter,
    canonical_unit,
    quantity_bounds,
    spellings,
)
from basketloom.functions.text import blank_to_null, let, plural, strip

_WORDS = [word for word, _ in NUMBER_WORDS]
_STANDARD = by_first_letter(spellings(STANDARD_UNITS))
_COUNT = by_first_letter(spellings(COUNT_UNITS))
_UNITS = spellings(STANDARD_UNITS + COUNT_UNITS)

# A measure is a run of words made of digits, signs, number words and units, each followed by a
# space.  The engine recurses once per repetition of a group and retries every way to cut a word,
# so the pattern leaves it one way only, without changing what matches: the run is possessive per
# word (once a word and its space fit, giving the space back already succeeds), signs and closing
# dots are taken for good, and "half" is listed once.  One word may hold up to 400 parts; words
# that could hold more are cut short beforehand, see ``_without_long_words``.
_PARTS = by_first_letter(
    ["to", *_WORDS, *(u.removesuffix(r"\.?") + r"\.?+" * u.endswith(r"\.?") for u in _UNITS if u != "half")]
)
_WORD = rf"(?:[0-9/.\-x()]++|{_PARTS}){{0,400}}"
_LONG_WORD = "[^ ]{401}"
_PART = rf"^(?:[0-9/.\-x()]|{_PARTS})$"
# no part without a blank is longer
_LONGEST_PART, _TAIL = 24, 100
_BULLET = r"^\*?-? ?"
MEASURE = rf"{_BULLET}(?:{_WORD} )++"

UNIT = f"(?:{by_first_letter(_UNITS)})"
# "(20 ounce) package", and the same without parentheses
SIZED_CONTAINER = rf"\([1-9][0-9]?(?: 1/?2)?[ -]*(?:{_STANDARD})\) (?:{_COUNT})"
SIZED_CONTAINER_BARE = rf"[1-9][0-9]?[ -]*(?:{_STANDARD}) (?:{_COUNT})"

_JUICE_WORDS = " |".join(JUICE_PARTS)
_QUANTIFIERS = "|".join([*_WORDS, "[1-9][0-9/ ]*"])
# what is juiced may follow any run of lower-case words
JUICE_OF = (
    rf"((?:{_JUICE_WORDS})++(?:of |from ))({_QUANTIFIERS} )?(?:the |a )?"
    rf"((?:[a-z ]* )?(?:{'|'.join(JUICED)}))"
)

OUTER_OR = r" or (?![^(]*\))"
_DELIMITER = ",|:|;|- | -"


def normalise_line(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("possibly "), F.lit(""))


def is_equipment(text: Column) -> Column:
    """On a normalised line."""
    first, *others = [text.startswith(opening) for opening in EQUIPMENT_OPENINGS]
    return reduce(or_, others, first)


def is_note(text: Column) -> Column:
    return text.startswith(NOTE_OPENING)


def line_class(text: Column) -> Column:
    return (
        F.when(is_equipment(text), "equipment").when(is_note(text), "note").otherwise("item")
    )


def equipment_pieces(text: Column) -> Column:
    """Pieces of an equipment line as written; NULL if the line does not open as one."""
    lowered = strip(F.lower(text))
    opening = "|".join(EQUIPMENT_OPENINGS)
    listed = (
        F.when(lowered.rlike(f"^(?:{opening}):"), F.regexp_replace(lowered, "^[^:]*:", ""))
        .when(lowered.rlike(f"^(?:{opening})"), F.regexp_replace(lowered, f"^(?:{opening})", ""))
    )
    return F.transform(F.split(listed, ";", -1), lambda piece: strip(piece))


def take_parentheses(text: Column) -> Column:
    """``struct<text, inside>``: text with all balanced parentheses removed, in order of their ends.

    One pass over the pieces between brackets.  The state is the stack of texts that are still open:
    the line itself below, a text for every "(" that has not met its ")" above.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("")).alias("open"), nothing.alias("inside"))

    def below(stack: Column, n: int) -> Column:
        return F.slice(stack, F.lit(1), F.size(stack) - n)

    def on_top(stack: Column, piece: Column) -> Column:
        return F.array_append(below(stack, 1), F.concat(F.element_at(stack, -1), piece))

    def step(state: Column, piece: Column) -> Column:
        stack, inside = state["open"], state["inside"]
        closes = (piece == ")") & (F.size(stack) > 1)
        return F.struct(
            F.when(piece == "(", F.array_append(stack, F.lit("")))
            .when(closes, below(stack, 1))
            .otherwise(on_top(stack, piece))
            .alias("open"),
            F.when(closes, F.array_append(inside, F.element_at(stack, -1))).otherwise(inside).alias("inside"),
        )

    def finish(state: Column) -> Column:
        # what was never closed stays as it stood
        return F.struct(F.array_join(state["open"], "(").alias("text"), state["inside"].alias("inside"))

    pieces = F.regexp_extract_all(text, F.lit(r"[^()]+|[()]"), F.lit(0))
    return F.when(text.contains(")"), F.aggregate(pieces, start, step, finish)).otherwise(
        F.struct(text.alias("text"), nothing.alias("inside"))
    )


def split_name(text: Column, keep_after: Sequence[str] = ()) -> Column:
    """``struct<name, modifier>`` cut at the first delimiter.

    A cut right after one of the ``keep_after`` words (describing words, say) is passed over.
    """
    held = "".join(f"(?<!\\b{word})" for word in keep_after)
    # a delimiter at the very start has no name before it
    cut = F.regexp_instr(text, F.lit(rf"(?<!^){held}(?:{_DELIMITER})"))

    def parts(at: Column) -> Column:
        name = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
        rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))
        opening = F.when(name.startswith("of "), F.substring(name, 4, 1 << 30)).otherwise(name)
        return F.struct(strip(opening).alias("name"), strip(rest).alias("modifier"))

    return let(cut, parts)


def juice_of(text: Column) -> Column:
    """``struct<matched, quantity_str, name>`` for "juice of 2 lemons"; NULL if it is not one."""

    def build(found: Column) -> Column:
        fruit = found["fruit"]
        last = F.substring_index(fruit, " ", -1)
        # already plural when it has a shorter form
        plural_last = F.when(last.rlike("[^s]s$"), last).otherwise(plural(last))
        name = F.concat(
            F.substring(fruit, F.lit(1), F.length(fruit) - F.length(last)),
            plural_last,
            F.lit(", "),
            found["part"],
        )
        return F.when(
            found["matched"] != "",
            F.struct(
                found["matched"].alias("matched"),
                found["quantity_str"].alias("quantity_str"),
                strip(name).alias("name"),
            ),
        )

    return F.when(
        text.contains("juice of"),
        let(
            F.struct(
                F.regexp_extract(text, JUICE_OF, 0).alias("matched"),
                strip(F.regexp_extract(text, JUICE_OF, 1)).alias("part"),
                blank_to_null(F.regexp_extract(text, JUICE_OF, 2)).alias("quantity_str"),
                strip(F.regexp_extract(text, JUICE_OF, 3)).alias("fruit"),
            ),
            build,
        ),
    )


def _cut_word(word: Column) -> Column:
    """A stand-in for a long word that reads as a part of a measure exactly if the word does.

    The places that whole parts can end at are followed from left to right.  What ends near the
    end of the word stays, as a part may go on after the blank; the rest becomes one digit.
    """
    n = F.length(word)

    def step(ends: Column, i: Column) -> Column:
        near = F.filter(ends, lambda j: j >= i - (_LONGEST_PART + _TAIL))
        fits = F.exists(
            near,
            lambda j: (i - j <= _LONGEST_PART) & F.substring(word, j + 1, i - j).rlike(_PART),
        )
        return F.when(fits, F.array_append(near, i)).otherwise(near)

    ends = F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), step)
    tails = lambda found: F.filter(
        found,
        lambda j: (n - j <= _TAIL) & F.substring(word, j + 1, n - j).rlike(f"^{_WORD}$"),
    )
    return let(
        let(ends, tails),
        lambda cuts: F.when(F.size(cuts) == 0, F.lit("~")).otherwise(
            F.concat(
                F.lit("1"), F.substring(word, F.element_at(cuts, 1) + 1, n - F.element_at(cuts, 1))
            )
        ),
    )


def _measure(text: Column) -> Column:
    """The run of measure words that a line opens with, blank included; empty if there is none."""

    def of_long(words: Column) -> Column:
        short = F.array_join(
            F.transform(words, lambda w: F.when(w.rlike(_LONG_WORD), _cut_word(w)).otherwise(w)), " "
        )

        def whole(head: Column) -> Column:
            # a measure ends at a blank, so it has as many whole words as blanks
            n = F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))
            opened = F.concat(F.array_join(F.slice(words, F.lit(1), n), " "), F.lit(" "))
            return F.when(head == "", F.lit("")).otherwise(opened)

        return let(F.regexp_extract(short, MEASURE, 0), whole)

    return F.when(text.rlike(_LONG_WORD), let(F.split(text, " ", -1), of_long)).otherwise(
        F.regexp_extract(text, MEASURE, 0)
    )


def measure_parts(text: Column) -> Column:
    """``struct<matched, measure, rest>``: the measure a line opens with, and what follows."""
    def parts(head: Column) -> Column:
        rest = F.substring(text, F.length(head) + 1, F.length(text))
        return F.struct(
            (head != "").alias("matched"),
            strip(F.regexp_replace(head, _BULLET, "")).alias("measure"),
            # the rest of a line ends where the line does
            F.when(head != "", strip(F.substring_index(rest, "\n", 1))).alias("rest"),
        )

    return let(_measure(text), parts)


def unit_parts(measure: Column) -> Column:
    """``struct<unit, quantity_str>`` of a measure; what is not there is NULL."""

    def sized(pattern: str, found: Column) -> Column:
        return F.struct(
            F.regexp_replace(found, "[()]", "").alias("unit"),
            F.regexp_replace(measure, pattern, "").alias("left"),
        )

    def plain(bare: Column) -> Column:
        return F.struct(
            F.regexp_extract(bare, UNIT, 0).alias("unit"),
            F.regexp_replace(bare, UNIT, "").alias("left"),
        )

    def choose(found: Column) -> Column:
        return (
            F.when(found["a"] != "", sized(SIZED_CONTAINER, found["a"]))
            .when(found["b"] != "", sized(SIZED_CONTAINER_BARE, found["b"]))
            .otherwise(let(take_parentheses(measure)["text"], plain))
        )

    chosen = let(
        F.struct(
            F.regexp_extract(measure, SIZED_CONTAINER, 0).alias("a"),
            F.regexp_extract(measure, SIZED_CONTAINER_BARE, 0).alias("b"),
        ),
        choose,
    )

    def finish(parts: Column) -> Column:
        left = F.replace(parts["left"], F.lit("whole"), F.lit(""))
        return F.struct(
            blank_to_null(parts["unit"]).alias("unit"),
            F.when(left != "", strip(left)).alias("quantity_str"),
        )

    return let(chosen, finish)


def parse_texts(texts: Column, keep_after: Sequence[str] = ()) -> Column:
    """Parse an array of texts; each step binds its results before the next one uses them."""
    cut = F.transform(
        texts,
        lambda t: F.struct(t.alias("text"), measure_parts(t).alias("m")),
    )
    split = F.transform(
        cut,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["m"]["matched"].alias("has_measure"),
            F.when(s["m"]["matched"], unit_parts(s["m"]["measure"])).alias("u"),
            F.when(s["m"]["matched"], take_parentheses(strip(s["m"]["rest"], " ,"))).alias("p"),
            F.when(~s["m"]["matched"], juice_of(s["text"])).alias("juice"),
        ),
    )
    named = F.transform(
        split,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["has_measure"].alias("has_measure"),
            s["u"].alias("u"),
            s["p"]["inside"].alias("inside"),
            s["juice"].alias("juice"),
            F.when(s["has_measure"], split_name(s["p"]["text"], keep_after)).alias("n"),
            F.when(
                s["has_measure"],
                quantity_bounds(s["u"]["quantity_str"], s["u"]["unit"]),
            ).alias("q"),
        ),
    )

    def finish(s: Column) -> Column:
        juice, fallback = s["juice"], ~s["has_measure"] & s["juice"].isNull()
        of_juice = s["n"]["modifier"].startswith("juice of")
        name = (
            F.when(juice.isNotNull(), juice["name"])
            .when(fallback, F.substring_index(s["text"], ",", 1))
            .when(of_juice, F.concat(s["n"]["name"], F.lit(", juice of")))
            .otherwise(s["n"]["name"])
        )
        modifier = (
            F.when(juice.isNotNull(), F.lit(None))
            .when(
                fallback & s["text"].contains(","),
                F.regexp_extract(s["text"], "(?s)^[^,]*,(.*)$", 1),
            )
            .when(of_juice, strip(F.substring(s["n"]["modifier"], 9, 1 << 30), " ,"))
            .otherwise(s["n"]["modifier"])
        )
        return F.struct(
            s["text"].alias("text"),
            name.alias("name"),
            F.when(s["u"]["unit"].isNotNull(), canonical_unit(s["u"]["unit"])).alias("unit"),
            F.coalesce(s["u"]["quantity_str"], juice["quantity_str"]).alias("quantity_str"),
            s["q"]["low"].alias("quantity_low"),
            s["q"]["high"].alias("quantity_high"),
            blank_to_null(modifier).alias("modifier"),
            F.when(F.size(s["inside"]) > 0, s["inside"]).alias("parenthetic"),
            juice["matched"].alias("matched"),
            # "juice of" always counts as having a quantity
            (s["u"]["quantity_str"].isNotNull() | juice.isNotNull()).alias("has_quantity"),
        )

    return F.transform(named, finish)


_PART_FIELDS = (
    "name", "unit", "quantity_str", "quantity_low", "quantity_high", "modifier", "parenthetic",
)


def parse_candidates(text: Column, keep_after: Sequence[str] = ()) -> Column:
    """The whole line first and then, if it has several, its outer "or" alternatives."""

    def candidates(options: Column) -> Column:
        return F.when(F.size(options) > 1, F.concat(F.array(text), options)).otherwise(
            F.array(text)
        )

    return parse_texts(
        let(F.filter(F.split(text, OUTER_OR, -1), lambda t: t != " or "), candidates), keep_after
    )


def choose_reading(text: Column, parsed: Column) -> Column:
    """The line's fields with ``substitutions`` when all alternatives have the same shape."""

    def same_shape(first: Column) -> Column:
        return F.forall(
            F.slice(parsed, 3, F.greatest(F.size(parsed) - 2, F.lit(0))),
            lambda other: (other["unit"].isNotNull() == first["unit"].isNotNull())
            & (other["has_quantity"] == first["has_quantity"]),
        )

    def reading(first: Column) -> Column:
        split = (F.size(parsed) > 1) & same_shape(first)
        main = F.when(split, first).otherwise(F.element_at(parsed, 1))
        others = F.when(
            split,
            F.transform(
                F.slice(parsed, 3, F.greatest(F.size(parsed) - 2, F.lit(0))),
                lambda o: F.struct(*[o[f].alias(f) for f in _PART_FIELDS]),
            ),
        )
        return let(
            F.struct(main.alias("main"), others.alias("others")),
            lambda r: F.struct(
                text.alias("text"),
                *[r["main"][f].alias(f) for f in _PART_FIELDS],
                r["main"]["matched"].alias("matched"),
                r["others"].alias("substitutions"),
            ),
        )

    return let(F.element_at(parsed, F.when(F.size(parsed) > 1, F.lit(2)).otherwise(F.lit(1))), reading)


def parse_line(text: Column, keep_after: Sequence[str] = ()) -> Column:
    """All fields of one line as a struct; the given text is kept as it is."""
    return let(
        parse_candidates(normalise_line(text), keep_after),
        lambda parsed: choose_reading(text, parsed),
    )
