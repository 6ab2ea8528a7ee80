"""Quantities and units written in text, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketloom.functions.fixed_values import (
    COUNT_UNITS,
    LOST_SLASH,
    NUMBER_WORDS,
    STANDARD_UNITS,
)
from basketloom.functions.text import let, literal_map, one_space, strip, tokens


def spellings(units) -> list[str]:
    return [form for _, forms in units for form in forms]


def by_first_letter(patterns: Iterable[str]) -> str:
    """The alternation of ``patterns``, grouped by first character.

    Only patterns with the same first character compete for a position, and they keep their
    order, so the grouped form matches exactly what the flat one does with far fewer attempts.
    """
    groups: dict[str, list[str]] = {}
    for pattern in patterns:
        group, optional = re.match(r"(?:\(\?:([^)]*)\)(\??))?", pattern).groups()
        rest = pattern[re.match(r"(?:\(\?:[^)]*\)\??)?", pattern).end():]
        starts = [] if group is None else [g + rest for g in group.split("|")]
        for form in starts + ([rest] if group is None or optional else []):
            groups.setdefault(form[0], []).append(form[1:])
    return "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in groups.items())


def written_forms(pattern: str) -> list[str]:
    """Every text that a spelling such as ``batch(?:es)?`` or ``lbs?\\.?`` stands for."""
    forms = [""]
    for group, char, optional in re.findall(r"(?:\(\?:([^)]*)\)|\\?(.))(\??)", pattern):
        with_piece = [form + (group or char) for form in forms]
        forms = with_piece + forms if optional else with_piece
    return forms


def _form_map(entries: Iterable[tuple[str, Iterable[str]]]) -> dict[str, str]:
    forms: dict[str, str] = {}
    for name, patterns in entries:
        for pattern in patterns:
            for form in written_forms(pattern):
                forms.setdefault(form, name)  # the unit listed first keeps a shared form
    return forms


STANDARD_FORMS = _form_map(STANDARD_UNITS)
COUNT_FORMS = _form_map(COUNT_UNITS)
UNIT_FORMS = {**COUNT_FORMS, **STANDARD_FORMS}
WORD_FORMS = _form_map((str(value), [word]) for word, value in NUMBER_WORDS)


def is_plural_unit(unit: Column) -> Column:
    return unit.endswith("s") | (unit == "g")


def canonical_unit(unit: Column) -> Column:
    """Canonical name of a unit as written; compounds such as ``20 ounce can`` keep their size.

    A unit that is not known stays as it is.
    """

    def compound(parts: Column) -> Column:
        standard = F.try_element_at(literal_map(STANDARD_FORMS), F.try_element_at(parts, F.lit(-2)))
        container = F.try_element_at(literal_map(COUNT_FORMS), F.try_element_at(parts, F.lit(-1)))
        size = F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0)))
        # concat is NULL when either part is unknown
        return F.when(
            F.size(parts).isin(3, 4),
            F.concat(F.array_join(size, " "), F.lit(" "), standard, F.lit(" "), container),
        )

    spaced = tokens(one_space(F.replace(unit, F.lit("-"), F.lit(" "))))
    return F.coalesce(let(spaced, compound), F.try_element_at(literal_map(UNIT_FORMS), unit), unit)


def lost_slash(value: Column) -> Column:
    """Fraction meant by a number that lost its slash (12 for 1/2); NULL if there is none."""
    fractions = {str(float(number)): str(fraction) for number, fraction in LOST_SLASH}
    return F.try_element_at(literal_map(fractions), value.cast("string")).cast("double")


def simple_number(token: Column) -> Column:
    """Value of one token as ``struct<value, whole>``; the value is NULL if it is no number."""
    # a number word counts when the token starts with it
    word = F.regexp_extract(token, "^(?:" + "|".join(word for word, _ in NUMBER_WORDS) + ")", 0)
    word_value = F.try_element_at(literal_map(WORD_FORMS), word).cast("double")
    fraction = F.try_divide(
        F.substring_index(token, "/", 1).cast("double"),
        F.substring_index(token, "/", -1).cast("double"),
    )

    def number(value: Column, whole: Column) -> Column:
        return F.struct(value.alias("value"), whole.alias("whole"))

    return (
        F.when(token.rlike("^[0-9]+$"), number(token.cast("double"), F.lit(True)))
        .when(
            token.contains("/"),
            number(F.when(token.rlike("^[0-9]+/[0-9]+$"), fraction), F.lit(False)),
        )
        .when(
            token.contains("."),
            number(
                F.when(token.rlike(r"^(?:[0-9]+\.[0-9]*|\.[0-9]+)$"), token.cast("double")),
                F.lit(False),
            ),
        )
        .otherwise(let(word_value, lambda v: number(v, v >= 1)))
    )


def single_quantity(text: Column, unit: Column) -> Column:
    """``3``, ``1/2``, ``2 1/2``, ``2 12`` ... as a double; NULL if it makes no sense."""
    no_plural = unit.isNull() | (unit == "") | ~is_plural_unit(unit)

    def by_size(parts: Column) -> Column:
        first, last = F.element_at(parts, 1), F.element_at(parts, -1)["value"]
        repaired = F.coalesce(lost_slash(last), last)
        return F.when(
            F.size(parts) == 1, F.when(no_plural, repaired).otherwise(last)
        ).when(
            (F.size(parts) == 2) & first["whole"] & (repaired < 1), first["value"] + repaired
        )

    return let(F.transform(tokens(text), simple_number), by_size)


def quantity_bounds(text: Column, unit: Column) -> Column:
    """``struct<low, high>`` of a quantity; both ends are equal unless it is a range.

    A range is cut at ``-`` when that gives two sides and at `` to `` otherwise; if either side
    is no quantity, neither end is.
    """

    def bounds(ends: Column) -> Column:
        known = F.forall(ends, lambda end: end.isNotNull())
        return F.struct(
            F.when(known, F.element_at(ends, 1)).alias("low"),
            F.when(known, F.element_at(ends, -1)).alias("high"),
        )

    dashes = F.split(text, "-", -1)
    is_range = text.contains("-") | text.contains(" to ")
    range_sides = let(
        F.when(F.size(dashes) == 2, dashes).otherwise(F.split(text, " to ", -1)),
        lambda sides: F.when(F.size(sides) == 2, F.transform(sides, lambda side: strip(side))),
    )
    sides = F.when(is_range, range_sides).otherwise(F.array(text))
    return let(F.transform(sides, lambda side: single_quantity(side, unit)), bounds)
