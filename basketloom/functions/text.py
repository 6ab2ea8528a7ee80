"""Small text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketloom.functions.fixed_values import WHITE_SPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """Generator column that computes ``value`` a single time per row.

    A plain projection may be inlined into every later filter and column that uses it; a generator
    is not, which matters for expensive values.  Structs come out as their fields.
    """
    return F.inline(F.array(value))


def literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant string map, folded by the optimizer."""
    text = "\x1e".join(f"{key}\x1f{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def strip(col: Column, chars: str = WHITE_SPACE) -> Column:
    return F.btrim(col, F.lit(chars))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def tokens(col: Column) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(col, " ", -1)


def one_space(col: Column) -> Column:
    """Collapse each pair of spaces once, left to right."""
    return F.replace(col, F.lit("  "), F.lit(" "))


# Nouns whose plural the suffix rules below would get wrong (singular, plural).
IRREGULAR_NOUNS = (
    ("leaf", "leaves"), ("loaf", "loaves"), ("half", "halves"), ("knife", "knives"),
    ("calf", "calves"), ("shelf", "shelves"), ("wife", "wives"), ("life", "lives"),
    ("goose", "geese"), ("foot", "feet"), ("tooth", "teeth"), ("mouse", "mice"),
    ("child", "children"), ("man", "men"), ("woman", "women"), ("person", "people"),
    ("cookie", "cookies"), ("brownie", "brownies"), ("smoothie", "smoothies"), ("pie", "pies"),
    ("shoe", "shoes"), ("toe", "toes"), ("canoe", "canoes"),
    ("sheep", "sheep"), ("fish", "fish"), ("rice", "rice"), ("news", "news"),
)


def _last_word(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _replace_last_word(name: Column, word: Column) -> Column:
    return F.concat(
        F.substring(name, F.lit(1), F.length(name) - F.length(_last_word(name))), word
    )


def _irregular(word: Column, given: int, wanted: int) -> Column:
    """NULL unless ``word`` is listed; the first listed pair wins."""
    pairs: dict[str, str] = {}
    for pair in IRREGULAR_NOUNS:
        pairs.setdefault(pair[given], pair[wanted])
    return F.try_element_at(literal_map(pairs), word)


def singular(name: Column) -> Column:
    """Singular of the last word of a phrase, by irregular list and then suffix rules."""
    rules = (
        F.when(name.rlike("[^ ]{2}ies$"), F.regexp_replace(name, "ies$", "y"))
        .when(name.rlike("(?:ch|sh|ss|x|zz|[^aeiou ]o)es$"), F.regexp_replace(name, "es$", ""))
        .when(name.rlike("[^s]s$") & ~name.rlike("(?:us|is)$"), F.regexp_replace(name, "s$", ""))
        .otherwise(name)
    )
    known = _irregular(_last_word(name), 1, 0)
    return F.when(known.isNotNull(), _replace_last_word(name, known)).otherwise(rules)


def plural(name: Column) -> Column:
    """Plural of the last word of a phrase, by irregular list and then suffix rules."""
    rules = (
        F.when(name.rlike("[^aeiou ]y$"), F.regexp_replace(name, "y$", "ies"))
        .when(name.rlike("(?:ch|sh|s|x|z|[^aeiou ]o)$"), F.concat(name, F.lit("es")))
        .otherwise(F.concat(name, F.lit("s")))
    )
    known = _irregular(_last_word(name), 0, 1)
    return (
        F.when(name == "", name)
        .when(known.isNotNull(), _replace_last_word(name, known))
        .otherwise(rules)
    )
