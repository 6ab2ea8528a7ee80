"""Porter's suffix-stripping stemmer (Program 14(3), 1980) as a chain of column expressions.

A word is [C](VC)^m[V] with runs C of consonants and V of vowels, so the tests on the measure m are
regular expressions.  "y" is a vowel after a consonant; one that opens the word is written "Y" on the
way, which no vowel pattern matches.  The same patterns build the chain in SQL (``stem_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketloom.functions.text import let, literal_map

# The published rule tables, (suffix, replacement); the longest suffix that fits counts.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"), ("logi", "log"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
_STEP4 = tuple(
    (suffix, "")
    for suffix in (
        "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
        "ou", "ism", "ate", "iti", "ous", "ive", "ize",
    )
)



_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
SOME = f"^(?:{_C})?{_V}[^aeiou]"  # m > 0
ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"  # m = 1
MANY = f"^(?:{_C})?{_V}{_C}{_V}[^aeiou]"  # m > 1
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # m = 1, consonant-vowel-consonant at the end
# a double consonant other than l, s, z; the second of two "y" is one if the first is a vowel
DOUBLED = "(?:" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + f")$|^(?:{_C})?(?:{_V}{_C})*yy$"
RESTORED = "(?:at|bl|iz)$"


def _ending(rules) -> str:
    """The longest of the suffixes: alternatives at the end match from the left-most place."""
    return "(" + "|".join(suffix for suffix, _ in rules) + ")$"


def _cut(word: Column, n: int | Column) -> Column:
    return F.left(word, F.length(word) - n)


def _replaced(word: Column, rules, least: str) -> Column:
    def apply(w: Column) -> Column:
        suffix = F.regexp_extract(w, _ending(rules), 1)
        stem = _cut(w, F.length(suffix))
        fits = stem.rlike(least) & ((suffix != "ion") | stem.rlike("[st]$"))
        new = F.try_element_at(literal_map({s: n for s, n in rules}), suffix)
        return F.when(suffix == "", w).when(fits, F.concat(stem, new)).otherwise(w)

    return let(word, apply)


def _plurals(w: Column) -> Column:
    return (
        F.when(w.rlike("(?:sses|ies)$"), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
        .otherwise(w)
    )


def _tidy(w: Column) -> Column:
    """After -ed or -ing went: restore an e or undouble the last consonant."""
    return (
        F.when(w.rlike(RESTORED), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLED), _cut(w, 1))
        .when(w.rlike(SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _past(w: Column) -> Column:
    without = F.regexp_replace(w, "(?:ed|ing)$", "")
    return (
        F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(SOME), _cut(w, 1)).otherwise(w))
        .when(w.rlike("(?:ed|ing)$") & without.rlike(HAS_VOWEL), let(without, _tidy))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    goes = w.endswith("e") & (stem.rlike(MANY) | (stem.rlike(ONE) & ~stem.rlike(SHORT)))
    return F.when(goes, stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MANY), _cut(w, 1)).otherwise(w)


def stem(col: Column) -> Column:
    """Stem of a word; words of one or two letters are left as they are, in lower case."""
    word = F.regexp_replace(F.lower(col), "^y", "Y")
    for step in (_plurals, _past, _final_y):
        word = let(word, step)
    for rules, least in ((_STEP2, SOME), (_STEP3, SOME), (_STEP4, MANY)):
        word = _replaced(word, rules, least)
    word = F.lower(let(let(word, _final_e), _final_l))
    return F.when(F.length(col) <= 2, F.lower(col)).otherwise(word)


def stem_sql(source: str, name: str = "name") -> str:
    """The chain as common table expressions of DuckDB; the last one is ``stems`` (name, stem)."""

    def cut(n) -> str:
        return f"left(w, length(w) - {n})"

    def matches(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def rules(table: str, source: str, listed, least: str) -> str:
        cases = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in listed)
        return f"""{table}_parts AS (SELECT name, w, regexp_extract(w, '{_ending(listed)}', 1) AS suffix FROM {source}),
{table} AS (SELECT name, CASE WHEN suffix <> '' AND {matches(cut("length(suffix)"), least)}
    AND (suffix <> 'ion' OR {matches(cut("length(suffix)"), "[st]$")})
    THEN {cut("length(suffix)")} || CASE suffix {cases} END ELSE w END AS w FROM {table}_parts)"""

    stripped = "regexp_replace(w, '(?:ed|ing)$', '')"
    return ",\n".join([
        f"porter0 AS (SELECT {name} AS name, regexp_replace(lower({name}), '^y', 'Y') AS w FROM {source})",
        f"""porter1 AS (SELECT name, CASE WHEN {matches("w", "(?:sses|ies)$")} THEN {cut(2)}
    WHEN {matches("w", "s$")} AND NOT {matches("w", "ss$")} THEN {cut(1)} ELSE w END AS w FROM porter0)""",
        f"""porter2 AS (SELECT name, w AS whole, CASE WHEN {matches("w", "eed$")} THEN NULL
    WHEN {matches("w", "(?:ed|ing)$")} AND {matches(stripped, HAS_VOWEL)} THEN {stripped} END AS w FROM porter1)""",
        f"""porter3 AS (SELECT name, CASE WHEN w IS NULL AND {matches("whole", "eed$")}
        AND {matches("left(whole, length(whole) - 3)", SOME)} THEN left(whole, length(whole) - 1)
    WHEN w IS NULL THEN whole WHEN {matches("w", RESTORED)} THEN w || 'e'
    WHEN {matches("w", DOUBLED)} THEN {cut(1)} WHEN {matches("w", SHORT)} THEN w || 'e' ELSE w END AS w FROM porter2)""",
        f"""porter4 AS (SELECT name, CASE WHEN {matches("w", "y$")} AND {matches(cut(1), HAS_VOWEL)}
    THEN {cut(1)} || 'i' ELSE w END AS w FROM porter3)""",
        rules("porter5", "porter4", _STEP2, SOME),
        rules("porter6", "porter5", _STEP3, SOME),
        rules("porter7", "porter6", _STEP4, MANY),
        f"""porter8 AS (SELECT name, CASE WHEN {matches("w", "e$")} AND ({matches(cut(1), MANY)}
    OR ({matches(cut(1), ONE)} AND NOT {matches(cut(1), SHORT)})) THEN {cut(1)} ELSE w END AS w FROM porter7)""",
        f"""stems AS (SELECT name, CASE WHEN length(name) <= 2 THEN lower(name)
    WHEN {matches("w", "ll$")} AND {matches("w", MANY)} THEN lower({cut(1)}) ELSE lower(w) END AS stem FROM porter8)""",
    ])
