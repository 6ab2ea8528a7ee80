"""Relations mined from the words of the documents and the part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketloom.catalog import bindings as b
from basketloom.catalog.registry import register
from basketloom.functions.stems import stem_sql
from basketloom.functions.text import IRREGULAR_NOUNS
from basketloom.operators import relations as rel
from basketloom.runtime import Scratch

_ABBREVIATIONS = (("sm", "small"), ("lg", "large"), ("std", "standard"), ("wdgt", "widget"))


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in pair) + ")" for pair in pairs)


_IRREGULAR = f"""irregular(one, many) AS (VALUES {_values(IRREGULAR_NOUNS)})"""
_FORMS = """forms AS (SELECT name, string_split(name, ' ')[-1] AS word FROM words),
    numbers AS (SELECT name,
        CASE WHEN s.one IS NOT NULL THEN left(name, length(name) - length(word)) || s.one
            WHEN regexp_matches(name, '[^ ]{2}ies$') THEN left(name, length(name) - 3) || 'y'
            WHEN regexp_matches(name, '(ch|sh|ss|x|zz|[^aeiou ]o)es$')
                THEN left(name, length(name) - 2)
            WHEN regexp_matches(name, '[^s]s$') AND NOT regexp_matches(name, '(us|is)$')
                THEN left(name, length(name) - 1)
            ELSE name END AS singular,
        CASE WHEN name = '' THEN name
            WHEN p.many IS NOT NULL THEN left(name, length(name) - length(word)) || p.many
            WHEN regexp_matches(name, '[^aeiou ]y$') THEN left(name, length(name) - 1) || 'ies'
            WHEN regexp_matches(name, '(ch|sh|s|x|z|[^aeiou ]o)$') THEN name || 'es'
            ELSE name || 's' END AS plural
        FROM forms LEFT JOIN irregular s ON s.many = word LEFT JOIN irregular p ON p.one = word)"""


def _words(spark, sf):
    return b.words(spark, sf)


@register(
    "g1_spacing_aliases",
    b.with_ctes(
        "SELECT name AS subject, 'alias:spacing' AS relation, replace(name, '  ', ' ') AS object "
        "FROM words WHERE contains(name, '  ')",
        b.WORDS,
    ),
)
def _(spark, sf):
    return rel.spacing_aliases(_words(spark, sf))


_HYPHENS = """hyphens AS (
    SELECT name AS subject, 'alias:hypenation' AS relation,
        replace(replace(name, '-', ' '), '  ', ' ') AS object FROM words WHERE contains(name, '-')
    UNION ALL
    SELECT DISTINCT replace(name, '-', ''), 'alias:spacing',
        replace(replace(name, '-', ' '), '  ', ' ') FROM words
    WHERE contains(name, '-') AND replace(name, '-', '') IN (SELECT name FROM words))"""


@register("g2_hyphen_aliases", b.with_ctes("SELECT * FROM hyphens", b.WORDS, _HYPHENS))
def _(spark, sf):
    return rel.hyphen_aliases(_words(spark, sf))


# types and brands are words of the vocabulary in their hyphened form only
_TYPED = "words AS (SELECT name FROM plain_words UNION SELECT lower(p_type || '-' || p_brand) FROM part)"


@register(
    "g2_discovered_names",
    b.with_ctes(
        "SELECT DISTINCT object AS name FROM hyphens WHERE object NOT IN (SELECT name FROM words)",
        b.WORDS.replace("words AS (", "plain_words AS ("), _TYPED, _HYPHENS,
    ),
)
def _(spark, sf):
    typed = b.table(spark, sf, "part").select(F.lower(F.concat_ws("-", "p_type", "p_brand")).alias("name"))
    words = Scratch(spark, "words").keep(_words(spark, sf).unionByName(typed).distinct())
    return rel.discovered(rel.hyphen_aliases(words), words)


@register(
    "g3_plural_aliases",
    b.with_ctes(
        "SELECT name AS subject, 'alias:plural-of' AS relation, singular AS object FROM numbers "
        "WHERE singular <> name AND singular IN (SELECT name FROM words)",
        b.WORDS, _IRREGULAR, _FORMS,
    ),
)
def _(spark, sf):
    return rel.plural_aliases(_words(spark, sf))


@register(
    "g4_singular_aliases",
    b.with_ctes(
        "SELECT name AS subject, 'alias:singular-of' AS relation, plural AS object FROM numbers "
        "WHERE plural <> name AND plural IN (SELECT name FROM words)",
        b.WORDS, _IRREGULAR, _FORMS,
    ),
)
def _(spark, sf):
    return rel.singular_aliases(_words(spark, sf))


_STEMS = stem_sql("words")
_STEM_ALIASES = """SELECT stem AS subject, 'alias:stem-of' AS relation, name AS object FROM stems JOIN numbers USING (name)
    WHERE stem <> name AND stem <> singular AND stem IN (SELECT name FROM words)"""


@register("g5_stem_aliases", b.with_ctes(_STEM_ALIASES, b.WORDS, _IRREGULAR, _FORMS, _STEMS))
def _(spark, sf):
    return rel.stem_aliases(Scratch(spark, "words").keep(_words(spark, sf)))


def _short_names(spark, sf):
    part = b.table(spark, sf, "part")
    short = F.replace(
        F.replace("p_name", F.lit("small"), F.lit("sm")), F.lit("widget"), F.lit("wdgt")
    )
    return part.select(F.concat_ws(" ", F.lit("std"), "p_brand", short).alias("name")).distinct()


_SHORT = """short AS (SELECT DISTINCT 'std ' || p_brand || ' ' ||
    replace(replace(p_name, 'small', 'sm'), 'widget', 'wdgt') AS name FROM part)"""


@register(
    "g6_abbreviation_aliases",
    b.with_ctes(
        "SELECT name AS subject, 'alias:abbreviation' AS relation, array_to_string(list_transform("
        "string_split(name, ' '), lambda w: CASE w "
        + " ".join(f"WHEN '{short}' THEN '{full}'" for short, full in _ABBREVIATIONS)
        + " ELSE w END), ' ') AS object FROM short",
        _SHORT,
    ),
)
def _(spark, sf):
    return rel.abbreviation_aliases(_short_names(spark, sf), _ABBREVIATIONS)


_EXPANDED = ("array_to_string(list_transform(string_split(name, ' '), lambda w: CASE w "
    + " ".join(f"WHEN '{short}' THEN '{full}'" for short, full in _ABBREVIATIONS)
    + " ELSE w END), ' ')")
_ALL_WORDS = (
    b.WORDS.replace("words AS (", "all_words AS ("),
    _SHORT,
    "words AS (SELECT name FROM all_words UNION SELECT name FROM short)",
)
_ALL_ALIASES = f"""aliases AS (SELECT * FROM hyphens
    UNION ALL SELECT name, 'alias:spacing', replace(name, '  ', ' ') FROM words WHERE contains(name, '  ')
    UNION ALL SELECT name, 'alias:abbreviation', {_EXPANDED} FROM words WHERE {_EXPANDED} <> name
    UNION ALL SELECT name, 'alias:plural-of', singular FROM numbers
        WHERE singular <> name AND singular IN (SELECT name FROM words)
    UNION ALL SELECT name, 'alias:singular-of', plural FROM numbers
        WHERE plural <> name AND plural IN (SELECT name FROM words)
    UNION ALL {_STEM_ALIASES})"""


def _all_words(spark, sf):
    return Scratch(spark, "words").keep(_words(spark, sf).unionByName(_short_names(spark, sf)).distinct())


@register(
    "g6b_all_aliases",
    b.with_ctes("SELECT * FROM aliases", *_ALL_WORDS, _HYPHENS, _IRREGULAR, _FORMS, _STEMS, _ALL_ALIASES),
)
def _(spark, sf):
    return rel.all_aliases(_all_words(spark, sf), _ABBREVIATIONS)[0]


@register(
    "g6b_all_discovered",
    b.with_ctes(
        "SELECT DISTINCT object AS name FROM aliases WHERE object NOT IN (SELECT name FROM words)",
        *_ALL_WORDS, _HYPHENS, _IRREGULAR, _FORMS, _STEMS, _ALL_ALIASES,
    ),
)
def _(spark, sf):
    return rel.all_aliases(_all_words(spark, sf), _ABBREVIATIONS)[1]


def _modifiers(spark, sf):
    """Leading words of the part names, and a two-word modifier."""
    leading = F.substring_index("p_name", " ", 1)
    listed = F.explode(F.array(leading, F.lit("new"), F.lit("new red")))
    return b.table(spark, sf, "part").select(listed.alias("modifier")).distinct()


_MODIFIER_ROWS = """modifiers AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS modifier FROM part
    UNION SELECT 'new red' UNION SELECT 'new')"""
_CHILD_OF = """SELECT name AS subject, 'child-of:starts-with:' || modifier AS relation,
    trim(substr(name, length(modifier) + 2)) AS object FROM {names} JOIN modifiers
    ON starts_with(name, modifier || ' ') WHERE trim(substr(name, length(modifier) + 2)) <> ''
    AND NOT starts_with(trim(substr(name, length(modifier) + 2)), 'and ')
    AND NOT starts_with(trim(substr(name, length(modifier) + 2)), '&')"""


@register(
    "g7_child_of_candidates",
    b.with_ctes(_CHILD_OF.format(names="words"), b.WORDS, _MODIFIER_ROWS),
)
def _(spark, sf):
    return rel.child_of(_words(spark, sf), _modifiers(spark, sf))


_CHILD_CLOSURE = f"""child_of AS (
    SELECT subject, relation, object FROM ({_CHILD_OF.format(names='words')}) AS first_round
    UNION
    SELECT name, 'child-of:starts-with:' || modifier, trim(substr(name, length(modifier) + 2))
    FROM (SELECT object AS name FROM child_of) AS found JOIN modifiers
    ON starts_with(name, modifier || ' ') WHERE trim(substr(name, length(modifier) + 2)) <> '')"""


@register(
    "g8_child_of_closure",
    b.with_ctes("SELECT DISTINCT subject, relation, object FROM child_of", b.WORDS, _MODIFIER_ROWS,
                _CHILD_CLOSURE).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf):
    words = Scratch(spark, "words").keep(_words(spark, sf))
    return rel.all_child_of(words, _modifiers(spark, sf))[0]


@register(
    "g8_discovered_parents",
    b.with_ctes(
        "SELECT DISTINCT object AS name FROM child_of WHERE object NOT IN (SELECT name FROM words)",
        b.WORDS, _MODIFIER_ROWS, _CHILD_CLOSURE,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(spark, sf):
    words = Scratch(spark, "words").keep(_words(spark, sf))
    return rel.all_child_of(words, _modifiers(spark, sf))[1]


# names of two words whose parts are among the one-word roots; stems change none of these words
_ROOTS = """roots AS (SELECT p_name AS name FROM part
    UNION SELECT string_split(p_name, ' ')[-1] || 's' FROM part
    UNION SELECT string_split(p_name, ' ')[1] FROM part
    UNION SELECT p_name || ' and ' || lower(p_type) FROM part),
    terms AS (SELECT name AS term FROM roots WHERE NOT contains(name, ' ')),
    phrases AS (SELECT name, string_split(name, ' ')[1] AS first, string_split(name, ' ')[-1]
        AS last FROM roots WHERE contains(name, ' ') AND string_split(name, ' ')[-2] <> 'and')"""


@register(
    "g9_subtypes_of_roots",
    b.with_ctes(
        "SELECT name AS subject, 'subtype-of:last-word' AS relation, term AS object FROM phrases "
        "JOIN terms ON last = term OR last || 's' = term UNION ALL "
        "SELECT name, 'subtype-or-composite-of:first-word', term FROM phrases "
        "JOIN terms ON first = term OR first || 's' = term",
        _ROOTS,
    ),
)
def _(spark, sf):
    part = b.table(spark, sf, "part")
    roots = part.select(
        F.explode(
            F.array(
                F.col("p_name"),
                F.concat(F.substring_index("p_name", " ", -1), F.lit("s")),
                F.substring_index("p_name", " ", 1),
                F.concat_ws(" and ", "p_name", F.lower("p_type")),
            )
        ).alias("name")
    )
    return rel.subtypes_of_roots(roots.distinct())


_RELATED = """one AS (SELECT name, singular, plural, stem FROM numbers JOIN stems USING (name) WHERE NOT contains(name, ' ')),
    other_forms AS (SELECT name, singular AS form FROM one UNION SELECT name, plural FROM one
        UNION SELECT name, stem FROM one)"""


@register(
    "g10_related_terms",
    b.with_ctes(
        "SELECT DISTINCT word, term FROM (SELECT f.name AS word, o.name AS term FROM other_forms f JOIN one o "
        "ON f.form = o.name UNION ALL SELECT o.name, f.name FROM other_forms f JOIN one o ON f.form = o.name) "
        "WHERE word <> term",
        b.WORDS, _IRREGULAR, _FORMS, _STEMS, _RELATED,
    ),
)
def _(spark, sf):
    words = Scratch(spark, "words").keep(_words(spark, sf).where(~F.col("name").contains(" ")))
    return rel.related_terms(
        words.select(F.col("name").alias("word")), words.select(F.col("name").alias("term"))
    ).where("word <> term")


_MARKED = """marked AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 3 = 0 THEN '® '
    WHEN p_size % 3 = 1 AND p_size < 10 THEN '™ ' ELSE ' ' END || p_name AS name FROM part),
    marks AS (SELECT DISTINCT string_split(name, '®')[1] AS mark FROM marked
        WHERE contains(name, '®') UNION SELECT DISTINCT string_split(name, '™')[1] FROM marked
        WHERE contains(name, '™'))"""


def _marked(spark, sf):
    sign = (
        F.when(F.col("p_size") % 3 == 0, "® ")
        .when((F.col("p_size") % 3 == 1) & (F.col("p_size") < 10), "™ ")
        .otherwise(" ")
    )
    return b.table(spark, sf, "part").select(F.concat("p_brand", sign, "p_name").alias("name")).distinct()


@register("g11_trademarks", b.with_ctes("SELECT mark FROM marks", _MARKED))
def _(spark, sf):
    return rel.trademarks(_marked(spark, sf))


@register(
    "g11_trademark_relations",
    b.with_ctes(
        "SELECT name AS subject, 'contains:trade-mark' AS relation, mark AS object FROM marked "
        "JOIN marks ON starts_with(name, mark)",
        _MARKED,
    ),
)
def _(spark, sf):
    return rel.trademark_relations(_marked(spark, sf))
