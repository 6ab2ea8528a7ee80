"""Mining relations between the names of a vocabulary.

Every rule takes a frame with a distinct ``name`` column and returns ``(subject, relation,
object)``.  Rules that compare names with each other are equi joins on a derived key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.functions.fixed_values import BAD_PARENT_OPENINGS, TRADEMARK_SIGNS
from basketloom.functions.stems import stem
from basketloom.functions.text import one_space, plural, singular, tokens
from basketloom.runtime import Scratch


def _relation(subject: str | Column, relation: str | Column, obj: str | Column) -> list[Column]:
    def col(value: str | Column) -> Column:
        return F.col(value) if isinstance(value, str) else value

    kind = F.lit(relation) if isinstance(relation, str) else relation
    return [col(subject).alias("subject"), kind.alias("relation"), col(obj).alias("object")]


def _in_vocabulary(relations: DataFrame, names: DataFrame, column: str) -> DataFrame:
    known = names.select(F.col("name").alias(column))
    return relations.join(known, column, "left_semi").select("subject", "relation", "object")


def discovered(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Objects of relations that are not in the vocabulary yet."""
    return (
        relations.select(F.col("object").alias("name"))
        .join(names.select("name"), "name", "left_anti")
        .distinct()
    )


def spacing_aliases(names: DataFrame) -> DataFrame:
    alias = one_space(F.col("name"))
    return names.where(F.col("name") != alias).select(*_relation("name", "alias:spacing", alias))


def hyphen_aliases(names: DataFrame) -> DataFrame:
    """A hyphenated name is an alias of its spaced form, and so is the joined form if it exists."""
    hyphenated = names.where(F.col("name").contains("-"))
    spaced = one_space(F.replace("name", F.lit("-"), F.lit(" ")))
    joined = F.replace("name", F.lit("-"), F.lit(""))
    # the relation's name keeps the spelling that existing relation files use
    split = hyphenated.select(*_relation("name", "alias:hypenation", spaced))
    closed = hyphenated.select(*_relation(joined, "alias:spacing", spaced)).distinct()
    return split.unionByName(_in_vocabulary(closed, names, "subject"))


def plural_aliases(names: DataFrame) -> DataFrame:
    form = singular(F.col("name"))
    pairs = names.where(form != F.col("name")).select(*_relation("name", "alias:plural-of", form))
    return _in_vocabulary(pairs, names, "object")


def singular_aliases(names: DataFrame) -> DataFrame:
    form = plural(F.col("name"))
    pairs = names.where(form != F.col("name")).select(*_relation("name", "alias:singular-of", form))
    return _in_vocabulary(pairs, names, "object")


def stem_aliases(names: DataFrame) -> DataFrame:
    stemmed = names.select("name", stem(F.col("name")).alias("_stem"))
    pairs = stemmed.where(
        (F.col("_stem") != F.col("name")) & (F.col("_stem") != singular(F.col("name")))
    ).select(*_relation("_stem", "alias:stem-of", "name"))
    return _in_vocabulary(pairs, names, "subject")


Abbreviations = DataFrame | Mapping[str, str] | Sequence[tuple[str, str]]

# characters with a meaning in patterns
_SPECIAL = r"([\\.\[\]{}()*+?^$|\-])"


def abbreviation_table(spark: SparkSession, abbreviations: Abbreviations) -> DataFrame:
    """(pos, short, full) in dictionary order: rows of a frame as they are read, or by its ``pos``."""
    if isinstance(abbreviations, DataFrame):
        short, full = [c for c in abbreviations.columns if c != "pos"][:2]
        pos = F.col("pos") if "pos" in abbreviations.columns else F.monotonically_increasing_id()
        rows = abbreviations.select(pos.alias("pos"), F.col(short).alias("short"), F.col(full).alias("full"))
    else:
        pairs = abbreviations.items() if isinstance(abbreviations, Mapping) else abbreviations
        rows = spark.createDataFrame(
            [(k, short, full) for k, (short, full) in enumerate(pairs)], "pos long, short string, full string"
        )
    return rows.where((F.col("short") != "") & F.col("full").isNotNull())


def _parts(text: Column) -> Column:
    return F.split(text, r"\s", -1)


def expand_abbreviations(names: DataFrame, abbreviations: Abbreviations) -> DataFrame:
    """(name, full) of the names that change when whole words are replaced, one entry after the other.

    Words are looked up in the first words of the entries, and only there the lengths of the entries
    that begin with the word give phrases to look up.  A round applies to every name the first entry
    that it holds after the one applied last, so that an entry sees what earlier ones wrote; names
    without a further entry leave.  Rounds are as many as one name has entries, plus one.
    """
    spark = names.sparkSession
    scratch = Scratch(spark, "abbreviations")
    words = _parts(F.col("short"))
    # looked up with any white space as a blank; the pattern then asks for the entry's own
    entries = scratch.keep(
        abbreviation_table(spark, abbreviations).withColumn("phrase", F.array_join(words, " "))
    )
    openings = scratch.keep(
        entries.groupBy(words[0].alias("word")).agg(F.collect_set(F.size(words)).alias("sizes"))
    )
    current = names.select("name", F.col("name").alias("text"), F.lit(-1).cast("long").alias("last")).distinct()
    while True:
        placed = current.select("name", "text", "last", F.posexplode(_parts(F.col("text"))).alias("at", "word"))
        phrases = (
            placed.join(openings, "word")
            .select("name", "text", "last", "at", F.explode("sizes").alias("size"))
            .select(
                "name", "text", "last",
                F.array_join(F.slice(_parts(F.col("text")), F.col("at") + 1, F.col("size")), " ").alias("phrase"),
            )
        )
        first = F.min(F.struct("pos", "short", "full")).alias("entry")
        hits = phrases.join(entries, "phrase").where("pos > last").groupBy("name", "text").agg(first)
        pattern = F.concat(
            F.lit(r"(?<!\S)"), F.regexp_replace(F.col("entry.short"), _SPECIAL, r"\\$1"), F.lit(r"(?!\S)")
        )
        replacement = F.regexp_replace(F.col("entry.full"), r"([\\$])", r"\\$1")
        current = scratch.add(
            "expanded",
            hits.select(
                "name",
                F.regexp_replace("text", pattern, replacement).alias("text"),
                F.col("entry.pos").alias("last"),
            ),
        )
        if current.isEmpty():
            break
    done = scratch.whole("expanded", current).groupBy("name").agg(F.max_by("text", "last").alias("full"))
    return done.where(F.col("full") != F.col("name"))


def abbreviation_aliases(names: DataFrame, abbreviations: Abbreviations) -> DataFrame:
    full = expand_abbreviations(names.select("name"), abbreviations)
    return full.select(*_relation("name", "alias:abbreviation", "full"))


def all_aliases(
    names: DataFrame, abbreviations: Abbreviations | None
) -> tuple[DataFrame, DataFrame]:
    """Relations of every alias rule, and the names they discover."""
    open_rules = [spacing_aliases(names), hyphen_aliases(names)]
    if abbreviations is not None and not (isinstance(abbreviations, Sequence | Mapping) and not abbreviations):
        open_rules.append(abbreviation_aliases(names, abbreviations))
    closed_rules = [plural_aliases(names), singular_aliases(names), stem_aliases(names)]
    relations = open_rules[0]
    for rule in open_rules[1:] + closed_rules:
        relations = relations.unionByName(rule)
    return relations, discovered(relations, names)


def child_of(names: DataFrame, modifiers: DataFrame) -> DataFrame:
    """Names that open with a modifier are children of the rest of the name.

    Each name is exploded into its leading word runs, none longer than the longest modifier, which
    meet the modifiers in an equi join.
    """
    longest = modifiers.agg(F.max(F.size(tokens(F.col("modifier"))))).first()[0] or 1
    words = names.select("name", tokens(F.col("name")).alias("_words"))
    openings = words.select(
        "name", "_words", F.explode(F.sequence(F.lit(1), F.least(F.size("_words"), F.lit(longest)))).alias("_n")
    ).select(
        "name",
        F.array_join(F.slice("_words", F.lit(1), F.col("_n")), " ").alias("modifier"),
        F.trim(
            F.array_join(
                F.slice("_words", F.col("_n") + 1, F.size("_words") - F.col("_n")), " "
            )
        ).alias("_parent"),
    )
    parent = F.col("_parent")
    allowed = parent != ""
    for opening in BAD_PARENT_OPENINGS:
        allowed = allowed & ~parent.startswith(opening)
    return (
        openings.where(allowed)
        .join(modifiers.select("modifier").distinct(), "modifier")
        .select(
            *_relation(
                "name", F.concat(F.lit("child-of:starts-with:"), F.col("modifier")), "_parent"
            )
        )
    )


def all_child_of(names: DataFrame, modifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Child-of relations of the vocabulary and of every parent it leads to.

    Only the names found last are looked at in the next round.  A parent is shorter than its
    child, so the rounds end.
    """
    scratch = Scratch(names.sparkSession, "child-of")
    relations = scratch.add("relations", child_of(names, modifiers))
    fresh = scratch.add("found", discovered(relations, names))
    while not fresh.isEmpty():
        relations = scratch.add("relations", child_of(fresh, modifiers))
        found = scratch.whole("found", fresh)
        fresh = scratch.add(
            "found", discovered(relations, names).join(found, "name", "left_anti")
        )
    return scratch.whole("relations", relations).distinct(), scratch.whole("found", fresh)


def word_forms(words: DataFrame) -> DataFrame:
    """(word, form) for the singular, plural and stem of each word."""
    word = F.col("word")
    forms = words.select("word", F.array(singular(word), plural(word), stem(word)).alias("_forms"))
    return forms.select("word", F.explode(F.array_distinct("_forms")).alias("form"))


def related_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (word, term) that are equal, or where one is a form of the other."""
    words, terms = words.select("word").distinct(), terms.select("term").distinct()
    equal = words.join(terms, words.word == terms.term).select("word", "term")
    forward = word_forms(words).join(terms, F.col("form") == terms.term).select("word", "term")
    term_forms = word_forms(terms.select(F.col("term").alias("word"))).select(
        F.col("word").alias("term"), F.col("form").alias("word")
    )
    backward = term_forms.join(words, "word").select("word", "term")
    return equal.unionByName(forward).unionByName(backward).distinct()


def subtypes_of_roots(roots: DataFrame) -> DataFrame:
    """Phrases whose last or first word is related to a one-word root."""
    name = F.trim("name")
    parts = roots.select(name.alias("name"), F.split(name, r"\s+", -1).alias("_words"))
    terms = parts.where(F.size("_words") == 1).select(F.col("name").alias("term"))
    phrases = parts.where(
        (F.size("_words") > 1) & (F.try_element_at("_words", F.lit(-2)) != "and")
    ).select(
        "name",
        F.element_at("_words", 1).alias("_first"),
        F.element_at("_words", -1).alias("_last"),
    )
    words = phrases.select(F.explode(F.array("_first", "_last")).alias("word"))
    related = related_terms(words, terms)
    by_last = phrases.join(related.withColumnRenamed("word", "_last"), "_last").select(
        *_relation("name", "subtype-of:last-word", "term")
    )
    by_first = phrases.join(related.withColumnRenamed("word", "_first"), "_first").select(
        *_relation("name", "subtype-or-composite-of:first-word", "term")
    )
    return by_last.unionByName(by_first)


def trademarks(names: DataFrame, signs: Sequence[str] = TRADEMARK_SIGNS) -> DataFrame:
    """Text before the first occurrence of each sign."""
    marks = F.array(
        *[
            F.when(F.col("name").contains(sign), F.substring_index("name", sign, 1))
            for sign in signs
        ]
    )
    return (
        names.select(F.explode(marks).alias("mark"))
        .where(F.col("mark").isNotNull() & (F.col("mark") != ""))
        .distinct()
    )


def trademark_relations(
    names: DataFrame,
    known: DataFrame | None = None,
    signs: Sequence[str] = TRADEMARK_SIGNS,
) -> DataFrame:
    """Every name that starts with a trademark contains it; no word boundary is needed.

    Names are exploded into their prefixes of the lengths that marks have, and the prefixes meet
    the marks in an equi join.  The lengths are bounded by the longest name, not by the data.
    """
    marks = trademarks(names, signs)
    if known is not None:
        marks = marks.unionByName(known.select("mark").where(F.col("mark") != "")).distinct()
    lengths = sorted(row[0] for row in marks.select(F.length("mark")).distinct().collect())
    if not lengths:
        return names.limit(0).select(*_relation("name", "contains:trade-mark", "name"))
    sizes = F.filter(
        F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("name")
    )
    prefixes = names.select("name", F.explode(sizes).alias("_n")).select(
        "name", F.left("name", F.col("_n")).alias("mark")
    )
    return prefixes.join(marks, "mark").select(
        *_relation("name", "contains:trade-mark", "mark")
    )
