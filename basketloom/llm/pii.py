"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Four base kinds are found by their form.  They are the seeds: the two words before the word that
holds a seed, and what that word has glued to the seed's front, are a lexical pattern, and words
with many digits are the identifiers that a pattern may introduce.  Patterns and identifiers form a
graph that is scored in rounds until no identifier is added.  A pattern is trusted if at least
``LEAST_SEEDS`` different known identifiers follow it and they follow most of its occurrences in
the whole corpus; every identifier that a trusted pattern introduces becomes known, which may raise
other patterns.  What the trusted patterns introduce is found too, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import ascii_lower
from basketloom.runtime import Scratch

KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
LEAST_SEEDS, LEAST_SHARE = 3, 0.5
# a pattern is first looked for in so many characters before an identifier, then in all of them
CONTEXT_CHARS = (64, 2048)
# patterns that are sent to every executor; more are joined by shuffling
SENT_PATTERNS = 200_000
# one of so many parts of the texts is looked at first
SLICES = 16

# Possessive forms of the base patterns: nothing follows a repetition, so they match the same, and
# Java runs them in a loop instead of by recursion.  A match may begin inside a run only where the
# one before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# at most 255 after any zeros, or zeros alone; one way to match
IP_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?|(?<=0))"
WORD = r"[^\x20\x09-\x0D]++"
BLANK_RUN = r"[\x20\x09-\x0D]++"
# what may stand glued before an identifier
LABEL = r"^[^0-9+@]*[:=<(\[{\"'|]"
# the last two words before a place and what is glued to its front
BEFORE = r"[\x20\x09-\x0D][^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]*+\z"
BLOCK = 256

SPAN = "struct<start:int,end:int,kind:string>"
FOUND = "array<struct<start:int,end:int,text:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(steps: Column, start: Column) -> Column:
    """Sums of all elements before each one, plus ``start``."""
    nothing = F.array().cast("array<int>")
    return F.aggregate(
        steps,
        F.struct(start.alias("sum"), nothing.alias("out")),
        lambda done, step: F.struct(
            (done["sum"] + step).alias("sum"),
            F.concat(done["out"], F.array(done["sum"])).alias("out"),
        ),
        lambda done: done["out"],
    )


def _starts(steps: Column) -> Column:
    """``_running`` from 0, block by block so that long arrays are not copied once per element."""
    block = lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.sequence(F.lit(0), (F.size(steps) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
    return _let(
        _running(sums, F.lit(0)),
        lambda at: F.flatten(F.transform(blocks, lambda b: _running(block(b), F.get(at, b)))),
    )


def _matches(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` with their place in code points."""

    def place(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        return _let(
            _starts(steps),
            lambda at: F.transform(
                found,
                lambda m, i: _let(
                    F.get(at, i) + F.length(F.get(gaps, i)),
                    lambda start: F.struct(
                        start.alias("start"),
                        (start + F.length(m)).alias("end"),
                        m.alias("text"),
                    ),
                ),
            ),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(
        found,
        lambda f: F.when(F.size(f) == 0, F.array().cast(FOUND)).otherwise(
            _let(F.split(text, pattern, -1), lambda gaps: place(f, gaps))
        ),
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * (1 + F.pmod(i, F.lit(2)))
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _base(text: Column, kind: str) -> Column:
    """Spans of one base kind; a match that fails its test is dropped, nothing is tried again."""
    pattern, may_hold, test = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        "ip": (
            IP,
            text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
            lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
        ),
        "card": (
            CARD,
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
            lambda m: _let(
                _digits(m),
                lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False),
            ),
        ),
        "phone": (
            PHONE,
            F.contains(text, F.lit("+")),
            lambda m: F.length(_digits(m)).between(9, 15),
        ),
    }[kind]
    spans = F.transform(
        F.filter(_matches(text, pattern), lambda m: test(m["text"])),
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            F.lower(m["text"]).alias("text"),
        ),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    return F.when(may_hold, spans).otherwise(nothing)


def _identifiers(text: Column) -> Column:
    """Words with five digits or more, without the marks around them and a label like ``tel:``."""

    def core(m: Column) -> Column:
        label = F.regexp_extract(m["text"], LABEL, 0)
        rest = F.substring(m["text"], F.length(label) + 1, F.length(m["text"]))
        said = F.regexp_extract(rest, r"[A-Za-z0-9+@](?:.*[A-Za-z0-9])?", 0)
        return _let(
            F.struct(
                (m["start"] + F.length(label) + F.position(said, rest) - 1).alias("start"),
                said.alias("said"),
            ),
            lambda x: F.struct(
                x["start"].alias("start"),
                (x["start"] + F.length(x["said"])).alias("end"),
                F.lit(OTHER).alias("kind"),
                F.lower(x["said"]).alias("text"),
            ),
        )

    many = r"(?:[0-9][^0-9\x20\x09-\x0D]*+){5}"
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    words = F.filter(_matches(text, WORD), lambda m: m["text"].rlike(many))
    return F.when(text.rlike(many), F.transform(words, core)).otherwise(nothing)


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(F.lower(first), F.lower(second))


def _pattern(pair: Column, glued: Column) -> Column:
    return F.xxhash64(pair, glued)


def _context(text: Column, start: Column) -> Column:
    """Hashes of the pattern and of the two words in it, and how many characters it has glued.

    Null if there are not two words before the one that holds ``start``.
    """

    def said(n: Column) -> Column:
        first = F.greatest(start - n, F.lit(0))
        before = F.substring(text, first + 1, start - first)
        # a word also begins where the text begins
        begun = F.when(first == 0, F.concat(F.lit(" "), before)).otherwise(before)
        return F.regexp_extract(begun, BEFORE, 0)

    def widened(n: Column, *wider: Column) -> Column:
        if not wider:
            return said(n)
        return _let(
            said(n), lambda s: F.when((s != "") | (n >= start), s).otherwise(widened(*wider))
        )

    return _let(
        widened(*map(F.lit, CONTEXT_CHARS), start),
        lambda s: F.when(
            s != "",
            _let(
                F.split(s, BLANK_RUN, -1),
                lambda w: _let(
                    F.struct(
                        _pair(F.get(w, F.lit(1)), F.get(w, F.lit(2))).alias("pair"),
                        # lower-cased letter by letter, so that a part is the same as within its word
                        ascii_lower(F.get(w, F.lit(3))).alias("glued"),
                    ),
                    lambda p: F.struct(
                        _pattern(p["pair"], p["glued"]).alias("pattern"),
                        p["pair"].alias("pair"),
                        F.length(p["glued"]).alias("n_glued"),
                    ),
                ),
            ),
        ),
    )


def _with_context(text: Column, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: _let(
            _context(text, s["start"]),
            lambda c: F.struct(
                s["start"], s["end"], s["kind"], F.xxhash64(s["text"]).alias("value"),
                c["pattern"].alias("pattern"), c["pair"].alias("pair"), c["n_glued"].alias("n_glued"),
            ),
        ),
    )


def _pattern_totals(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each of ``patterns`` occurs in the texts, whatever follows it."""
    n_patterns = patterns.count()
    if n_patterns == 0:
        return patterns.select("pattern").withColumn("total", F.lit(0).cast("long"))
    wanted = patterns.groupBy("pair").agg(F.collect_set("n_glued").alias("lengths"))
    known = patterns.select("pattern")
    if n_patterns <= SENT_PATTERNS:
        wanted, known = F.broadcast(wanted), F.broadcast(known)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    pairs = documents.select(words.alias("w")).select(
        F.explode(
            F.transform(
                F.when(F.size("w") >= 2, F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
                .otherwise(F.array().cast("array<string>")),
                lambda a, i: F.struct(
                    _pair(a, F.get(F.col("w"), i + 1)).alias("pair"),
                    F.coalesce(F.get(F.col("w"), i + 2), F.lit("")).alias("next"),
                ),
            )
        ).alias("p")
    ).select("p.*")
    glued = lambda n: ascii_lower(F.substring("next", F.lit(1), n))
    fitting = F.filter("lengths", lambda n: n <= F.length("next"))
    found = pairs.join(wanted, "pair").select(
        F.explode(F.transform(fitting, lambda n: _pattern(F.col("pair"), glued(n)))).alias("pattern")
    )
    return found.join(known, "pattern").groupBy("pattern").agg(F.count("*").alias("total"))


def trusted(mentions: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Known identifiers that patterns brought in: rows (pattern, value) of the scored graph."""
    edges = scratch.keep(
        mentions.where(F.col("pattern").isNotNull())
        .groupBy("pattern", "value")
        .agg(
            F.count("*").alias("n"),
            F.max((F.col("kind") != OTHER).cast("int")).alias("seed"),
            F.first("pair").alias("pair"),
            F.first("n_glued").alias("n_glued"),
        )
    )
    wide = scratch.keep(
        edges.groupBy("pattern")
        .agg(
            F.count("*").alias("values"),
            F.sum("n").alias("mentions"),
            F.first("pair").alias("pair"),
            F.first("n_glued").alias("n_glued"),
        )
        .where(F.col("values") >= LEAST_SEEDS)
        .select("pattern", "pair", "n_glued", "mentions")
    )
    # a pattern that a sixteenth of the texts shows to be common already cannot be trusted
    slice_totals = _pattern_totals(
        documents.where(F.pmod(F.xxhash64("text"), F.lit(SLICES)) == 0), wide
    )
    open_still = scratch.keep(
        wide.join(slice_totals, "pattern", "left")
        .where(F.col("mentions") >= LEAST_SHARE * F.coalesce("total", F.lit(0)))
        .select("pattern", "pair", "n_glued")
    )
    totals = scratch.keep(_pattern_totals(documents, open_still))
    graph = scratch.keep(edges.join(totals, "pattern").select("pattern", "value", "n", "total"))
    known = scratch.keep(edges.where("seed = 1").select("value").distinct())
    n_known, grown = known.count(), True
    while grown:
        scores = (
            graph.join(known.withColumn("is_known", F.lit(1)), "value", "left")
            .where("is_known = 1")
            .groupBy("pattern")
            .agg(
                F.count("*").alias("values"),
                F.sum("n").alias("n"),
                F.max("total").alias("total"),
            )
        )
        good = scores.where(
            (F.col("values") >= LEAST_SEEDS) & (F.col("n") >= LEAST_SHARE * F.col("total"))
        ).select("pattern")
        more = scratch.keep(
            graph.join(good, "pattern").select("value").unionByName(known).distinct()
        )
        scratch.drop(known)
        known, before, n_known = more, n_known, more.count()
        grown = n_known > before
    return edges.where("seed = 0").join(known, "value").select("value").distinct()


def find_personal_data(documents: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """Documents with ``base`` and ``spans``: arrays of (start, end, kind), ends exclusive.

    ``documents`` needs a column text; ``carry`` names its columns to return (all by default), of
    which those named like a new column are replaced.  Places count code points from 0.  ``base``
    has the four base kinds, ``spans`` also what the patterns found (kind ``other``), never
    overlapping a base span.  Both are ordered by start, then kind as listed in ``KINDS``.
    A null or empty text has no spans.  Repeated rows are answered one by one and count as often
    as they occur.  No rows give no rows.
    """
    new = {"base", "spans", "candidates", "row_id"}
    carry = [c for c in carry or documents.columns if c not in new]
    text = F.coalesce("text", F.lit(""))
    scratch = Scratch(documents.sparkSession, "personal-data")
    rows = documents.select(*{*carry, "text"})
    base = reduce(F.concat, [_base(text, kind) for kind in KINDS])
    stored = scratch.keep(
        rows.withColumns({"base": base, "candidates": _identifiers(text)}).withColumns(
            {
                "base": _with_context(text, F.col("base")),
                "candidates": _with_context(text, F.col("candidates")),
                "row_id": F.monotonically_increasing_id(),
            }
        ).select(*carry, "base", "candidates", "row_id")
    )
    free = F.filter(
        "candidates",
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    mentions = stored.select("row_id", F.explode(F.concat("base", free)).alias("m")).select(
        "row_id", "m.*"
    )
    values = scratch.keep(trusted(mentions, rows, scratch))
    found = (
        mentions.where(F.col("kind") == OTHER)
        .join(values, "value")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", "end", "kind")).alias("found"))
    )
    slim = F.transform("base", lambda b: F.struct(b["start"], b["end"], b["kind"]))
    order = {kind: k for k, kind in enumerate((*KINDS, OTHER))}
    rank = lambda kind: reduce(
        lambda done, item: done.when(kind == item[0], item[1]),
        list(order.items())[1:],
        F.when(kind == KINDS[0], 0),
    )

    def ordered(spans: Column) -> Column:
        keyed = F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"),
                s["kind"].alias("kind"),
            ),
        )
        return F.transform(
            F.sort_array(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"])
        )

    none = F.array().cast(f"array<{SPAN}>")
    return stored.join(found, "row_id", "left").select(
        *carry,
        ordered(slim).alias("base"),
        ordered(F.concat(slim, F.coalesce("found", none))).alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    said = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(said, ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in capitals; overlapping spans go as one."""
    text = F.coalesce(text, F.lit(""))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["out"],
                    F.array(
                        F.substring(text, done["at"] + 1, s["start"] - done["at"]),
                        F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")),
                    ),
                ),
            ).otherwise(done["out"]).alias("out"),
        ),
        lambda done: F.concat(
            F.array_join(done["out"], ""),
            F.substring(text, done["at"] + 1, F.length(text) - done["at"]),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)
