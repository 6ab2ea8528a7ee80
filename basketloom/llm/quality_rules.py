"""Quality rules combined by weak supervision, in DataFrame expressions only.

Every rule looks at one statistic of a text and votes good (1), bad (-1) or abstains (0).  The
votes of all documents are counted by pattern, which is at most 3 ** rules rows however many
documents there are, and expectation-maximisation over that one table estimates how often each rule
votes either way on good and on bad documents, and how many documents are good.  A document is kept
if its posterior probability of being good is at least one half.  A rule that nearly all documents
pass says little by passing one more, and much by a bad vote, so a single sure sign of junk can
reject a text while a rule that often errs cannot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.llm.common import BLANKS, UPPER
from basketloom.runtime import Scratch

SYMBOLS = "#*$%&|<>"
BLANK_RUN = r"[ \x09-\x0D]+"
ITERATIONS = 30
# start: log-likelihood ratios of a bad vote, an abstention and a good vote, and log-odds of good
START = (-4.0, 0.0, 0.2)
START_ODDS = 1.0
# a rule stays on the side it votes for, however the estimation goes, and passing it, which most
# documents of either class do, counts little
BAD_RANGE, GOOD_RANGE, ODDS_RANGE = (-8.0, -0.5), (0.0, 0.5), (-2.0, 3.0)
SMOOTHING = 1.0
# repeated windows up to this many are looked up one by one, more are found by sorting
FEW_WINDOWS = 32

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_lines", "n_upper", "n_digits", "n_ends")


def _without(text: Column, characters: str) -> Column:
    # translate() drops the characters that have no counterpart
    return F.translate(text, characters, "")


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(_without(text, characters))).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words inside 3-word windows (given as hashes, in order) that occur twice or more."""

    def repeated_of(ordered: Column) -> Column:
        return F.array_distinct(
            F.filter(ordered, lambda w, i: (i > 0) & (F.get(ordered, i - 1) == w))
        )

    def looked_up(repeated: Column) -> Column:
        positions = F.transform(
            windows, lambda w, i: F.when(F.array_contains(repeated, w), i).otherwise(-1)
        )
        return F.array_remove(positions, -1)

    def sorted_out(placed: Column) -> Column:
        neighbours = F.filter(
            placed,
            lambda x, k: F.get(placed, k - 1)["w"].eqNullSafe(x["w"])
            | F.get(placed, k + 1)["w"].eqNullSafe(x["w"]),
        )
        return F.sort_array(F.transform(neighbours, lambda x: x["i"]))

    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda done, p: F.struct(
                (done["n"] + F.least(F.lit(3), p - done["last"])).alias("n"), p.alias("last")
            ),
            lambda done: done["n"],
        )

    def count(repeated: Column) -> Column:
        return (
            F.when(F.size(repeated) == 0, F.lit(0))
            .when(F.size(repeated) <= FEW_WINDOWS, covered(looked_up(repeated)))
            .otherwise(covered(_let(placed, sorted_out)))
        )

    return _let(_let(F.sort_array(windows), repeated_of), count)


def with_statistics(documents: DataFrame) -> DataFrame:
    """Add the statistics that the base rules and the voting rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("_words", F.array_remove(F.split(text, BLANK_RUN), ""))
    words, n = F.col("_words"), F.size("_words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(_blanks_out(line)) != "")
    rows = rows.withColumns({"_windows": windows, "_lines": lines})
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(_without(text, BLANKS)).cast("long"),
            "n_symbols": _count(text, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_windows")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_upper": _count(text, UPPER),
            "n_digits": _count(text, "0123456789"),
            "n_ends": _count(text, ".!?"),
        }
    ).drop("_words", "_windows", "_lines")


def _blanks_out(line: Column) -> Column:
    return F.translate(line, BLANKS, " " * len(BLANKS))


# name, good, bad: conditions of SQL, so that both engines read the same text
RULES = (
    ("length", "n_words >= 80", "n_words < 20"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words",
     "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    ("lines", "n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    ("repeats", "10 * n_repeat_words < n_words", "10 * n_repeat_words > 4 * n_words"),
    ("capitals", "100 * n_upper < 15 * word_chars", "10 * n_upper > 4 * word_chars"),
    ("ends", "n_ends * 50 >= n_words AND n_ends * 4 <= n_words", "n_ends > n_words"),
    ("digits", "10 * n_digits < word_chars", "2 * n_digits > word_chars"),
)
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def votes() -> dict[str, Column]:
    return {
        f"vote_{name}": F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
        for name, good, bad in RULES
    }


def estimate(voted: DataFrame, iterations: int = ITERATIONS) -> list[float]:
    """Log-likelihood ratios (bad vote, abstention, good vote) of each rule, then the log-odds.

    One row holds all vote patterns and their counts; every step of expectation-maximisation is an
    expression over it, so the whole estimation is one job.
    """
    names = [f"vote_{name}" for name, *_ in RULES]
    m = len(names)
    # at most 3 ** len(RULES) rows, gathered into one
    patterns = voted.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    cells = F.array(*[F.col(name) + 1 + 3 * j for j, name in enumerate(names)])
    gathered = patterns.agg(
        F.sort_array(F.collect_list(F.struct(cells.alias("cells"), F.col("n").alias("n")))).alias(
            "patterns"
        )
    )
    start = F.array(*[F.lit(x) for x in START * m], F.lit(START_ODDS))

    def clamp(value: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))

    def posterior(now: Column, pattern: Column) -> Column:
        odds = F.aggregate(
            pattern["cells"], F.get(now, F.lit(3 * m)), lambda done, c: done + F.get(now, c)
        )
        return 1 / (1 + F.exp(-odds))

    def mass(scored: Column, good: bool) -> Column:
        """Documents of one class by cell, and in all."""
        share = (lambda s: s["good"]) if good else (lambda s: 1 - s["good"])
        return F.aggregate(
            scored,
            F.array(*[F.lit(0.0)] * (3 * m + 1)),
            lambda done, s: F.transform(
                done,
                lambda x, c: F.when(
                    (c == 3 * m) | F.array_contains(s["cells"], c), x + s["n"] * share(s)
                ).otherwise(x),
            ),
        )

    def weights(good: Column, bad: Column) -> Column:
        def ratio(c: int) -> Column:
            g = (F.get(good, F.lit(c)) + SMOOTHING) / (F.get(good, F.lit(3 * m)) + 3 * SMOOTHING)
            b = (F.get(bad, F.lit(c)) + SMOOTHING) / (F.get(bad, F.lit(3 * m)) + 3 * SMOOTHING)
            return F.log(g / b)

        rows: list[Column] = []
        for j in range(m):
            rows += [clamp(ratio(3 * j), *BAD_RANGE), F.lit(0.0), clamp(ratio(3 * j + 2), *GOOD_RANGE)]
        odds = F.log(
            (F.get(good, F.lit(3 * m)) + SMOOTHING) / (F.get(bad, F.lit(3 * m)) + SMOOTHING)
        )
        return F.array(*rows, clamp(odds, *ODDS_RANGE))

    def step(now: Column, _: Column) -> Column:
        scored = F.transform(
            "patterns",
            lambda p: F.struct(
                p["cells"].alias("cells"), p["n"].alias("n"), posterior(now, p).alias("good")
            ),
        )
        return _let(
            scored,
            lambda s: _let(
                mass(s, True), lambda good: _let(mass(s, False), lambda bad: weights(good, bad))
            ),
        )

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step)
    return list(gathered.select(F.coalesce(fitted, start).alias("fitted")).first()["fitted"])


def log_odds(fitted: Sequence[float]) -> Column:
    """Log-odds of a voted document being good."""
    total = F.lit(fitted[-1])
    for j, (name, *_) in enumerate(RULES):
        bad, _, good = fitted[3 * j : 3 * j + 3]
        vote = F.col(f"vote_{name}")
        total = total + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    return total


def judge_quality(documents: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """Documents with their statistics, ``base_failed``, ``good_probability`` and ``kept``.

    ``documents`` needs a column text.  ``carry`` names its columns to return (all by default);
    those named like a new column are replaced.  ``base_failed`` documents (too short or mostly
    repeated) are never kept.  A null or empty text has no words and fails the base rules.  Ties at
    one half are kept; repeated rows are judged one by one.  No rows give no rows.
    """
    new = {*STATISTICS, *FURTHER, *votes(), "base_failed", "good_probability", "kept"}
    carry = [c for c in carry or documents.columns if c not in new]
    rows = documents.select(*{*carry, "text"})
    stored = Scratch(documents.sparkSession, "quality").keep(
        with_statistics(rows).select(*carry, *STATISTICS, *FURTHER)
    )
    voted = stored.withColumns(votes())
    failed = F.expr(BASE_FAILED)
    # what fails the base rules needs no verdict, and would stand for all that is bad
    odds = log_odds(estimate(voted.where(~failed)))
    return voted.select(
        *carry,
        *STATISTICS,
        failed.alias("base_failed"),
        (1 / (1 + F.exp(-odds))).alias("good_probability"),
        (~failed & (odds >= 0)).alias("kept"),
    )
