"""Counts, scores, filters, core extraction, set operations and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketloom.catalog import bindings as b
from basketloom.catalog.registry import register
from basketloom.functions.fixed_values import BAD_NAME_OPENING, BAD_NAME_PARTS
from basketloom.operators import core, counts, quality
from basketloom.operators.walk import random_rows
from basketloom.runtime import dense_ids
from basketloom.sources.exports import nested_baskets
from basketloom.sources.vocabulary import multimap

# all items, and as many again for a tenth of them that no edge names
_MORE_ITEMS = """more_items AS (SELECT item_id, item_name FROM items UNION ALL
    SELECT -item_id, item_name FROM items WHERE item_id % 10 = 1)"""
_COUNTS = """counts AS (SELECT item_id, item_name, count(*) AS count
    FROM items JOIN edges USING (item_id) GROUP BY item_id, item_name)"""
_SCORES = """scores AS (SELECT basket_id, min(count) AS score
    FROM edges JOIN counts USING (item_id) GROUP BY basket_id)"""


def _more_items(spark, sf):
    items = b.items(spark, sf)
    return items.unionByName(
        items.where("item_id % 10 = 1").withColumn("item_id", -F.col("item_id"))
    )


def _counts(spark, sf):
    return counts.count_items(b.items(spark, sf), b.edges(spark, sf))


def _scores(spark, sf, score="min"):
    return counts.basket_scores(b.edges(spark, sf), _counts(spark, sf), score)


@register(
    "a1_item_counts_outer_rows",
    b.with_ctes(
        "SELECT item_id, item_name, count(*) AS count FROM more_items LEFT JOIN edges "
        "USING (item_id) GROUP BY item_id, item_name",
        b.ITEMS, b.EDGES, _MORE_ITEMS,
    ),
)
def _(spark, sf):
    return counts.count_items(_more_items(spark, sf), b.edges(spark, sf), "left", "rows")


@register(
    "a1_item_counts_outer_edges",
    b.with_ctes(
        "SELECT item_id, item_name, count(edge_id) AS count FROM more_items LEFT JOIN edges "
        "USING (item_id) GROUP BY item_id, item_name",
        b.ITEMS, b.EDGES, _MORE_ITEMS,
    ),
)
def _(spark, sf):
    return counts.count_items(_more_items(spark, sf), b.edges(spark, sf), "left", "edges")


@register(
    "a1_item_counts_distinct_baskets",
    b.with_ctes(
        "SELECT item_id, item_name, count(DISTINCT basket_id) AS count FROM more_items "
        "LEFT JOIN edges USING (item_id) GROUP BY item_id, item_name",
        b.ITEMS, b.EDGES, _MORE_ITEMS,
    ),
)
def _(spark, sf):
    return counts.count_items(_more_items(spark, sf), b.edges(spark, sf), "left", "baskets")


@register(
    "a2_item_counts_inner",
    b.with_ctes(
        "SELECT item_id, item_name, count(*) AS count FROM more_items JOIN edges "
        "USING (item_id) GROUP BY item_id, item_name",
        b.ITEMS, b.EDGES, _MORE_ITEMS,
    ),
)
def _(spark, sf):
    return counts.count_items(_more_items(spark, sf), b.edges(spark, sf))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_GOOD_NAME = " AND ".join(
    [
        *(f"NOT contains(lower(item_name), '{_quoted(part)}')" for part in BAD_NAME_PARTS),
        f"NOT starts_with(lower(item_name), '{BAD_NAME_OPENING}')",
        "NOT regexp_matches(item_name, '[0-9]')",
    ]
)


@register(
    "a3_good_names",
    b.with_ctes(f"SELECT src, a, b, item_name FROM named WHERE {_GOOD_NAME}", b.LINES,
                "named AS (SELECT src, a, b, text AS item_name FROM all_lines)"),
)
def _(spark, sf):
    named = b.all_lines(spark, sf).withColumnRenamed("text", "item_name")
    return counts.filter_item_names(named)


@register(
    "a3_name_filter_with_condition",
    "SELECT p_partkey AS item_id, p_name AS item_name FROM part WHERE p_name LIKE '%bolt%'",
)
def _(spark, sf):
    return counts.filter_item_names(b.items(spark, sf), "item_name LIKE '%bolt%'")


for _name in ("min", "max", "avg"):

    def _basket_scores(spark, sf, score=_name):
        return _scores(spark, sf, score).withColumn("score", F.round("score", 6))

    register(
        f"a4_basket_score_{_name}",
        b.with_ctes(
            f"SELECT basket_id, round({_name}(count), 6) AS score FROM edges JOIN counts "
            "USING (item_id) GROUP BY basket_id",
            b.ITEMS, b.EDGES, _COUNTS,
        ),
    )(_basket_scores)


@register(
    "a4_score_histogram",
    b.with_ctes("SELECT score, count(*) AS n FROM scores GROUP BY score",
                b.ITEMS, b.EDGES, _COUNTS, _SCORES),
)
def _(spark, sf):
    return counts.score_histogram(_scores(spark, sf))


def _quantile(fraction: str, scores: str = "scores", rows: str | None = None) -> str:
    """Smallest score whose running count reaches ceil((1 - fraction) N)."""
    rows = rows or f"(SELECT count(*) FROM {scores})"
    return (
        f"(SELECT min(score) FROM (SELECT score, sum(count(*)) OVER (ORDER BY score) AS upto "
        f"FROM {scores} GROUP BY score) AS h WHERE upto >= greatest(1, "
        f"ceil((1.0::DOUBLE - {fraction}) * {rows})))"
    )


@register(
    "a5_threshold_exact",
    b.with_ctes(
        "SELECT f AS fraction, CASE f "
        + " ".join(f"WHEN {f} THEN {_quantile(str(f) + '::DOUBLE')}" for f in (0.1, 0.5, 0.9))
        + " END AS threshold FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(f)",
        b.ITEMS, b.EDGES, _COUNTS, _SCORES,
    ),
)
def _(spark, sf):
    histogram = counts.score_histogram(_scores(spark, sf)).persist()
    rows = [(f, counts.exact_threshold(histogram, f)) for f in (0.1, 0.5, 0.9)]
    histogram.unpersist()
    return spark.createDataFrame(rows, "fraction double, threshold long")


# the same halving, one row per step
_HALVING = """WITH RECURSIVE {ctes}, span AS (SELECT min(score) AS low, max(score) AS high,
    count(*) AS total, CAST(floor(count(*) * 0.4) AS BIGINT) AS wanted FROM scores),
walk(i, threshold, step, up) AS (
    SELECT 0, low // 2, (high - low) // 4, true FROM span
    UNION ALL
    SELECT i + 1, t, step // 2, (SELECT count(*) FROM scores WHERE score >= t) > wanted
    FROM (SELECT i, step, threshold + CASE WHEN up THEN step ELSE -step END AS t
          FROM walk WHERE step > 0) AS w, span)
SELECT max_by(threshold, i) AS threshold FROM walk"""


@register(
    "a5_threshold_halving",
    _HALVING.format(ctes=", ".join([b.ITEMS, b.EDGES, _COUNTS, _SCORES])),
)
def _(spark, sf):
    histogram = counts.score_histogram(_scores(spark, sf)).persist()
    found = counts.halving_threshold(histogram, 0.4)
    histogram.unpersist()
    return spark.createDataFrame([(found,)], "threshold long")


@register(
    "a6_baskets_above_threshold",
    b.with_ctes(
        "SELECT basket_id, basket_name FROM baskets JOIN scores USING (basket_id) "
        "WHERE score > 25",
        b.BASKETS, b.ITEMS, b.EDGES, _COUNTS, _SCORES,
    ),
)
def _(spark, sf):
    return counts.baskets_above(b.baskets(spark, sf), _scores(spark, sf), 25)


@register(
    "a7_edges_of_kept_baskets",
    b.with_ctes(
        "SELECT edge_id, basket_id, item_id, quantity FROM edges WHERE basket_id IN "
        "(SELECT basket_id FROM scores WHERE score > 25)",
        b.ITEMS, b.EDGES, _COUNTS, _SCORES,
    ),
)
def _(spark, sf):
    kept = counts.baskets_above(b.baskets(spark, sf), _scores(spark, sf), 25)
    return counts.restrict_edges(b.edges(spark, sf), kept)


_ROUNDS = 5


def _core_sql(last: str) -> str:
    """Rounds to a quarter of the baskets, each by the same share of what it starts from."""

    def chain(i: int) -> str:
        edges, held = ("edges", "counts0") if i == 1 else (f"e{i - 1}", f"c{i - 1}")
        frame = "baskets" if i == 1 else f"b{i - 1}"
        wanted = f"(SELECT (SELECT count(*) FROM baskets) // 4 / (SELECT count(*) FROM {frame}))"
        left = _ROUNDS - i + 1
        fraction = wanted if left == 1 else f"pow({wanted}, 1.0::DOUBLE / {left})"
        return f"""s{i} AS MATERIALIZED (SELECT basket_id, min(count) AS score FROM {edges}
            JOIN {held} USING (item_id) GROUP BY basket_id),
        t{i} AS MATERIALIZED (SELECT {_quantile(fraction, f's{i}')} AS t),
        b{i} AS MATERIALIZED (SELECT f.* FROM {frame} f JOIN s{i} USING (basket_id), t{i}
            WHERE score > t),
        e{i} AS MATERIALIZED (SELECT * FROM {edges} WHERE basket_id IN
            (SELECT basket_id FROM b{i})),
        c{i} AS MATERIALIZED (SELECT item_id, count(*) AS count FROM {held} JOIN e{i}
            USING (item_id) GROUP BY item_id)"""

    start = "counts0 AS (SELECT item_id, count(*) AS count FROM items JOIN edges USING (item_id) GROUP BY item_id)"
    rounds = [chain(i) for i in range(1, _ROUNDS + 1)]
    return b.with_ctes(last, b.BASKETS, b.ITEMS, b.EDGES, start, *rounds)


def core_rounds(spark, sf, rounds=_ROUNDS, mode="exact"):
    baskets = b.baskets(spark, sf)
    wanted = baskets.count() // 4
    return core.extract_core(
        spark, baskets, _counts(spark, sf), b.edges(spark, sf), wanted, rounds, mode=mode
    )


@register(
    "a8_core_rounds",
    _core_sql(
        " UNION ALL ".join(
            f"SELECT {i}::INT AS round, (SELECT count(*) FROM b{i}) AS baskets, "
            f"(SELECT count(*) FROM e{i}) AS edges, (SELECT count(*) FROM c{i}) AS items, "
            f"(SELECT t::DOUBLE FROM t{i}) AS threshold"
            for i in range(1, _ROUNDS + 1)
        )
    ),
)
def _(spark, sf):
    return core_rounds(spark, sf).rounds


@register("a8_core_baskets", _core_sql(f"SELECT basket_id, basket_name FROM b{_ROUNDS}"))
def _(spark, sf):
    return core_rounds(spark, sf).baskets


@register("a8_core_halving_rounds")
def _(spark, sf):
    return core_rounds(spark, sf, mode="halving").rounds


@register(
    "a9_sets_per_key",
    "SELECT p_name, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands "
    "FROM part GROUP BY p_name",
)
def _(spark, sf):
    sets = multimap(b.table(spark, sf, "part"), "p_name", "p_brand")
    return sets.select("p_name", F.array_join("values", "|").alias("brands"))


@register("a10_distinct", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def _(spark, sf):
    return b.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()


@register(
    "k5_nested_baskets",
    b.with_ctes(
        "SELECT basket_id, basket_name AS title, "
        "coalesce((SELECT string_agg(item_name, '|' ORDER BY item_name) FROM edges e "
        "JOIN items USING (item_id) WHERE e.basket_id = baskets.basket_id), '') AS ingredients "
        "FROM baskets",
        b.BASKETS, b.ITEMS, b.EDGES,
    ),
)
def _(spark, sf):
    nested = nested_baskets(b.baskets(spark, sf), b.items(spark, sf), b.edges(spark, sf))
    return nested.withColumn("ingredients", F.array_join("ingredients", "|"))


@register("r7_row_count", 'SELECT count(*) AS "rows" FROM lineitem')
def _(spark, sf):
    return quality.row_count(b.table(spark, sf, "lineitem"))


@register(
    "r8_vocabulary_status",
    b.with_ctes(
        "SELECT count(*) AS length, count(*) FILTER (valid = 1) AS valid, "
        "count(*) FILTER (valid = 0) AS unknown, count(*) FILTER (valid = -1) AS invalid "
        "FROM vocabulary",
        b.VOCABULARY,
    ),
)
def _(spark, sf):
    return quality.vocabulary_status(b.vocabulary(spark, sf))


@register(
    "r9_leading_alphanumeric",
    b.with_ctes("SELECT * FROM all_lines WHERE regexp_matches(text, '^[a-zA-Z0-9]')", b.LINES),
)
def _(spark, sf):
    return quality.leading_alphanumeric(b.all_lines(spark, sf), "text")


@register(
    "r10_name_lengths",
    b.with_ctes(
        "SELECT src, a, b, len(string_split(text, ' ')) AS n_tokens, length(text) AS n_chars "
        "FROM all_lines",
        b.LINES,
    ),
)
def _(spark, sf):
    return b.all_lines(spark, sf).select(
        "src",
        "a",
        "b",
        F.size(F.split("text", " ", -1)).cast("long").alias("n_tokens"),
        F.length("text").cast("long").alias("n_chars"),
    )


@register(
    "q1_duplicate_names",
    b.with_ctes(
        "SELECT item_name, count(*) AS count FROM items GROUP BY item_name HAVING count(*) > 1",
        b.ITEMS,
    ),
)
def _(spark, sf):
    return quality.duplicate_keys(b.items(spark, sf), ["item_name"])


@register(
    "q2_orphan_edges",
    b.with_ctes(
        "SELECT edge_id, basket_id, item_id, quantity FROM edges WHERE item_id NOT IN "
        "(SELECT p_partkey FROM part WHERE p_size <= 40)",
        b.EDGES,
    ),
)
def _(spark, sf):
    small = b.table(spark, sf, "part").where("p_size <= 40")
    return quality.orphans(b.edges(spark, sf), "item_id", small, "p_partkey")


@register(
    "q3_trailing_space",
    b.with_ctes("SELECT * FROM all_lines WHERE text LIKE '% '", b.LINES),
)
def _(spark, sf):
    return quality.trailing_space(b.all_lines(spark, sf), "text")


@register(
    "l2_random_baskets",
    "SELECT o_orderkey AS basket_id FROM orders "
    "ORDER BY ('0x' || substr(md5('7|' || o_orderkey), 1, 8))::BIGINT, o_orderkey LIMIT 10",
)
def _(spark, sf):
    return random_rows(b.baskets(spark, sf).select("basket_id"), ["basket_id"], 10, seed=7)


@register(
    "l2_random_basket_of_item",
    "SELECT l_orderkey AS basket_id FROM lineitem WHERE l_partkey = 3 "
    "ORDER BY ('0x' || substr(md5('7|' || l_orderkey), 1, 8))::BIGINT, l_orderkey LIMIT 1",
)
def _(spark, sf):
    rows = b.edges(spark, sf).where("item_id = 3").select("basket_id")
    return random_rows(rows, ["basket_id"], 1, seed=7)


@register(
    "l3_two_key_sort",
    b.with_ctes(
        "SELECT name, CAST(valid AS INT) AS valid, id, "
        "row_number() OVER (ORDER BY valid, id, name) AS place FROM vocabulary",
        b.VOCABULARY,
    ),
)
def _(spark, sf):
    ranked = dense_ids(b.vocabulary(spark, sf), ["valid", "id", "name"], "place")
    return ranked.select("name", F.col("valid").cast("int").alias("valid"), "id", "place")
