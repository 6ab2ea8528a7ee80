"""Curated vocabulary, validity and canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketloom.catalog import bindings as b
from basketloom.catalog.registry import register
from basketloom.operators import closure, curate, walk
from basketloom.plans.curation import sample
from basketloom.runtime import Scratch, number_within
from basketloom.sources.exports import nested_baskets
from basketloom.sources.tables import copy_table, read_table
from basketloom.sources.vocabulary import multimap

# validated items are the parts up to size 45
_VALIDATED = "validated AS (SELECT p_partkey AS item_id FROM part WHERE p_size <= 45)"
_VALID_BASKETS = """valid_baskets AS (SELECT DISTINCT basket_id FROM edges
    JOIN validated USING (item_id) WHERE basket_id NOT IN (
        SELECT basket_id FROM edges LEFT JOIN validated v ON v.item_id = edges.item_id
        WHERE v.item_id IS NULL))"""

# relations between neighbouring parts: chains of aliases that end where p_size is a multiple of 5
_RELATIONS = """relations AS (
    SELECT p_partkey AS subject_id, 'alias:plural-of' AS predicate, p_partkey + 1 AS object_id
    FROM part WHERE p_size % 5 <> 0 AND p_partkey + 1 < (SELECT count(*) FROM part)
    UNION ALL SELECT p_partkey, 'alias:spacing', p_partkey + 2 FROM part
    WHERE p_size % 5 = 1 AND p_partkey + 2 < (SELECT count(*) FROM part)
    UNION ALL SELECT p_partkey + 1, 'alias:singular-of', p_partkey FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, 'child-of:starts-with:red', p_partkey + 3 FROM part
    UNION ALL SELECT p_partkey, 'alias:hypenation', p_partkey FROM part WHERE p_size % 4 = 0)"""
_ALIAS_MAP = """alias_map AS (SELECT subject_id, min(object_id) AS object_id FROM relations
    WHERE predicate LIKE 'alias:%' AND predicate NOT LIKE 'alias:singular-of%'
    AND subject_id <> object_id GROUP BY subject_id)"""
_CLOSED = """steps(subject_id, object_id) AS (
    SELECT subject_id, object_id FROM alias_map
    UNION SELECT s.subject_id, m.object_id FROM steps s JOIN alias_map m
    ON m.subject_id = s.object_id),
    closed AS (SELECT subject_id, object_id FROM steps
        WHERE object_id NOT IN (SELECT subject_id FROM alias_map))"""
_CANONICAL = """canonical AS (SELECT item_id, coalesce(object_id, item_id) AS canonical_id
    FROM validated LEFT JOIN closed ON subject_id = item_id)"""
_CANONICAL_EDGES = """canonical_edges AS (SELECT DISTINCT edge_id, basket_id, canonical_id
    FROM valid_baskets JOIN edges USING (basket_id) JOIN canonical USING (item_id))"""
_ALL = (
    b.BASKETS, b.ITEMS, b.EDGES, _VALIDATED, _VALID_BASKETS, _RELATIONS, _ALIAS_MAP, _CLOSED,
    _CANONICAL, _CANONICAL_EDGES,
)


def _recursive(body: str, *ctes: str) -> str:
    return b.with_ctes(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def validated(spark, sf):
    return b.table(spark, sf, "part").where("p_size <= 45").select(F.col("p_partkey").alias("item_id"))


def relations(spark, sf):
    part = b.table(spark, sf, "part").select("p_partkey", "p_size")
    n = part.count()

    def some(condition, predicate, subject, obj):
        return part.where(condition).select(
            F.expr(subject).alias("subject_id"),
            F.lit(predicate).alias("predicate"),
            F.expr(obj).alias("object_id"),
        )

    return (
        some(f"p_size % 5 <> 0 AND p_partkey + 1 < {n}", "alias:plural-of", "p_partkey", "p_partkey + 1")
        .unionByName(some(f"p_size % 5 = 1 AND p_partkey + 2 < {n}", "alias:spacing", "p_partkey", "p_partkey + 2"))
        .unionByName(some("p_size % 3 = 0", "alias:singular-of", "p_partkey + 1", "p_partkey"))
        .unionByName(some("true", "child-of:starts-with:red", "p_partkey", "p_partkey + 3"))
        .unionByName(some("p_size % 4 = 0", "alias:hypenation", "p_partkey", "p_partkey"))
    )


def valid_baskets(spark, sf):
    return curate.validated_baskets(b.edges(spark, sf), validated(spark, sf))


def canonical(spark, sf):
    return closure.canonical_items_job(
        relations(spark, sf), validated(spark, sf), b.items(spark, sf)
    )


def canonical_edges(spark, sf):
    return curate.canonical_edges(
        b.edges(spark, sf), valid_baskets(spark, sf), canonical(spark, sf)
    )


@register(
    "j1_new_valid_items",
    b.with_ctes(
        "SELECT id AS item_id, name AS item_name FROM vocabulary WHERE valid = 1 AND name NOT IN "
        "(SELECT item_name FROM named_items)",
        b.VOCABULARY, b.NAMED_ITEMS,
    ),
)
def _(spark, sf):
    return curate.new_valid_items(b.vocabulary(spark, sf), b.named_items(spark, sf))


@register(
    "k3_append_if_new",
    b.with_ctes(
        "SELECT min(id) AS id, name FROM vocabulary WHERE name NOT IN "
        "(SELECT item_name FROM named_items) GROUP BY name",
        b.VOCABULARY, b.NAMED_ITEMS,
    ),
)
def _(spark, sf):
    target = b.named_items(spark, sf).withColumnRenamed("item_name", "name")
    return curate.append_new(target, b.vocabulary(spark, sf).select("id", "name"), "name")


@register(
    "j2_validated_items",
    b.with_ctes(
        "SELECT id AS item_id FROM vocabulary WHERE valid = 1 AND name IN "
        "(SELECT item_name FROM named_items)",
        b.VOCABULARY, b.NAMED_ITEMS,
    ),
)
def _(spark, sf):
    return curate.validated_items(b.vocabulary(spark, sf), b.named_items(spark, sf))


@register(
    "j3_corrected_ids",
    b.with_ctes(
        "SELECT name, coalesce(item_id, id) AS id, count, CAST(valid AS INT) AS valid "
        "FROM vocabulary LEFT JOIN named_items ON item_name = name",
        b.VOCABULARY, b.NAMED_ITEMS,
    ),
)
def _(spark, sf):
    fixed = curate.correct_ids(b.vocabulary(spark, sf), b.named_items(spark, sf))
    return fixed.select("name", "id", "count", F.col("valid").cast("int").alias("valid"))


_TRIPLES = """triples AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS subject,
    'child-of:starts-with:' || lower(p_type) AS relation, p_name AS object FROM part
    UNION ALL SELECT DISTINCT p_name, 'alias:reverse',
    string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] FROM part
    UNION ALL SELECT DISTINCT p_name, 'related', 'red widget' FROM part)"""


def triples(spark, sf):
    part = b.table(spark, sf, "part")
    swapped = F.concat_ws(
        " ", F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    )
    typed = part.select(
        F.concat_ws(" ", F.lower("p_type"), "p_name").alias("subject"),
        F.concat(F.lit("child-of:starts-with:"), F.lower("p_type")).alias("relation"),
        F.col("p_name").alias("object"),
    )
    reverse = part.select("p_name", F.lit("alias:reverse"), swapped)
    related = part.select("p_name", F.lit("related"), F.lit("red widget"))
    return typed.distinct().union(reverse.distinct()).union(related.distinct())


@register(
    "j4_relation_ids",
    b.with_ctes(
        "SELECT s.item_id AS subject_id, relation AS predicate, o.item_id AS object_id "
        "FROM triples JOIN ok s ON s.item_name = subject JOIN ok o ON o.item_name = object",
        _TRIPLES, b.NAMED_ITEMS, _VALIDATED,
        "ok AS (SELECT * FROM named_items WHERE item_id IN (SELECT item_id FROM validated))",
    ),
)
def _(spark, sf):
    return curate.relation_ids(triples(spark, sf), validated(spark, sf), b.named_items(spark, sf))


@register(
    "j5_validated_baskets",
    b.with_ctes("SELECT basket_id FROM valid_baskets", b.EDGES, _VALIDATED, _VALID_BASKETS),
)
def _(spark, sf):
    return valid_baskets(spark, sf)


@register(
    "j6_named_alias_edges",
    b.with_ctes(
        "SELECT subject_id, s.item_name AS subject_name, predicate, object_id, "
        "o.item_name AS object_name FROM relations LEFT JOIN items s ON s.item_id = subject_id "
        "LEFT JOIN items o ON o.item_id = object_id WHERE predicate LIKE 'alias:%' "
        "AND predicate NOT LIKE 'alias:singular-of%' AND subject_id <> object_id",
        b.ITEMS, _RELATIONS,
    ),
)
def _(spark, sf):
    return curate.named_alias_edges(relations(spark, sf), b.items(spark, sf))


@register(
    "j6_alias_map",
    b.with_ctes("SELECT * FROM alias_map", _RELATIONS, _ALIAS_MAP),
)
def _(spark, sf):
    return curate.alias_map(curate.named_alias_edges(relations(spark, sf), b.items(spark, sf)))


@register(
    "g13_alias_closure",
    _recursive("SELECT * FROM closed", _RELATIONS, _ALIAS_MAP, _CLOSED),
)
def _(spark, sf):
    edges = curate.named_alias_edges(relations(spark, sf), b.items(spark, sf))
    return closure.close_mapping(curate.alias_map(edges)).mapping


@register(
    "g14_cycle_members",
    "SELECT p_partkey AS subject_id, p_name AS item_name FROM part "
    "WHERE p_brand IN ('Brand#1', 'Brand#7')",
)
def _(spark, sf):
    # brands form rings of many lengths; two of them are closed
    scratch = Scratch(spark, "rings")
    part = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("subject_id"), F.col("p_brand").alias("brand")
    )
    placed = scratch.keep(number_within(part, ["brand"], ["subject_id"]))
    sizes = placed.groupBy("brand").agg(F.count("*").alias("size"))
    to = placed.select("brand", F.col("pos").alias("_to"), F.col("subject_id").alias("object_id"))
    ring = (
        placed.join(sizes, "brand")
        .withColumn(
            "_to",
            F.when(
                F.col("brand").isin("Brand#1", "Brand#7"),
                F.pmod(F.col("pos") + 1, F.col("size")),
            ).otherwise(F.col("pos") + 1),
        )
        .join(to, ["brand", "_to"])
        .select("subject_id", "object_id")
    )
    members = closure.cycle_members(ring)
    return closure.named_cycles(members, b.items(spark, sf))


@register("j7_canonical_map", _recursive("SELECT * FROM canonical", *_ALL[1:9]))
def _(spark, sf):
    return canonical(spark, sf)


@register("j8_canonical_edges", _recursive("SELECT * FROM canonical_edges", *_ALL))
def _(spark, sf):
    return canonical_edges(spark, sf)


@register(
    "j9_canonical_baskets",
    _recursive(
        "SELECT DISTINCT basket_id FROM canonical_edges JOIN valid_baskets USING (basket_id)", *_ALL
    ),
)
def _(spark, sf):
    return curate.canonical_baskets(canonical_edges(spark, sf), valid_baskets(spark, sf))


@register(
    "j10_canonical_items",
    _recursive(
        "SELECT DISTINCT item_id FROM canonical_edges JOIN validated ON canonical_id = item_id",
        *_ALL,
    ),
)
def _(spark, sf):
    return curate.canonical_items(canonical_edges(spark, sf), validated(spark, sf))


@register(
    "j11_canonical_edge_list",
    _recursive("SELECT basket_id, canonical_id FROM canonical_edges", *_ALL),
)
def _(spark, sf):
    return curate.canonical_edge_list(canonical_edges(spark, sf))


@register(
    "j12_validated_item_names",
    b.with_ctes("SELECT item_id, item_name FROM validated JOIN items USING (item_id)",
                b.ITEMS, _VALIDATED),
)
def _(spark, sf):
    return curate.validated_item_names(validated(spark, sf), b.items(spark, sf))


@register(
    "j13_validated_basket_titles",
    b.with_ctes(
        "SELECT basket_id, basket_name FROM valid_baskets JOIN baskets USING (basket_id)",
        b.BASKETS, b.EDGES, _VALIDATED, _VALID_BASKETS,
    ),
)
def _(spark, sf):
    return curate.validated_basket_titles(valid_baskets(spark, sf), b.baskets(spark, sf))


@register(
    "j14_basket_details",
    _recursive(
        "SELECT DISTINCT basket_id, basket_name, canonical_id, item_name FROM canonical_edges "
        "JOIN baskets USING (basket_id) JOIN items ON item_id = canonical_id",
        *_ALL,
    ),
)
def _(spark, sf):
    return curate.basket_details(
        canonical_edges(spark, sf), b.baskets(spark, sf), b.items(spark, sf)
    )


_KNOWN = """known AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40
    UNION SELECT DISTINCT p_name || ' mix' FROM part)"""


def known_names(spark, sf):
    part = b.table(spark, sf, "part")
    return (
        part.where("p_size > 40")
        .select(F.col("p_name").alias("name"))
        .unionByName(part.select(F.concat("p_name", F.lit(" mix")).alias("name")))
        .distinct()
    )


@register(
    "j15_marked_valid",
    b.with_ctes(
        "SELECT name, id, CASE WHEN name IN (SELECT name FROM known) THEN 1 ELSE valid::INT END "
        "AS valid FROM vocabulary",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    marked, _ = curate.mark_known_valid(b.vocabulary(spark, sf), known_names(spark, sf))
    return marked.select("name", "id", F.col("valid").cast("int").alias("valid"))


@register(
    "j15_unmatched_names",
    b.with_ctes(
        "SELECT name FROM known WHERE name NOT IN (SELECT name FROM vocabulary)",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    return curate.mark_known_valid(b.vocabulary(spark, sf), known_names(spark, sf))[1]


@register(
    "j16_integrated_vocabulary",
    b.with_ctes(
        "SELECT name, id, CASE WHEN name IN (SELECT name FROM known) THEN 1 ELSE valid::INT END "
        "AS valid, count, length FROM vocabulary UNION ALL "
        "SELECT name, 10000000 + row_number() OVER (ORDER BY name), 0, 0, length(name) FROM known "
        "WHERE name NOT IN (SELECT name FROM vocabulary)",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    merged = curate.integrate_known(b.vocabulary(spark, sf), known_names(spark, sf))
    return merged.select(
        "name", "id", F.col("valid").cast("int").alias("valid"), "count",
        F.col("length").cast("long").alias("length"),
    )


@register(
    "j17_unique_names",
    "SELECT p_name AS name, p_partkey AS id, p_size % 3 - 1 AS valid FROM part "
    "QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size % 3, p_partkey) = 1",
)
def _(spark, sf):
    rows = b.table(spark, sf, "part").select(
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("id"),
        (F.col("p_size") % 3 - 1).alias("valid"),
    )
    return curate.drop_duplicate_names(rows)


# validity spreads from parts of size 7 along the closed alias chains and a child-of step of 7
_SPREAD = """vocab AS (SELECT p_partkey AS name, CASE WHEN p_size % 10 = 7 THEN 1
        WHEN p_size % 10 = 3 THEN -1 ELSE 0 END AS valid FROM part),
    links AS (SELECT p_partkey AS a, p_partkey + 1 AS t FROM part WHERE p_size % 2 = 0
        UNION SELECT p_partkey + 1, p_partkey FROM part WHERE p_size % 2 = 0
        UNION SELECT p_partkey + 7, p_partkey FROM part WHERE p_size % 3 = 0),
    reach(name) AS (SELECT name FROM vocab WHERE valid = 1
        UNION SELECT v.name FROM reach r JOIN links ON a = r.name
        JOIN vocab v ON v.name = t AND v.valid = 0)"""


@register(
    "g12_validity_propagation",
    _recursive(
        "SELECT CAST(name AS VARCHAR) AS name, CASE WHEN name IN (SELECT name FROM reach) THEN 1 "
        "ELSE valid END AS valid FROM vocab",
        _SPREAD,
    ),
)
def _(spark, sf):
    part = b.table(spark, sf, "part")
    vocab = part.select(
        F.col("p_partkey").cast("string").alias("name"),
        F.expr(
            "CAST(CASE WHEN p_size % 10 = 7 THEN 1 WHEN p_size % 10 = 3 THEN -1 ELSE 0 END AS TINYINT)"
        ).alias("valid"),
    )
    aliases = part.where("p_size % 2 = 0").select(
        F.col("p_partkey").cast("string").alias("alias"),
        (F.col("p_partkey") + 1).cast("string").alias("ingredient"),
    )
    childofs = part.where("p_size % 3 = 0").select(
        F.col("p_partkey").cast("string").alias("child"),
        (F.col("p_partkey") + 7).cast("string").alias("parent"),
    )
    spread = closure.propagate_validity(vocab, aliases, childofs)
    return spread.select("name", F.col("valid").cast("int").alias("valid"))


# walks: neighbours numbered in key order, draws by md5 prefixes
def _draw(step: str, purpose: str) -> str:
    return f"('0x' || substr(md5('5|' || walker || '|' || {step} || '|{purpose}'), 1, 8))::BIGINT"


_WALK = f"""pairs AS (SELECT l_orderkey AS basket_id, l_partkey AS canonical_id FROM lineitem),
    by_basket AS (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY canonical_id) - 1
        AS pos, count(*) OVER (PARTITION BY basket_id) AS degree FROM (SELECT DISTINCT * FROM pairs)),
    by_item AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY basket_id) - 1
        AS pos, count(*) OVER (PARTITION BY canonical_id) AS degree FROM pairs),
    starts AS (SELECT basket_id, row_number() OVER (ORDER BY
        ('0x' || substr(md5('5|' || basket_id), 1, 8))::BIGINT, basket_id) - 1 AS walker
        FROM (SELECT DISTINCT basket_id FROM pairs) QUALIFY walker < 8),
    visits(walker, step, start, basket_id) AS (
        SELECT walker, 0, basket_id, basket_id FROM starts
        UNION ALL
        SELECT w.walker, w.step, w.start, i.basket_id FROM (
            SELECT walker, step + 1 AS step, start, CASE WHEN {_draw('(step + 1)', 'restart')}
                < CAST(floor(0.1 * 4294967296) AS BIGINT) THEN start ELSE basket_id END AS here
            FROM visits WHERE step < 6) w
        JOIN by_basket b ON b.basket_id = w.here AND b.pos = {_draw('w.step', 'item')} % b.degree
        JOIN by_item i ON i.canonical_id = b.canonical_id
            AND i.pos = {_draw('w.step', 'basket')} % i.degree)"""


def _plain_edges(spark, sf):
    return b.edges(spark, sf).select("basket_id", F.col("item_id").alias("canonical_id"))


@register(
    "g16_random_walks",
    _recursive("SELECT walker, step, basket_id FROM visits", _WALK),
)
def _(spark, sf):
    visits = walk.walk_baskets(
        _plain_edges(spark, sf), n_samples=1_000_000, walkers=8, steps=6, seed=5
    )
    return visits.select("walker", "step", "basket_id")


@register("g16_sampled_baskets")
def _(spark, sf):
    edges = canonical_edges(spark, sf)
    visits = walk.walk_baskets(edges, n_samples=50, walkers=8, seed=1, shards=4)
    return walk.sampled_baskets(visits, 50)


@register("k7_sampled_subgraph")
def _(spark, sf):
    titles, pairs, names = sample(
        canonical_edges(spark, sf), b.baskets(spark, sf), b.items(spark, sf), 50, walkers=8,
        seed=1,
    )
    return nested_baskets(titles, names, pairs.withColumnRenamed("canonical_id", "item_id"))


_CHILDREN = """children AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS child,
    p_name AS parent FROM part UNION SELECT DISTINCT lower(p_type) || ' ' || p_name,
    string_split(p_name, ' ')[2] FROM part)"""


@register(
    "s4_child_of_multimap",
    b.with_ctes(
        "SELECT child, string_agg(parent, '|' ORDER BY parent) AS parents FROM children "
        "GROUP BY child",
        _CHILDREN,
    ),
)
def _(spark, sf):
    part = b.table(spark, sf, "part")
    child = F.concat_ws(" ", F.lower("p_type"), "p_name").alias("child")
    pairs = part.select(child, F.col("p_name").alias("parent")).unionByName(
        part.select(child, F.substring_index("p_name", " ", -1).alias("parent"))
    )
    return multimap(pairs, "child", "parent").select(
        "child", F.array_join("values", "|").alias("parents")
    )


@register("s7_table_scan", "SELECT p_partkey, p_name FROM part WHERE p_size < 10")
def _(spark, sf):
    return read_table(spark, f"{sf}/part.parquet").where("p_size < 10").select("p_partkey", "p_name")


@register("k2_table_copy", "SELECT * FROM part")
def _(spark, sf):
    target = f"{Scratch(spark, 'copy').base}/part"
    copy_table(spark, f"{sf}/part.parquet", target)
    return read_table(spark, target)


def _open_names(spark, sf):
    return b.vocabulary(spark, sf).where("valid = 0").select("name")


@register(
    "u1_vocabulary_union",
    b.with_ctes(
        "SELECT name FROM known UNION SELECT name FROM vocabulary WHERE valid = 0",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    return known_names(spark, sf).union(_open_names(spark, sf)).distinct()


@register(
    "u1_vocabulary_difference",
    b.with_ctes(
        "SELECT name, 'known' AS only_in FROM (SELECT name FROM known EXCEPT SELECT name FROM vocabulary) "
        "UNION ALL SELECT name, 'vocabulary' FROM (SELECT name FROM vocabulary EXCEPT SELECT name FROM known)",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    names, known = b.vocabulary(spark, sf).select("name"), known_names(spark, sf)
    return (
        known.subtract(names)
        .withColumn("only_in", F.lit("known"))
        .unionByName(names.subtract(known).withColumn("only_in", F.lit("vocabulary")))
    )


@register(
    "u1_vocabulary_membership",
    b.with_ctes(
        "SELECT name, name IN (SELECT name FROM known) AS is_known FROM vocabulary",
        b.VOCABULARY, _KNOWN,
    ),
)
def _(spark, sf):
    known = known_names(spark, sf).distinct().withColumn("_known", F.lit(True))
    return (
        b.vocabulary(spark, sf)
        .join(known, "name", "left")
        .select("name", F.coalesce("_known", F.lit(False)).alias("is_known"))
    )


@register(
    "u2_appended_frames",
    b.with_ctes(
        "SELECT name, id FROM vocabulary WHERE valid = 1 UNION ALL "
        "SELECT item_name, item_id FROM named_items",
        b.VOCABULARY, b.NAMED_ITEMS,
    ),
)
def _(spark, sf):
    valid = b.vocabulary(spark, sf).where("valid = 1").select("name", "id")
    named = b.named_items(spark, sf).select(
        F.col("item_name").alias("name"), F.col("item_id").alias("id")
    )
    return valid.unionByName(named)
