"""Basket, item and edge tables built from documents made of orders."""

from __future__ import annotations

from basketloom.catalog import bindings as b
from basketloom.catalog import line_sql as ls
from basketloom.catalog.line_parsing import order_documents
from basketloom.catalog.registry import register
from basketloom.operators import star
from basketloom.operators.lines import parse_documents, route_documents
from basketloom.runtime import Scratch, dense_ids

_PARTOF = "dataset:orders"
# the check asks for keys of this length, as the rule of the tables is
_LONGEST = 128
_ACCEPTED = "NOT (a % 7 <> 0 AND a % 11 = 0)"
# lines of accepted documents, and the readings chosen for them; other lines stay as they are
_SOURCE = """source AS (SELECT src, a, b, text FROM all_lines
    WHERE src = 'line' AND NOT (a % 7 <> 0 AND a % 11 = 0))"""
_READ = """readings AS (SELECT p.*, n.text AS line_text, coalesce(split, false) AS split
    FROM parsed p JOIN normal n USING (src, a, b) LEFT JOIN agreed g USING (src, a, b)
    WHERE CASE WHEN split THEN p.k >= 1 ELSE p.k = 0 END)"""
_UNREAD = f"""unread AS (SELECT * FROM all_lines WHERE src = 'line' AND NOT {_ACCEPTED}
    UNION ALL SELECT DISTINCT 'line', l_orderkey AS a, -1, 'Possibly equipment: none'
    FROM lineitem WHERE NOT {_ACCEPTED.replace("a %", "l_orderkey %")})"""
_NAMES = """names AS (SELECT left(lower(name), 128) AS item_name FROM readings
    UNION SELECT left(lower(text), 128) FROM unread)"""
_DIMS = """item_dim AS (SELECT item_name, row_number() OVER (ORDER BY item_name) AS item_id
    FROM names),
    basket_dim AS (SELECT lid, row_number() OVER (ORDER BY lid) AS basket_id FROM (
        SELECT DISTINCT l_orderkey::VARCHAR AS lid FROM lineitem))"""


def _parsed(spark, sf):
    """The lines of all documents, parsed once; rejected ones keep their lines unread."""
    return Scratch(spark, "parsed").keep(parse_documents(order_documents(spark, sf), by_line=["id"]))


def _lines_sql(body: str) -> str:
    return b.with_ctes(body, b.LINES, _SOURCE, ls.PARSED, _READ, _UNREAD, _NAMES, _DIMS)


@register(
    "r1_basket_dimension",
    f"""SELECT row_number() OVER (ORDER BY lid) AS basket_id, 'order ' || lid AS basket_name,
    'orders/' || lid AS source, '{_PARTOF}' AS partof, lid FROM (
    SELECT DISTINCT l_orderkey::VARCHAR AS lid FROM lineitem)""",
)
def _(spark, sf):
    return star.basket_dimension(order_documents(spark, sf), _PARTOF)


@register(
    "r2_dense_ids",
    "SELECT item_name, row_number() OVER (ORDER BY item_name) AS item_id FROM "
    "(SELECT DISTINCT p_brand || ' ' || p_name AS item_name FROM part)",
)
def _(spark, sf):
    part = b.table(spark, sf, "part")
    names = part.selectExpr("p_brand || ' ' || p_name AS item_name").distinct()
    return dense_ids(names, ["item_name"], "item_id")


@register("r3_item_dimension", _lines_sql("SELECT item_id, item_name FROM item_dim"))
def _(spark, sf):
    lines = parse_documents(order_documents(spark, sf), by_line=["id"])
    return star.item_dimension(star.item_names(lines, _LONGEST))


@register(
    "r4_edge_fact",
    _lines_sql(
        "SELECT basket_id, item_id, quantity_low, quantity_high, unit, s.text FROM readings r "
        "JOIN source s USING (src, a, b) JOIN item_dim ON item_name = left(lower(name), 128) "
        "JOIN basket_dim ON lid = a::VARCHAR WHERE k = CASE WHEN split THEN 1 ELSE 0 END "
        "UNION ALL SELECT basket_id, item_id, NULL, NULL, NULL, text FROM unread "
        "JOIN item_dim ON item_name = left(lower(text), 128) "
        "JOIN basket_dim ON lid = a::VARCHAR"
    ),
)
def _(spark, sf):
    lines = _parsed(spark, sf)
    scratch = Scratch(spark, "dims")
    baskets = scratch.keep(star.basket_dimension(order_documents(spark, sf), _PARTOF))
    items = scratch.keep(star.item_dimension(star.item_names(lines, _LONGEST)))
    return star.edge_fact(lines, baskets, items, _LONGEST).drop("edge_id")


@register(
    "r4_unresolved_lines",
    _lines_sql(
        "SELECT 'item' AS missing, item_name, count(*) AS lines FROM ("
        "SELECT left(lower(name), 128) AS item_name FROM readings "
        "WHERE k = CASE WHEN split THEN 1 ELSE 0 END "
        "UNION ALL SELECT left(lower(text), 128) FROM unread) "
        "WHERE item_name NOT IN (SELECT p_name FROM part) GROUP BY 1, 2"
    ),
)
def _(spark, sf):
    lines = _parsed(spark, sf)
    baskets = star.basket_dimension(order_documents(spark, sf), _PARTOF)
    known = b.named_items(spark, sf)
    missing = star.unresolved_lines(lines, baskets, known, _LONGEST)
    return missing.groupBy("missing", "item_name").count().withColumnRenamed("count", "lines")


def _equipment(spark, sf):
    # no field of an item line is needed
    routed = route_documents(order_documents(spark, sf)).drop("ingredients", "instructions")
    documents = Scratch(spark, "routed").keep(routed)
    baskets = Scratch(spark, "dims").keep(star.basket_dimension(documents, _PARTOF))
    return star.equipment_tables(documents, baskets, _LONGEST)


_GEAR = """gear AS (SELECT DISTINCT l_orderkey::VARCHAR AS lid, unnest(['rolling pin', '2 bowls'])
    AS text FROM lineitem WHERE l_orderkey % 7 = 0)"""


@register(
    "r5_equipment_dimension",
    b.with_ctes(
        "SELECT row_number() OVER (ORDER BY text) AS equipment_id, text AS equipment_name "
        "FROM (SELECT DISTINCT text FROM gear)",
        _GEAR,
    ),
)
def _(spark, sf):
    return _equipment(spark, sf)[0]


@register(
    "r5_required_equipment",
    b.with_ctes(
        # the piece's place among those of its document
        "SELECT basket_id * 16777216 + CASE text WHEN '2 bowls' THEN 1 ELSE 0 END AS id, basket_id, "
        "CASE text WHEN '2 bowls' THEN 1::BIGINT ELSE 2::BIGINT END "
        "AS equipment_id, text FROM gear JOIN basket_dim USING (lid)",
        _GEAR, "names AS (SELECT '' AS item_name)", _DIMS,
    ),
)
def _(spark, sf):
    return _equipment(spark, sf)[1]


@register(
    "r6_instruction_steps",
    b.with_ctes(
        "SELECT basket_id, 1::INT AS step, o_orderpriority AS text FROM orders "
        "JOIN basket_dim ON lid = o_orderkey::VARCHAR UNION ALL "
        "SELECT basket_id, 2::INT, o_orderstatus FROM orders "
        "JOIN basket_dim ON lid = o_orderkey::VARCHAR",
        "names AS (SELECT '' AS item_name)", _DIMS,
    ),
)
def _(spark, sf):
    documents = order_documents(spark, sf)
    return star.instruction_steps(documents, star.basket_dimension(documents, _PARTOF))
