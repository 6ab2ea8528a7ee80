"""The check tables in their roles, once as frames and once as SQL common table expressions.

baskets = orders, items = part (64 names over many parts), edges = lineitem.  Lines of text are
composed from a line item and its part, and taken from the documents line by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.runtime import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("basket_id"),
        F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderpriority").alias("basket_name"),
    )


BASKETS = """baskets AS (SELECT o_orderkey AS basket_id,
    concat_ws(' ', 'order', o_orderkey, o_orderpriority) AS basket_name FROM orders)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name")
    )


ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS item_name FROM part)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
        F.col("l_orderkey").alias("basket_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").alias("quantity"),
    )


EDGES = """edges AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS basket_id,
    l_partkey AS item_id, l_quantity AS quantity FROM lineitem)"""


def named_items(spark: SparkSession, sf: str) -> DataFrame:
    """One item per name: the smallest part key stands for the name."""
    return (
        items(spark, sf)
        .groupBy("item_name")
        .agg(F.min("item_id").alias("item_id"))
        .select("item_id", "item_name")
    )


NAMED_ITEMS = """named_items AS (SELECT min(p_partkey) AS item_id, p_name AS item_name
    FROM part GROUP BY p_name)"""


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A working vocabulary with valid (1), unknown (0) and invalid (-1) names and some new ones."""
    per_name = table(spark, sf, "part").groupBy("p_name").agg(
        F.count("*").alias("count"), F.min("p_size").alias("s"), F.max("p_partkey").alias("id")
    )
    per_brand = table(spark, sf, "part").groupBy(
        F.concat_ws(" ", F.lower("p_brand"), "p_name").alias("p_name")
    ).agg(F.count("*").alias("count"), F.min("p_size").alias("s"), F.max("p_partkey").alias("id"))
    names = per_name.unionByName(per_brand.withColumn("id", F.col("id") + 1_000_000))
    return names.select(
        F.col("p_name").alias("name"),
        "id",
        "count",
        F.length("p_name").alias("length"),
        (F.pmod(F.col("s") + F.col("id"), F.lit(3)) - 1).cast("tinyint").alias("valid"),
    )


VOCABULARY = """vocabulary AS (SELECT p_name AS name, id, n AS count, length(p_name) AS length,
    CAST((s + id) % 3 - 1 AS TINYINT) AS valid FROM (
    SELECT p_name, max(p_partkey) AS id, count(*) AS n, min(p_size) AS s FROM part GROUP BY p_name
    UNION ALL
    SELECT lower(p_brand) || ' ' || p_name, max(p_partkey) + 1000000, count(*), min(p_size)
    FROM part GROUP BY 1))"""


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Measure phrases (src, a, b, text) composed from line items and their parts."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    line = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return line.select(
        F.lit("line").alias("src"),
        F.col("l_orderkey").alias("a"),
        F.expr(
            "(l_partkey * 100000 + l_suppkey) * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT)"
        ).alias("b"),
        F.expr(_LINE_TEXT).alias("text"),
    )


# valid in both engines
_Q = "CAST(l_quantity AS INT)"
_LINE_TEXT = f"""concat(
    CASE l_orderkey % 6 WHEN 0 THEN concat({_Q}, ' 1/2') WHEN 1 THEN concat({_Q}, '-', {_Q} + 2)
        WHEN 2 THEN concat({_Q}, ' to ', {_Q} + 1) WHEN 3 THEN concat({_Q} % 9, ' 12')
        WHEN 4 THEN concat('Possibly ', {_Q}) ELSE concat({_Q}, '') END, ' ',
    CASE l_linenumber WHEN 1 THEN 'cup' WHEN 2 THEN 'tablespoons' WHEN 3 THEN '(14 ounce) can'
        WHEN 4 THEN 'Ounces' WHEN 5 THEN 'large' WHEN 6 THEN '12-oz. bottle' ELSE 'tsp.' END, ' ',
    p_name,
    CASE WHEN l_returnflag = 'R' THEN concat(' (about ', {_Q} + 1, ' g)') ELSE '' END, ', ',
    lower(p_type),
    CASE WHEN l_orderkey % 7 = 0 THEN concat(' or ', {_Q}, ' cups ', p_brand)
         WHEN l_orderkey % 7 = 1 THEN ' or none' ELSE '' END)"""


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.lit("doc").alias("src"),
        F.col("doc_id").alias("a"),
        F.posexplode(F.split("text", "\n", -1)).alias("b", "text"),
    ).withColumn("b", F.col("b").cast("long"))


def all_lines(spark: SparkSession, sf: str) -> DataFrame:
    return order_lines(spark, sf).unionByName(document_lines(spark, sf))


LINES = f"""all_lines AS (
    SELECT 'line' AS src, l_orderkey AS a, (l_partkey * 100000 + l_suppkey) * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS b,
        {_LINE_TEXT} AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL
    SELECT 'doc', doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1,
        unnest(string_split(text, chr(10))) FROM documents)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lower-case words of the documents, part names, their plurals and hyphened forms."""
    # splitting text costs far more than moving it
    found = spread(table(spark, sf, "documents")).select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("name")
    )
    part = table(spark, sf, "part").select(
        F.explode(
            F.array(
                F.col("p_name"),
                F.concat("p_name", F.lit("s")),
                F.replace("p_name", F.lit(" "), F.lit("-")),
                F.replace("p_name", F.lit(" "), F.lit("  ")),
                F.replace("p_name", F.lit(" "), F.lit("")),
                F.substring_index("p_name", " ", -1),
                F.concat(F.lit("new "), "p_name"),
                F.concat(F.lower("p_type"), F.lit(" "), "p_name"),
            )
        ).alias("name")
    )
    return found.distinct().unionByName(part.distinct()).distinct()


WORDS = """words AS (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM documents
    UNION SELECT p_name FROM part
    UNION SELECT p_name || 's' FROM part
    UNION SELECT replace(p_name, ' ', '-') FROM part
    UNION SELECT replace(p_name, ' ', '  ') FROM part
    UNION SELECT replace(p_name, ' ', '') FROM part
    UNION SELECT string_split(p_name, ' ')[-1] FROM part
    UNION SELECT 'new ' || p_name FROM part
    UNION SELECT lower(p_type) || ' ' || p_name FROM part)"""


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"
