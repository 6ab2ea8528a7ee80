"""File formats as round trips: a given table is written, read with the reader, and returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketloom.catalog import bindings as b
from basketloom.catalog.clusters import PROFILE_SQL, given_profile, shown_profile
from basketloom.catalog.registry import register
from basketloom.runtime import Scratch
from basketloom.sources import documents, exports, vocabulary


def _folder(spark, name: str) -> str:
    return f"{Scratch(spark, name).base}/file"


@register(
    "s1_k1_documents",
    b.with_ctes(
        "SELECT id, count(*) AS lines, string_agg(text, '|' ORDER BY b, text) AS texts FROM ("
        "SELECT a::VARCHAR AS id, b, text FROM all_lines WHERE src = 'line' UNION ALL "
        "SELECT 'doc ' || a, b, text FROM all_lines WHERE src = 'doc') GROUP BY id",
        b.LINES,
    ),
)
def _(spark, sf):
    path = _folder(spark, "documents")
    source = F.when(F.col("src") == "doc", F.concat(F.lit("doc "), F.col("a"))).otherwise(F.col("a").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("b", "text")))
    texts = F.transform(lines, lambda line: F.struct(line["text"].alias("text")))
    rows = b.all_lines(spark, sf).groupBy(source.alias("id")).agg(texts.alias("ingredients"))
    # every file holds one outer list
    documents.write_document_lists(rows, path)
    read = documents.read_documents(spark, path)
    return read.select(
        "id",
        F.size("ingredients").cast("long").alias("lines"),
        F.array_join(F.transform("ingredients", lambda i: i["text"]), "|").alias("texts"),
    )


@register(
    "s2_k6_vocabulary",
    b.with_ctes("SELECT name, id, count, length::INT AS length, valid FROM vocabulary", b.VOCABULARY),
)
def _(spark, sf):
    path = _folder(spark, "vocabulary")
    vocabulary.write_vocabulary(b.vocabulary(spark, sf), path)
    return vocabulary.read_vocabulary(spark, path)


@register(
    "s3_abbreviations",
    "SELECT DISTINCT n_name AS abbreviation, n_name || ', \"' || n_nationkey || '\"' AS expansion FROM nation",
)
def _(spark, sf):
    path = _folder(spark, "abbreviations")
    nation = b.table(spark, sf, "nation")
    pairs = nation.select(
        F.col("n_name").alias("short"),
        F.concat("n_name", F.lit(', "'), F.col("n_nationkey").cast("string"), F.lit('"')).alias("long"),
    )
    vocabulary.write_vocabulary(pairs, path)
    return vocabulary.read_abbreviations(spark, path)


@register(
    "s4_child_of_file",
    "SELECT p_name AS child, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS parents "
    "FROM part GROUP BY p_name",
)
def _(spark, sf):
    path = _folder(spark, "child-of")
    part = b.table(spark, sf, "part").select(
        F.col("p_name").alias("child"), F.col("p_brand").alias("parent")
    )
    vocabulary.write_vocabulary(part, path)
    parents = vocabulary.multimap(vocabulary.read_child_of(spark, path), "child", "parent")
    return parents.select("child", F.array_join("values", "|").alias("parents"))


@register(
    "s5_triples",
    "SELECT p_name AS subject, 'made-by' AS relation, p_brand AS object FROM part",
)
def _(spark, sf):
    path = _folder(spark, "triples")
    rows = b.table(spark, sf, "part").select("p_name", F.lit("made-by").alias("r"), "p_brand")
    rows.write.csv(path)
    return vocabulary.read_triples(spark, path)


@register("k8_results", PROFILE_SQL)
def _(spark, sf):
    written = exports.write_results(given_profile(spark, sf), Scratch(spark, "results").base)
    return shown_profile(spark.read.parquet(written))
