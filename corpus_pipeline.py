"""The curation of ``documents`` as a chain of stages, each one operator over all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.llm import decontaminate, jaccard_join, packing, pii, quality_rules
from basketloom.llm.common import table
from basketloom.runtime import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# near copies in training text: shingles of so many words, similar by so many per cent
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge_quality(docs).where("kept").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once if it is repeated.

    Rows without an id come after all others, and rows that share an id are told apart by a number of
    their own, so exactly one row stays of every group.  A text without words is no copy of another.
    """
    scratch = Scratch(spark, "near-copies")
    # stored, so that the numbers are the same whenever they are read
    rows = scratch.keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    numbered = rows.select(F.col("_row").alias("doc_id"), "text")
    groups = jaccard_join.jaccard_components(numbered, size=NEAR_WORDS, percent=NEAR_PERCENT)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "_row"))
    kept = (
        rows.select("_row", F.col("doc_id").alias("id"))
        .join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
        .groupBy("component_id")
        .agg(first.alias("first"))
        .select(F.col("first._row").alias("_row"))
    )
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a fair share of benchmark text."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.verdict(found).where("NOT contaminated").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    found = pii.find_personal_data(docs)
    text = pii.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(
        *COLUMNS
    )


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("near copies", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("personal data", redact_personal_data),
    ("packing", pack_documents),
]

# tokenizers cannot be called from SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``, every stage written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
