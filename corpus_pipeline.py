"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before
kept, and returns the documents it keeps with all their columns; the last
returns the documents with their fitted rates.  ``run`` writes every stage's
result to the shared folder (``spark.checkpoint.dir``) as Parquet and gives it,
read again, to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import if_small, read_table, shared_table
from postlens.llm.op5_mixing import label_domains, mix
from postlens.llm.op6_quality import quality_filter
from postlens.llm.op7_lines import LineIndex
from postlens.llm.op8_benchmark import drop_leaks
from postlens.llm.op9_jaccard import jaccard_classes

#: Lines of so many documents go; near copies are at least so alike on five-word shingles.
MIN_DOCS = 10
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go from all of them; ``n_chars`` follows the text."""
    done = LineIndex.build(docs, MIN_DOCS).strip(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest key stays.

    Equal rows are one document.  Where one key has several texts, its rows go
    only if every one of them is a copy of a smaller key.
    """
    classes = jaccard_classes(docs.select("doc_id", "text"), SHINGLE, PERCENT)
    keys = shared_table(classes.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.when(F.col("component_id") == F.col("doc_id"), 0).otherwise(1)).alias("copy"),
        F.count("*").alias("rows")), "keys")
    gone = if_small(keys.filter("copy = 1").select("doc_id"))  # the texts stay where they are
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if keys.filter("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, domain posteriors and the fitted sampling rate."""
    return mix(docs, label_domains(read_table(spark, sf_dir, "labels")))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: Hashed likelihoods, similarity classes and the fitted rates have no SQL form;
#: tests/llm/test_mixing_pipeline.py checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
