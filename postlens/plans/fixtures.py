"""Stand-ins built from the driver tables (see FIXTURES.md).

* messages: ``documents`` LEFT JOIN ``labels`` -> ``(doc_id, text, label)``,
  label = ``toxic`` (null when unlabelled).
* truth / pseudo-predictors for evaluation without a model:
  truth = ``toxic``, predictor A = ``1 - quality``, predictor B = ``doc_id % 2``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def documents(spark: SparkSession, sf_dir: str, task_bytes: int | None = None) -> DataFrame:
    """The message table, spread over the cluster by ``doc_id`` when the scan
    alone would give too few tasks for whole-text work (see ``spread``)."""
    from ..operators.joins import spread
    return spread(read_table(spark, sf_dir, "documents"), "doc_id", task_bytes=task_bytes)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text")
    lab = labels(spark, sf_dir).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return d.join(lab, "doc_id", "left")


def labelled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text")
    lab = labels(spark, sf_dir).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return d.join(lab, "doc_id", "inner")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id", F.col("toxic").cast("int").alias("label"))


def predictor_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select(
        "doc_id", (F.lit(1) - F.col("quality")).cast("int").alias("prediction"))


def predictor_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select(
        "doc_id", (F.col("doc_id") % 2).cast("int").alias("prediction"))


# SQL fragments that state the same stand-ins for the DuckDB oracle.
SQL_MESSAGES = ("(SELECT d.doc_id, d.text, CAST(l.toxic AS INTEGER) AS label "
                "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
SQL_TRUTH = "(SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels)"
SQL_PRED_A = "(SELECT doc_id, CAST(1 - quality AS INTEGER) AS prediction FROM labels)"
SQL_PRED_B = "(SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS prediction FROM labels)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled dense vectors keyed by ``vec_id`` (joined to ``doc_id`` by convention)."""
    return read_table(spark, sf_dir, "embeddings")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")
