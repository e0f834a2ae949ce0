"""Catalogue entries: projections, null policy, labels, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, splits
from . import fixtures as fx
from .registry import register
from .sqlfrag import key_hash, split_case

M = fx.SQL_MESSAGES


@register("project_text_label", f"SELECT doc_id, text, label FROM {M}")
def project_text_label(spark, sf_dir):
    m = fx.messages(spark, sf_dir)           # (doc_id, text, label): positions 1, 2
    return cleaning.project_text_label(m, text=1, label=2)


@register("drop_null_text", f"SELECT doc_id, text, label FROM {M} WHERE text IS NOT NULL")
def drop_null_text(spark, sf_dir):
    return cleaning.drop_null_text(fx.messages(spark, sf_dir))


@register("fill_null_text", f"SELECT doc_id, coalesce(text, '') AS text, label FROM {M}")
def fill_null_text(spark, sf_dir):
    return cleaning.fill_null_text(fx.messages(spark, sf_dir), "")


@register("skip_empty_rows", f"SELECT doc_id, text, label FROM {M} WHERE text IS NOT NULL AND text <> ''")
def skip_empty_rows(spark, sf_dir):
    return cleaning.skip_empty_rows(fx.messages(spark, sf_dir))


@register("default_label", f"SELECT doc_id, coalesce(label, 2) AS label FROM {M}")
def default_label(spark, sf_dir):
    return cleaning.default_label(fx.messages(spark, sf_dir).select("doc_id", "label"))


@register("cast_label", "SELECT doc_id, CAST(CAST(toxic AS VARCHAR) AS INTEGER) AS label FROM labels")
def cast_label(spark, sf_dir):
    lab = fx.labels(spark, sf_dir).select("doc_id", F.col("toxic").cast("string").alias("label"))
    return cleaning.cast_label(lab)


@register("num_labels", f"SELECT count(DISTINCT coalesce(label, 2)) AS num_labels FROM {M}")
def num_labels(spark, sf_dir):
    return cleaning.num_labels(cleaning.default_label(fx.messages(spark, sf_dir)))


@register("label_split", f"SELECT doc_id, {split_case()} AS split FROM documents")
def label_split(spark, sf_dir):
    return splits.label_split(fx.documents(spark, sf_dir).select("doc_id"))


@register("fold_assign", f"SELECT doc_id, CAST({key_hash('doc_id', 'fold')} % 5 AS INTEGER) AS fold FROM labels")
def fold_assign(spark, sf_dir):
    return splits.fold_assign(fx.labels(spark, sf_dir).select("doc_id"), 5)


_OVERLAP_SQL = f"""
WITH s AS (SELECT doc_id, text, {split_case()} AS split FROM documents),
l AS (SELECT text FROM s WHERE split = 'train'),
r AS (SELECT text FROM s WHERE split = 'test')
SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right,
       (SELECT count(*) FROM l WHERE text IN (SELECT text FROM r)) AS n_shared
"""


@register("split_overlap", _OVERLAP_SQL)
def split_overlap(spark, sf_dir):
    s = splits.label_split(fx.documents(spark, sf_dir).select("doc_id", "text"))
    left = s.filter(F.col("split") == "train").select("text")
    right = s.filter(F.col("split") == "test").select("text")
    return splits.split_overlap(left, right, on=["text"])
