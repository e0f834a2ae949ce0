"""Stacking feature blocks: sparse TF-IDF block followed by a dense block.

One keyed left join brings the blocks together; concatenation happens in-row.
Every row of the sparse block stays: one without a dense vector has zeros
there, and ``unmatched`` counts such rows.  The sparse block stays sparse (no
densifying).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(sparse: DataFrame, dense: DataFrame, key: str = "doc_id", dense_key: str = "vec_id") -> DataFrame:
    """One row ``(n_rows, n_unmatched)``: rows of the sparse block without a dense vector."""
    d = dense.select(F.col(dense_key).alias(key), F.lit(1).alias("_hit")).dropDuplicates([key])
    return sparse.select(key).join(d, key, "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("n_unmatched"))


def stack_long(entries: DataFrame, dense: DataFrame, sparse_width, key: str = "doc_id",
               dense_key: str = "vec_id", dense_col: str = "embedding") -> DataFrame:
    """Long form ``(key, idx, value)``: sparse entries keep their index, dense
    element j gets index ``sparse_width + j`` (``sparse_width``: the fitted
    vocabulary's size, a number or a scalar column)."""
    d = dense.select(F.col(dense_key).alias(key), F.col(dense_col).alias("_dense"))
    width = sparse_width if not isinstance(sparse_width, int) else F.lit(sparse_width)
    j = entries.join(d, key, "left").withColumn("_width", width)
    sparse_part = F.transform("entries", lambda e: F.struct(e["idx"].alias("idx"), e["weight"].alias("value")))
    dense_part = F.transform(F.coalesce("_dense", F.array().cast("array<float>")),
                             lambda v, i: F.struct((i + F.col("_width")).cast("int").alias("idx"), v.cast("double").alias("value")))
    both = j.select(key, F.explode(F.concat(sparse_part, dense_part)).alias("e"))
    return both.select(key, F.col("e.idx").alias("idx"), F.col("e.value").alias("value"))


def stack_vectors(sparse: DataFrame, dense: DataFrame, sparse_width: int, dense_width: int,
                  key: str = "doc_id", sparse_col: str = "features", dense_key: str = "vec_id",
                  dense_col: str = "embedding", output: str = "meta_features") -> DataFrame:
    """MLlib form: keyed left join, then ``VectorAssembler`` over both blocks.

    Widths are declared with ``VectorSizeHint`` (``handleInvalid='error'``), so
    feeding a block of the wrong width fails instead of silently shifting
    columns.
    """
    from pyspark.ml.feature import VectorAssembler, VectorSizeHint
    from pyspark.ml.functions import array_to_vector

    d = dense.select(F.col(dense_key).alias(key), F.col(dense_col).cast("array<double>").alias("_raw"))
    zeros = F.array_repeat(F.lit(0.0), dense_width)
    j = sparse.join(d, key, "left").withColumn("_dense", array_to_vector(F.coalesce("_raw", zeros))).drop("_raw")
    j = VectorSizeHint(inputCol=sparse_col, size=sparse_width, handleInvalid="error").transform(j)
    j = VectorSizeHint(inputCol="_dense", size=dense_width, handleInvalid="error").transform(j)
    out = VectorAssembler(inputCols=[sparse_col, "_dense"], outputCol=output).transform(j)
    return out.drop("_dense")
