"""Dense (pooled) text vectors.

Two encoders behind one shape ``(key, embedding array<float>)``:

* built in: MLlib ``Word2Vec``; its model's ``transform`` averages the word
  vectors of a document (mean pooling), all on the JVM;
* hook: any Python encoder through ``predict_batch_udf`` -- Arrow batches of
  ``batch_size`` rows go to a function loaded once per Python worker (a
  transformer, an ONNX model, ...), so per-row Python never happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import TFIDF_MAX_FEATURES
from .vocab import term_stats


def fit_word2vec(df: DataFrame, tokens: str = "tokens", dim: int = 64, vocabulary: int = TFIDF_MAX_FEATURES,
                 max_iter: int = 1, window: int = 5, seed: int = 42, num_partitions: int | None = None):
    """Fit the built-in encoder on token arrays.

    Training runs on ``num_partitions`` partitions (default: the cluster's
    parallelism) and averages their updates, so no single task sees the whole
    corpus.  MLlib keeps the vocabulary and its vectors on the driver and
    broadcasts them, so they are bounded: only terms at least as frequent as
    the ``vocabulary``-th most frequent one are learned (ties at the cut are
    left out).
    """
    from pyspark.ml.feature import Word2Vec
    top = term_stats(df, tokens).select("tf").orderBy(F.desc("tf")).limit(vocabulary + 1).agg(
        F.count("*").alias("n"), F.min("tf").alias("least")).head()
    min_count = int(top["least"]) + 1 if top["n"] > vocabulary else 1
    parts = num_partitions or df.sparkSession.sparkContext.defaultParallelism
    w2v = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=max_iter, windowSize=window, seed=seed,
                   inputCol=tokens, outputCol="_w2v", numPartitions=parts)
    return w2v.fit(df.select(tokens))


def embed_dense(df: DataFrame, encoder, key: str = "doc_id", tokens: str = "tokens",
                output: str = "embedding") -> DataFrame:
    """Pooled vector per row with a fitted ``Word2VecModel`` (mean of its word vectors)."""
    from pyspark.ml.functions import vector_to_array
    model = encoder.copy({encoder.inputCol: tokens, encoder.outputCol: "_w2v"})
    out = model.transform(df.select(key, tokens))
    return out.select(key, vector_to_array("_w2v", "float32").alias(output))


def embed_with(df: DataFrame, make_predict_fn, dim: int, key: str = "doc_id", text: str = "text",
               batch_size: int = 32, output: str = "embedding") -> DataFrame:
    """Pooled vector per row from any Python encoder.

    ``make_predict_fn()`` runs once per worker and returns ``f(texts: ndarray)
    -> ndarray[batch, dim]``; Spark feeds it Arrow batches of ``batch_size``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.select(key, udf(F.coalesce(F.col(text), F.lit(""))).alias(output))
