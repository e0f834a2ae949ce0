"""Vocabulary, document frequency, IDF and TF-IDF (sparse branch features).

Plan shape (checked with ``explain``):

* ``vocab_fit``: scan(text) -> explode of the tokens and of the distinct tokens
  -> HashAggregate(partial) -> Exchange(term) -> HashAggregate(final)
  -> TakeOrderedAndProject(k).  One shuffle, map-side combined, so a hot term
  costs one row per map task.
* ``tfidf_transform``: explode -> broadcast hash join with the k-row
  vocabulary -> count per (document, index) and collect per document, one
  Exchange(doc key) with partial aggregation -> in-row normalization.
  Documents without vocabulary terms keep an all-zero row (left join,
  ``explode_outer``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import TFIDF_MAX_FEATURES
from .joins import bounded_broadcast


def term_stats(df: DataFrame, tokens: str = "tokens", within: DataFrame | None = None) -> DataFrame:
    """``(term, tf, df)``: corpus term frequency and document frequency, of the terms in
    ``within`` (column ``term``) where that is given.

    Each row emits its tokens (flag 0) and its distinct tokens (flag 1); one
    aggregation with map-side combine counts both, so a hot term costs one
    row per map task in the shuffle.
    """
    both = F.concat(
        F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"))))
    each = df.select(F.explode(both).alias("e"))
    if within is not None:
        each = each.join(within, F.col("e.term") == within["term"], "left_semi")
    return (
        each.groupBy(F.col("e.term").alias("term"))
        .agg(F.sum(F.lit(1) - F.col("e.d")).cast("long").alias("tf"), F.sum("e.d").cast("long").alias("df"))
    )


def vocab_fit(df: DataFrame, tokens: str = "tokens", k: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """Keep the ``k`` most frequent terms (ties: term ascending), index them
    alphabetically: ``(term, idx, tf, df)``."""
    return index_terms(term_stats(df, tokens), k)


def index_terms(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of :func:`term_stats` with their index."""
    top = stats.orderBy(F.desc("tf"), F.asc("term")).limit(k)
    # row_number over the k kept rows only (bounded by k).
    idx = (F.row_number().over(Window.orderBy("term")) - 1).cast("int")
    return top.select("term", idx.alias("idx"), "tf", "df")


def width(model: DataFrame) -> int:
    """Features of a fitted vocabulary: its rows (at most ``k``)."""
    return model.count()


def n_rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a lazy scalar sub-query column."""
    return df.select(F.count(F.lit(1))).scalar()


def idf_fit(vocab: DataFrame, n_docs) -> DataFrame:
    """Smoothed idf ``ln((1+n)/(1+df)) + 1`` for each vocabulary term.

    ``n_docs``: a Column (e.g. :func:`n_rows`) or an int.
    """
    n = n_docs if isinstance(n_docs, Column) else F.lit(int(n_docs))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return vocab.withColumn("idf", idf)


def fit_tfidf(df: DataFrame, tokens: str = "tokens", k: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """Vocabulary + idf in one call: ``(term, idx, tf, df, idf)``."""
    return idf_fit(vocab_fit(df, tokens, k), n_rows(df))


def tfidf_entries(df: DataFrame, model: DataFrame, key: str = "doc_id",
                  tokens: str = "tokens", k: int | None = TFIDF_MAX_FEATURES) -> DataFrame:
    """``(key, entries array<struct<idx:int, weight:double>>)`` sorted by idx,
    L2-normalized; rows whose tokens hit no vocabulary term get ``[]``.

    ``model`` is the output of :func:`fit_tfidf` (at most ``k`` rows, which is
    what licenses the broadcast).  Plan: explode -> broadcast hash join (drops
    out-of-vocabulary tokens before any shuffle) -> count per (key, idx) ->
    collect per key.  Both aggregations are keyed by the document, so input
    already hash-partitioned by ``key`` needs no exchange at all; otherwise
    each shuffles at most one row per (document, vocabulary term), and a
    document holds at most ``k`` entries.
    """
    voc = bounded_broadcast(model.select(F.col("term").alias("_t"), "idx", "idf"), k)
    toks = df.select(key, F.explode_outer(tokens).alias("_t"))
    hits = toks.join(voc, "_t", "left").select(key, "idx", "idf")
    counts = hits.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("cnt"), F.first("idf").alias("idf"))
    w = F.col("cnt") * F.col("idf")
    agg = counts.groupBy(key).agg(
        F.collect_list(F.when(F.col("idx").isNotNull(), F.struct(F.col("idx"), w.alias("w")))).alias("raw"),
        F.coalesce(F.sum(w * w), F.lit(0.0)).alias("ss"),
    )
    norm = F.sqrt(F.col("ss"))
    entries = F.transform(
        F.array_sort("raw"),
        lambda e: F.struct(e["idx"].alias("idx"), (e["w"] / norm).alias("weight")),
    )
    return agg.select(key, entries.alias("entries"))


def tfidf_long(df: DataFrame, model: DataFrame, key: str = "doc_id",
               tokens: str = "tokens", k: int | None = TFIDF_MAX_FEATURES) -> DataFrame:
    """Long form ``(key, idx, weight)``; an all-zero row appears once with
    null ``idx``/``weight``."""
    ent = tfidf_entries(df, model, key, tokens, k)
    return ent.select(key, F.explode_outer("entries").alias("e")).select(
        key, F.col("e.idx").alias("idx"), F.col("e.weight").alias("weight"))


def tfidf_stages(model: DataFrame, tokens: str = "tokens", output: str = "features", k: int = TFIDF_MAX_FEATURES):
    """The fitted vectorizer as a ``PipelineModel`` (it can be saved and put before a learner).

    The vocabulary, at most ``k`` terms, is the only thing that visits the driver.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    rows = model.select("term", "idx", "idf").orderBy("idx").limit(k + 1).collect()
    if len(rows) > k:
        raise ValueError(f"the vocabulary has more than {k} terms; fit it with a smaller k or pass a larger one")
    cv = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol=tokens, outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense([float(r["idf"]) for r in rows]), inputCol="_tf", outputCol="_tfidf")
    nm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)
    return PipelineModel(stages=[cv, ep, nm])


def tfidf_vector(df: DataFrame, model: DataFrame, tokens: str = "tokens",
                 output: str = "features", k: int = TFIDF_MAX_FEATURES) -> DataFrame:
    """Same weights as an MLlib sparse vector column (for MLlib learners), by
    JVM stages only (see :func:`tfidf_stages`)."""
    return tfidf_stages(model, tokens, output, k).transform(df).drop("_tf", "_tfidf")


def sparse_entries(vector) -> Column:
    """``array<struct<idx:int, weight:double>>`` of an MLlib vector column: the stored entries of a
    sparse vector, which is not made dense, and the entries other than zero of a dense one."""
    v = F.unwrap_udt(vector)
    sparse = F.transform(F.arrays_zip(v["indices"].alias("idx"), v["values"].alias("weight")),
                         lambda e: F.struct(e["idx"].alias("idx"), e["weight"].alias("weight")))
    dense = F.filter(F.transform(v["values"], lambda x, i: F.struct(i.alias("idx"), x.alias("weight"))), lambda e: e["weight"] != 0)
    return F.when(v["type"] == 0, sparse).otherwise(dense)
