"""Sequence encoding for the dense branch: token ids + attention mask.

Ids come from a fitted vocabulary (``idx + 2``; 0 = padding, 1 = unknown),
truncated to ``max_len`` (the encoder's input width) and padded to the
longest row of the row's batch or of the whole data set.  Batches are
fixed-size runs of the key order (see ``batching.assign_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import TFIDF_MAX_FEATURES
from .batching import assign_batches
from .joins import bounded_broadcast

PAD_ID = 0
UNKNOWN_ID = 1


def encode_ids(df: DataFrame, vocab: DataFrame, key: str = "doc_id", tokens: str = "tokens",
               max_len: int = 512, batch_size: int = 32, k: int | None = TFIDF_MAX_FEATURES,
               pad_to: str = "batch") -> DataFrame:
    """``(key, batch_id, n_ids, width, input_ids, attention_mask)``.

    ``k`` bounds the vocabulary (checked before it is broadcast); ``pad_to`` is
    ``"batch"`` or ``"dataset"``, whose width is a scalar maximum.
    """
    if pad_to not in ("batch", "dataset"):
        raise ValueError('pad_to must be "batch" or "dataset"')
    numbered = assign_batches(df.select(key, tokens), [key], batch_size, key=key)
    voc = bounded_broadcast(vocab.select(F.col("term").alias("_t"), (F.col("idx") + 2).alias("_id")), k)
    pos = numbered.select(key, "batch_id", F.posexplode_outer(F.slice(tokens, 1, max_len)).alias("_p", "_t"))
    ids = pos.join(voc, "_t", "left").select(
        key, "batch_id", "_p",
        F.when(F.col("_t").isNull(), F.lit(None)).otherwise(F.coalesce("_id", F.lit(UNKNOWN_ID))).alias("_id"))
    # batches are bounded (batch_size rows), so grouping and the width window
    # share one exchange on batch_id without skew.
    per_doc = ids.repartition("batch_id").groupBy("batch_id", key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_p", "_id")))).alias("_e"))
    per_doc = per_doc.select(key, "batch_id", F.transform("_e", lambda e: e["_id"]).alias("_ids"))
    n = F.size("_ids")
    if pad_to == "batch":
        width = F.max(n).over(Window.partitionBy("batch_id"))
    else:
        width = df.select(F.max(F.least(F.size(tokens), F.lit(max_len)))).scalar()
    out = per_doc.select(key, "batch_id", n.alias("n_ids"), width.alias("width"), "_ids")
    pad = F.array_repeat(F.lit(PAD_ID), F.col("width") - F.col("n_ids"))
    return out.select(
        key, "batch_id", "n_ids", "width",
        F.concat("_ids", pad).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("n_ids")), pad).alias("attention_mask"),
    )
