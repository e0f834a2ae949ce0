"""Catalogue entries: streaming tokenizer and scorer.

The driver tables are read as a file-source stream (``availableNow``), written
to a file sink and read back; the result must equal the batch result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mathx import quantize
from ..session import read_table
from ..streaming.pipelines import drain, read_stream, running_loss_stream, score_stream, tokenize_stream
from . import tokenizer_sql as tsql
from .feature_queries import SQL_RUNNING_LOSS
from .registry import register


@register("tokenize_stream", f"""
WITH RECURSIVE {tsql.tokens("(SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS id, text FROM conversations)")},
rows AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS id FROM conversations)
SELECT r.conv_id, r.turn, r.role, CAST(len(t.toks) AS INTEGER) AS n_tokens, coalesce(array_to_string(t.toks, ' '), '') AS tokens
FROM rows r JOIN tokens t ON r.id = t.id""")
def q_tokenize_stream(spark, sf_dir):
    path = f"{sf_dir.rstrip('/')}/conversations.parquet"
    schema = read_table(spark, sf_dir, "conversations").schema
    s = read_stream(spark, path, schema)
    toks = tokenize_stream(s.withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn")),
                           keep=("conv_id", "turn", "role"))
    out = drain(spark, toks, "tokenize-stream")
    return out.select("conv_id", "turn", "role", F.size("tokens").alias("n_tokens"),
                      F.array_join("tokens", " ").alias("tokens"))


@register("running_loss_stream", SQL_RUNNING_LOSS)
def q_running_loss_stream(spark, sf_dir):
    """The running loss of the event log read as a stream, with state per user."""
    schema = read_table(spark, sf_dir, "events").schema
    s = read_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema).select("user_id", "event_id", "ts", "value")
    out = drain(spark, running_loss_stream(s, "user_id", ["ts", "event_id"], "value"), "loss-stream")
    return out.select("user_id", "event_id", "step", *[quantize(c).alias(c) for c in ("running_sum", "trailing_mean", "reported_loss")], "reported")


@register("score_stream", "SELECT doc_id, TRUE AS equal FROM documents")
def q_score_stream(spark, sf_dir):
    """The saved text pipeline, loaded and applied to the documents table as a
    stream; every prediction equals the batch's."""
    from ..operators import models
    from ..sources.sinks import load_model, save_model, scratch_path
    from .model_queries import text_pipeline
    pipeline = text_pipeline(spark, sf_dir)
    loaded = load_model(save_model(pipeline, scratch_path(spark, "stream-model")))
    docs = read_table(spark, sf_dir, "documents")
    s = read_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", docs.schema)
    scored = drain(spark, score_stream(loaded, s, "doc_id"), "score-stream")
    batch = models.score(pipeline, docs, keep=()).select("doc_id", F.col("prediction").alias("expected"))
    return scored.join(batch, "doc_id").select("doc_id", (F.col("prediction") == F.col("expected")).alias("equal"))
