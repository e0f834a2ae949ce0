"""Streaming tokenization and scoring.

Both stages are stateless row-wise transforms, so they run unchanged on a
stream: the same Column expressions (tokenizer) and the same fitted
``PipelineModel`` (scoring) apply to every micro-batch.  Sinks are files in
the shared checkpoint folder with a checkpoint location next to them, so a
restarted query resumes exactly once; ``availableNow`` drains what is there
and stops (tests, backfills), a processing-time trigger keeps it running.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.tokenizer import DEFAULT, TokenizerConfig, tokenize
from ..sources.sinks import scratch_path


def single_file_glob(path: str) -> str:
    """A glob matching exactly one file (file-source streams watch a folder
    or a glob, not a bare file)."""
    return path[:-1] + "[" + path[-1] + "]"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream with an explicit schema (``path``: folder or glob;
    a single file is turned into a one-file glob)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        path = single_file_glob(path)
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def tokenize_stream(stream: DataFrame, cfg: TokenizerConfig = DEFAULT, key: str = "doc_id",
                    text: str = "text", keep: tuple = ()) -> DataFrame:
    """``(key, *keep, tokens)`` for every incoming message."""
    return stream.select(key, *keep, tokenize(text, cfg).alias("tokens"))


def score_stream(model, stream: DataFrame, key: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """Apply a fitted pipeline to a stream (``PipelineModel.transform`` works
    on streaming frames for row-wise stages)."""
    out = model.transform(stream)
    return out.select(key, *keep, F.col("prediction").cast("int").alias("prediction"))


def running_loss_stream(stream: DataFrame, part: str, order: list[str], value: str, every: int = 10,
                        trailing: int = 10) -> DataFrame:
    """``operators.batching.running_loss`` on a live log, with keyed state.

    The state of a ``part`` is its step, its sum and its last ``trailing`` - 1
    values; a restarted query goes on from it.  Rows of one micro-batch are
    taken in ``order``; a log whose files arrive in order gives the batch
    operator's rows.  Null values take a step and count in neither sum nor mean.
    """
    fields = stream.schema
    out = T.StructType([*fields.fields, T.StructField("step", T.LongType()), T.StructField("running_sum", T.DoubleType()),
                        T.StructField("trailing_mean", T.DoubleType()), T.StructField("reported_loss", T.DoubleType()),
                        T.StructField("reported", T.BooleanType())])
    kept = T.StructType.fromDDL("step long, total double, last array<double>")

    def advance(key, frames, state):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        step, total, last = state.get if state.exists else (0, None, [])
        values = [None if x is None or x != x else float(x) for x in rows[value]]
        window, sums, means = list(last), [], []
        for x in values:
            if x is not None:
                total = x if total is None else total + x
            window = [*window, x][-trailing:]
            seen = [w for w in window if w is not None]
            sums.append(total)
            means.append(sum(seen) / len(seen) if seen else None)
        steps = [step + i for i in range(1, len(values) + 1)]
        state.update((steps[-1], total, window[-(trailing - 1):] if trailing > 1 else []))
        rows = rows.assign(step=steps, running_sum=pd.Series(sums, index=rows.index, dtype=object),
                           trailing_mean=pd.Series(means, index=rows.index, dtype=object),
                           reported_loss=pd.Series([None if s is None else s / every for s in sums], index=rows.index, dtype=object),
                           reported=[s % every == 0 for s in steps])
        yield rows[out.names]

    return stream.groupBy(part).applyInPandasWithState(advance, out, kept, "append", GroupStateTimeout.NoTimeout)


def run_to_files(stream: DataFrame, out_path: str, checkpoint: str | None = None, fmt: str = "parquet",
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start a file-sink query (append mode) with its own checkpoint folder."""
    checkpoint = checkpoint or os.path.join(out_path + "-checkpoint")
    w = (stream.writeStream.format(fmt).outputMode("append").option("path", out_path)
         .option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def drain(spark: SparkSession, stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Run ``stream`` to completion into a scratch folder and read the result
    as a batch frame (used by checks and backfills)."""
    out = scratch_path(spark, name)
    q = run_to_files(stream, out, fmt=fmt)
    q.awaitTermination()
    return spark.read.format(fmt).load(out)
