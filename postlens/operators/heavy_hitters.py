"""Vocabulary of a corpus whose rare terms stay where they are read.

:func:`vocab.vocab_fit` shuffles one row per distinct term of every map task,
and nearly all of those terms are rare ones that the top ``k`` drops.  Here a
first pass keeps a Misra-Gries summary of at most ``counters`` terms per task
(lower counts, and one number by how much any of them may be too low).  The
summaries are merged by adding counts and errors.  A term whose lower count
plus the error reaches the ``k``-th largest lower count can be in the top
``k``; no other can.  A second pass counts those candidates exactly.

Both shuffles are bounded by the summaries: at most ``counters`` rows per task
in the first, one row per task and candidate in the second.  Where the error
reaches the ``k``-th lower count, a term in no summary could belong to the
result, and where there are more candidates than may be broadcast, a join
would shuffle every token; both cases count all terms as ``vocab_fit`` does,
so the result is always its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import TFIDF_MAX_FEATURES
from ..sources.sinks import scratch_path
from .joins import MAX_BROADCAST_ROWS, bounded_broadcast
from .vocab import index_terms, term_stats

#: Counters per task: the counts of a task with n tokens are at most n / COUNTERS too low.
COUNTERS = 1 << 18
SUMMARY = "term string, low long, error long"


def prune(counts: dict[str, int], counters: int) -> tuple[dict[str, int], int]:
    """At most ``counters`` terms, each lowered by the next largest count, and that count."""
    if len(counts) <= counters:
        return counts, 0
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - counters - 1)[len(values) - counters - 1])
    return {t: n - cut for t, n in counts.items() if n > cut}, cut


def summarizer(counters: int):
    """The ``mapInArrow`` function of one task: token lists in, its summary out.

    A row without a term carries the task's error.  At most ``2 * counters``
    terms and one batch's distinct terms are held.
    """
    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        error = 0
        for batch in batches:
            found = pc.value_counts(pc.list_flatten(batch.column(0)).drop_null())
            for term, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                counts[term] = counts.get(term, 0) + n
            if len(counts) > 2 * counters:
                counts, cut = prune(counts, counters)
                error += cut
        counts, cut = prune(counts, counters)
        terms = [None, *counts]
        lows = [0, *counts.values()]
        for at in range(0, len(terms), 1 << 16):
            part = terms[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array(lows[at:at + (1 << 16)], pa.int64()),
                 pa.array([error + cut if t is None else 0 for t in part], pa.int64())], names=["term", "low", "error"])
    return summarize


def term_summary(df: DataFrame, tokens: str = "tokens", counters: int = COUNTERS) -> DataFrame:
    """``(term, low, error)``: merged lower counts; the row without a term has the error of all.

    Every term's frequency lies in ``[low, low + error]`` (``low`` is 0 for a
    term that is not listed), and ``error`` is at most the number of tokens
    divided by ``counters + 1``.  A null token is no term.
    """
    return (df.select(tokens).mapInArrow(summarizer(counters), SUMMARY)
            .groupBy("term").agg(F.sum("low").alias("low"), F.sum("error").alias("error")))


def candidates(summary: DataFrame, k: int) -> DataFrame | None:
    """The terms of a written summary that can be among the ``k`` most frequent, or None where a
    term without a counter can be, too.

    Two numbers reach the driver: the ``k``-th largest lower count and the error.
    """
    terms = summary.filter(F.col("term").isNotNull())
    cut = terms.orderBy(F.desc("low")).limit(k).agg(F.count("*").alias("n"), F.min("low").alias("low")).head()
    error = summary.agg(F.coalesce(F.sum("error"), F.lit(0)).alias("error")).head()["error"]
    least = cut["low"] if cut["n"] == k else 0
    if error and error >= least:
        return None
    return terms.filter(F.col("low") + error >= least).select("term")


def vocab_fit_bounded(df: DataFrame, tokens: str = "tokens", k: int = TFIDF_MAX_FEATURES,
                      counters: int = COUNTERS) -> DataFrame:
    """The rows of :func:`vocab.vocab_fit`, ``(term, idx, tf, df)``, with shuffles bounded by the summaries.

    The summary is computed, and written to the shared scratch folder, when this
    is called.  Empty input gives no rows; ties at the cut go by term, ascending.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "term-summary")
    term_summary(df, tokens, counters).write.parquet(path)
    kept = candidates(spark.read.parquet(path), k)
    known = F.filter(tokens, lambda t: t.isNotNull())
    within = None
    if kept is not None and kept.count() <= MAX_BROADCAST_ROWS:
        within = bounded_broadcast(kept, MAX_BROADCAST_ROWS)
    return index_terms(term_stats(df.select(known.alias(tokens)), tokens, within), k)
