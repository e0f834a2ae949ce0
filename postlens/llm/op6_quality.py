"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio
between the multinomials of trusted target texts and of the raw corpus.

Two passes over the texts.  The first counts hashed word uni- and bigrams of
every document (raw) and of all trusted ones (target): one bounded vector per
task, summed by Spark.  The second scores every document: the mean over its
n-grams of log p_target - log p_raw, in whole micro-nats, so that the verdict
does not depend on the order of summation.  A document is kept when the base
rules pass and its score is at least the threshold.  Judged are the scores of
the second pass; the filter, which needs the texts again, scores once more.

The threshold follows from the scores of the labelled documents that pass the
base rules: half-way between the ``GOOD_SHARE`` quantile of the good ones and
the ``POOR_SHARE`` quantile of the poor ones, or the first of the two where the
poor ones reach above it.  ``threshold`` fixes it instead.

Weights and threshold come from all labelled documents.  Broadcast are the
weights, ``buckets`` integers, a bound by parameter, and the keys of the trusted
documents while they are few (``if_small``; beyond, the planner shuffles both
sides).  The threshold's labels meet scores, not texts.  Quantiles are exact: counted in bins of ``BIN`` scores, then inside the
bins that hold the places asked for.

Base measures, per whole text (null: no words): n_words, word_chars (code
points in words), n_symbols (characters of ``[#*$%&|<>]``), n_dup_lines
(\\n-split lines with a word, equal to an earlier line), n_repeat_words (words
inside a 3-word window that occurs at least twice, the first included).

Defined results: a document without n-grams scores 0 and fails the base rules;
without any trusted row all weights are 0 and only the base rules decide; equal
rows are judged one by one; null keys are judged and never trusted; a key
labelled twice is trusted if any of its labels is good, and among the labelled
scores a key counts once, with its lowest.  Without good labelled documents
nothing is rejected by score, without poor ones what lies below the quantile of
the good ones.  Extra columns pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordBatch, if_small, mix64, read_table, settings, shared_table, slices

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Text bytes of one numpy step (its arrays are several times that), bytes of an Arrow batch.
STEP_BYTES, BATCH_BYTES = 1 << 20, 4 << 20

#: Hash buckets and pseudo-count.
BUCKETS = 1 << 16
PSEUDO = 0.5
#: Quantiles of the labelled scores that the threshold lies between.
GOOD_SHARE, POOR_SHARE = 0.001, 0.9
#: Below every score.
REJECTS_NOTHING = -(1 << 62)
#: Scores (micro-nats) counted together in the first step of a quantile.
BIN = 4096


def ngram_buckets(words: WordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all unigrams, of all word pairs, and whether each pair lies in one text."""
    low = pc.ascii_lower(words.distinct).cast(pa.binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in low), dtype=np.uint64, count=len(low))
    h = table[words.ids] if len(low) else np.zeros(0, np.uint64)
    whole = np.ones(max(0, len(h) - 1), bool)
    ends = words.ends[(words.ends > 0) & (words.ends < len(h))]
    whole[ends - 1] = False
    pairs = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    size = np.uint64(buckets)
    return (h % size).astype(np.int64), (pairs % size).astype(np.int64), whole


def sums_by_text(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends] - total[starts]


def count_ngrams(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket that the task has seen: raw and target counts."""
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for batch in batches:
        for part in slices(batch, "text", STEP_BYTES):
            words = WordBatch(part.column("text"))
            one, two, whole = ngram_buckets(words, buckets)
            trusted = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            mine = np.repeat(trusted, words.counts)
            for grams, own in ((one, mine), (two[whole], mine[:-1][whole] if len(mine) else mine)):
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[own], minlength=buckets)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])],
                                     names=["bucket", "raw", "target"])


def weights_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Micro-nats log p_target - log p_raw per bucket, both smoothed by PSEUDO."""
    if target.sum() == 0:
        return np.zeros(len(raw), np.int64)
    p = np.log((target + PSEUDO) / (target.sum() + PSEUDO * len(target)))
    q = np.log((raw + PSEUDO) / (raw.sum() + PSEUDO * len(raw)))
    return np.rint((p - q) * 1e6).astype(np.int64)


def repeat_words(words: WordBatch) -> np.ndarray:
    """Per text, the words inside a 3-word window that the text has twice or more."""
    ids, n = words.ids, len(words.ids)
    covered = np.zeros(n, bool)
    if n >= 3:
        owner = np.repeat(np.arange(len(words.counts)), words.counts)
        first = np.flatnonzero(owner[:-2] == owner[2:])  # windows inside one text
        a, b, c = ids[first], ids[first + 1], ids[first + 2]
        if len(words.distinct) < 1 << 21:
            key = (a << 42) | (b << 21) | c
        else:  # dense numbers of the pairs keep the key exact
            _, pair = np.unique(a * len(words.distinct) + b, return_inverse=True)
            key = pair * len(words.distinct) + c
        order = np.argsort(key, kind="stable")  # equal windows of one text end up side by side
        k, d = key[order], owner[first][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(first), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for shift in range(3):
            covered[first[twice] + shift] = True
    return sums_by_text(covered, words.starts, words.ends)


def dup_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    use = full[ids] if len(ids) else np.zeros(0, bool)
    lines = np.bincount(owner[use], minlength=len(texts))
    distinct = np.unique(owner[use] * max(1, len(full)) + ids[use]) // max(1, len(full))
    return lines - np.bincount(distinct, minlength=len(texts))


def symbols(texts: pa.Array) -> np.ndarray:
    """Per text, the characters of SYMBOLS."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS)] = True
    hit = marks[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    return sums_by_text(hit, ends[:-1] - ends[0], ends[1:] - ends[0])


def measure(batches: Iterator[pa.RecordBatch], weights, threshold: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """``keep`` columns plus the base measures, the score and the verdicts of each row."""
    table = weights.value
    for batch in batches:
        for part in slices(batch, "text", STEP_BYTES):
            texts = part.column("text")
            words = WordBatch(texts)
            one, two, whole = ngram_buckets(words, len(table))
            n = words.counts
            pair = np.where(whole, table[two], 0) if len(two) else np.zeros(0, np.int64)
            score = sums_by_text(table[one], words.starts, words.ends)
            # the pair at i belongs to the text of word i; a text's last word has none
            score += sums_by_text(np.append(pair, 0) if len(one) else pair, words.starts, words.ends)
            score //= np.maximum(1, 2 * n - 1)
            chars = sums_by_text(pc.utf8_length(words.words).to_numpy(zero_copy_only=False), words.starts, words.ends)
            repeats = repeat_words(words)
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (score >= threshold)
            columns = [n, chars, symbols(texts), dup_lines(texts), repeats, failed, kept, score]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], *[pa.array(c) for c in columns]], names=[*keep, *MEASURES])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
MEASURE_TYPES = ("long",) * 5 + ("boolean", "boolean", "long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All keys labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and the distinct keys ``trusted`` (doc_id)."""
    marked = docs.select("doc_id", "text").join(trusted.withColumn("good", F.lit(True)), "doc_id", "left")
    marked = marked.select("text", F.coalesce("good", F.lit(False)).alias("trusted"))
    counted = (marked.mapInArrow(lambda it: count_ngrams(it, buckets), "bucket long, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    with settings(docs.sparkSession, batch_bytes=str(BATCH_BYTES)):
        rows = counted.collect()  # at most ``buckets``
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return weights_of(raw, target)


def labelled_ids(labels: DataFrame) -> DataFrame:
    """``(doc_id, good)``: all trusted keys, and those labelled poor and never good."""
    good = F.coalesce(F.expr("quality = 1 and coalesce(toxic, 0) = 0"), F.lit(False))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(good).alias("good"), F.min("quality").alias("least"))
    return told.filter("good or least = 0").select("doc_id", "good")


def _measures_schema(rows: DataFrame, keep: list[str]) -> str:
    return ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep],
                      *[f"{n} {t}" for n, t in zip(MEASURES, MEASURE_TYPES, strict=True)]])


def measured(docs: DataFrame, weights) -> DataFrame:
    """doc_id and MEASURES of every row, kept wherever the base rules pass."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(lambda it: measure(it, weights, REJECTS_NOTHING, ["doc_id"]), _measures_schema(rows, ["doc_id"]))


def places(counts: dict[int, int], wanted: list[int]) -> dict[int, tuple[int, int]]:
    """Of each place (from 0) in the sorted values: its value and the place where that value begins."""
    found, begin = {}, 0
    for value in sorted(counts):
        for at in wanted:
            if begin <= at < begin + counts[value]:
                found[at] = (value, begin)
        begin += counts[value]
    return found


def quantiles(scores: DataFrame, shares: dict[bool, float]) -> dict[bool, float | None]:
    """The exact quantile of the scores of either class (good, score), between two neighbours by their distance.

    What visits the driver is a count per bin, as many as the range of the scores
    has, and one per score of the few bins wanted.
    """
    binned = scores.withColumn("bin", F.floor(F.col("score") / BIN).cast("long"))
    bins: dict[bool, dict[int, int]] = {good: {} for good in shares}
    for r in binned.groupBy("good", "bin").count().collect():
        bins[r["good"]][r["bin"]] = r["count"]
    last = {good: shares[good] * (sum(b.values()) - 1) for good, b in bins.items() if b}
    wanted = {good: [int(np.floor(at)), int(np.ceil(at))] for good, at in last.items()}
    inside = {good: places(bins[good], wanted[good]) for good in last}
    near = [(F.col("good") == good) & F.col("bin").isin(sorted({b for b, _ in inside[good].values()})) for good in last]
    out: dict[bool, float | None] = dict.fromkeys(shares)
    if not near:
        return out
    held: dict[tuple, dict[int, int]] = {}
    for r in binned.filter(near[0] if len(near) == 1 else near[0] | near[1]).groupBy("good", "bin", "score").count().collect():
        held.setdefault((r["good"], r["bin"]), {})[r["score"]] = r["count"]
    for good, at in last.items():
        value = []
        for place in wanted[good]:
            b, begin = inside[good][place]
            value.append(places(held[good, b], [place - begin])[place - begin][0])
        low, high = wanted[good]
        out[good] = float(value[0]) if value[0] == value[1] else (high - at) * value[0] + (at - low) * value[1]
    return out


def fit_threshold(told: DataFrame, labels: DataFrame) -> int:
    """The threshold from the scores (``told``: doc_id, base_failed, score) of all labelled documents."""
    lowest = told.filter("not base_failed").join(labelled_ids(labels), "doc_id").groupBy("doc_id", "good").agg(F.min("score").alias("score"))
    with settings(told.sparkSession, batch_bytes=str(BATCH_BYTES)):
        scores = shared_table(lowest.select("good", "score"), "quality_scores")
    found = quantiles(scores, {True: GOOD_SHARE, False: POOR_SHARE})
    return threshold_of(found[True], found[False])


def threshold_of(good: float | None, poor: float | None) -> int:
    if good is None:
        return REJECTS_NOTHING
    return int(np.floor(good if poor is None else min(good, (good + poor) / 2)))


def broadcast_weights(docs: DataFrame, labels: DataFrame, buckets: int):
    trusted = if_small(shared_table(trusted_ids(labels), "trusted"))
    return docs.sparkSession.sparkContext.broadcast(fit_weights(docs, trusted, buckets))


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id and MEASURES of every row of ``docs``."""
    told = measured(docs, broadcast_weights(docs, labels, buckets))
    if threshold is None:
        told = shared_table(told, "quality")  # read for the threshold and for the verdicts
        threshold = fit_threshold(told, labels)
    return told.withColumn("kept", F.col("kept") & (F.col("score") >= threshold))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    weights = broadcast_weights(docs, labels, buckets)
    least = fit_threshold(measured(docs, weights), labels) if threshold is None else threshold

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                only = pa.RecordBatch.from_arrays([part.column("text")], names=["text"])
                mask = [m.column("kept") for m in measure(iter([only]), weights, least, [])]
                yield part.filter(pa.concat_arrays(mask))

    return docs.mapInArrow(kept_rows, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL: dict[str, str] = {}
