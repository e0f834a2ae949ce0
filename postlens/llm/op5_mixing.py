"""Mixing sources to target weights by soft membership.  DataFrame functions only.

A classifier fitted on a labelled table gives every document a posterior over
domains; projected gradient descent then fits a nonnegative sampling rate per
document so that the expected tokens of every domain match the targets.

* Classifier: multinomial naive Bayes over hashed words (``buckets``), classes
  are the domains of the labelled table, word probabilities smoothed towards
  those of all labelled rows.  It is fitted on a bounded sample of
  the labelled keys (``max_labelled``, the smallest by a hash of the key), the
  only sample here.  A document's log-likelihoods are divided so that it weighs
  as ``evidence`` words at most, which keeps long documents from posteriors of
  exactly 0 and 1: membership stays soft.
* Rates: with n_i tokens and posterior p_id, the total of domain d is
  S_d = sum_i r_i n_i p_id.  Minimise (S - T)' W (S - T) over r >= 0 from r = 1
  with W the inverse of M = sum_i n_i p_i p_i'.  In the metric that weighs
  document i with n_i, the gradient of r_i is p_i . W (S - T) and the curvature
  is 1, so the projected step is r_i <- max(0, r_i - p_i . W (S - T)), with
  Nesterov's extrapolation.  It needs D numbers per iteration and the
  document's own posterior, so an iteration is one aggregation over the
  compact table (n_i, p_i); the driver sees D sums.  Every ``every``
  iterations the rates are written to the shared folder, so plans stay short.

The targets T_d are ``targets`` (shares) of the corpus's tokens.  Iterations
end when every domain is within ``tolerance`` of its target or after
``max_iter``.  Targets below what soft membership allows (a domain whose mass
rides on documents of the others) are met as nearly as least squares can.

Defined results: null or empty texts have no tokens, the prior as posterior and
the rate that a document of that posterior gets; a key labelled with several
domains counts with the smallest; labels without a document or outside the
targets are ignored, and so are labels with a null flag; without labelled documents all domains are equally likely;
equal rows get equal rates; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_table

BUCKETS, PSEUDO, EVIDENCE = 1 << 15, 0.5, 40
#: Words that the common distribution weighs in a domain's.
SMOOTHING = 500.0
MAX_LABELLED = 50_000
MAX_ITER, TOLERANCE, EVERY = 80, 1e-4, 8

#: Target shares of the tokens by domain (quality and toxicity of the labelled table): fixed values.
TARGETS = {"good_clean": 0.84, "good_toxic": 0.06, "poor_clean": 0.08, "poor_toxic": 0.02}


def words_of(text: Column) -> Column:
    """Lower-cased pieces of a text between blanks; pieces at its ends may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")


def bucket_of(word: Column, buckets: int) -> Column:
    """Hash bucket (from 0) of a word; null for an empty one."""
    return F.when(word != "", F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))


@dataclass(frozen=True)
class DomainModel:
    """``table``: per bucket the log-likelihood of each domain, in whole
    micro-nats (bucket, w0, w1, ...; ``buckets`` rows); ``priors``: log priors."""

    domains: tuple[str, ...]
    table: DataFrame
    priors: tuple[float, ...]
    buckets: int


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], buckets: int = BUCKETS,
                max_labelled: int = MAX_LABELLED) -> DomainModel:
    """Naive Bayes on the documents of ``docs`` (doc_id, text) whose key
    ``labelled`` (doc_id, domain) names."""
    known = labelled.filter(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = shared_table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    taught = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    told = taught.select("domain", F.explode(words_of(F.col("text"))).alias("word")) \
        .select("domain", bucket_of(F.col("word"), buckets).alias("bucket")).filter("bucket is not null")
    counts = told.groupBy("bucket").agg(*[
        F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)])
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = shared_table(every.join(counts, "bucket", "left").fillna(0), "counts")  # ``buckets`` rows
    totals = full.agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in range(len(domains))]).first()
    # Smoothed towards the labelled rows' common distribution, so that a small domain is not
    # marked down for the words that all domains share.
    every_count = sum((F.col(f"c{k}") for k in range(1, len(domains))), F.col("c0"))
    common = (every_count + PSEUDO) / F.lit(float(sum(totals[f"t{k}"] for k in range(len(domains))) + PSEUDO * buckets))
    table = full.select("bucket", *[
        F.round(1e6 * F.log((F.col(f"c{k}") + SMOOTHING * common) / F.lit(float(totals[f"t{k}"] + SMOOTHING))))
        .cast("long").alias(f"w{k}") for k in range(len(domains))])
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}  # one row per domain
    total = sum(sizes.values()) + len(domains)
    priors = tuple(math.log((sizes.get(d, 0) + 1) / total) for d in domains)
    return DomainModel(tuple(domains), shared_table(table, "weights"), priors, buckets)


def memberships(docs: DataFrame, model: DomainModel, evidence: int = EVIDENCE) -> DataFrame:
    """doc_id, n (tokens), p0, p1, ... of every row of ``docs``."""
    k = len(model.domains)
    # The text's hash is taken before the words are dealt out, once per text and not once per word.
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    told = cut.select("doc_id", "text_key", F.posexplode("words").alias("pos", "word")) \
        .select("doc_id", "text_key", "pos", bucket_of(F.col("word"), model.buckets).alias("bucket"))
    summed = told.join(F.broadcast(model.table), "bucket", "left").groupBy("doc_id", "text_key").agg(
        F.count("bucket").alias("words"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(k)],
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("rows"))
    # Equal rows were summed together: divide, and give each its own result row.
    each = summed.select("doc_id", (F.col("words") / F.col("rows")).cast("long").alias("n"), "rows", *[
        F.coalesce(F.col(f"w{i}") / F.col("rows") / 1e6, F.lit(0.0)).alias(f"w{i}") for i in range(k)])
    scale = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest("n", F.lit(1)))
    scored = each.select("doc_id", "n", "rows", *[
        (F.lit(model.priors[i]) + F.col(f"w{i}") * scale).alias(f"s{i}") for i in range(k)])
    top = F.greatest(*[f"s{i}" for i in range(k)]) if k > 1 else F.col("s0")
    raw = scored.select("doc_id", "n", "rows", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(k)])
    total = sum((F.col(f"e{i}") for i in range(1, k)), F.col("e0"))
    return raw.select("doc_id", "n", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in range(k)],
                      F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy")).drop("copy")


def fit_rates(members: DataFrame, shares: tuple[float, ...], max_iter: int = MAX_ITER,
              tolerance: float = TOLERANCE, every: int = EVERY) -> tuple[DataFrame, list[float], list[float]]:
    """``members`` (doc_id, n, p0...) plus rate; the fitted and the target totals."""
    k = len(shares)
    p = [F.col(f"p{i}") for i in range(k)]
    mass = members.agg(F.sum("n").alias("n"), *[
        F.sum(F.col("n") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    tokens = float(mass["n"] or 0)
    targets = [s * tokens for s in shares]
    if tokens == 0:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * k, targets
    inverse = np.linalg.pinv(np.array([[float(mass[f"m{i}_{j}"]) for j in range(k)] for i in range(k)]))

    def stepped(df: DataFrame, pull: list[float], beta: float) -> DataFrame:
        """One step from ``ahead``, the extrapolated rates."""
        push = sum((p[i] * F.lit(pull[i]) for i in range(1, k)), p[0] * F.lit(pull[0]))
        df = df.withColumn("next", F.greatest(F.lit(0.0), F.col("ahead") - push))
        return df.select("doc_id", "n", *p, F.col("next").alias("rate"),
                         (F.col("next") + F.lit(beta) * (F.col("next") - F.col("rate"))).alias("ahead"))

    state = members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    momentum, written = 1.0, 0
    for step in range(max_iter + 1):
        sums = state.agg(*[F.sum(F.col(c) * F.col("n") * p[i]).alias(f"{c}{i}")
                           for c in ("rate", "ahead") for i in range(k)]).first()
        totals = [float(sums[f"rate{i}"]) for i in range(k)]
        off = [abs(s - t) / max(t, 1e-9 * tokens) for s, t in zip(totals, targets, strict=True)]
        if max(off) <= tolerance or step == max_iter:
            break
        pull = inverse @ (np.array([float(sums[f"ahead{i}"]) for i in range(k)]) - np.array(targets))
        longer = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        state, momentum = stepped(state, pull.tolist(), (momentum - 1) / longer), longer
        written += 1
        if written % every == 0:
            state = shared_table(state, "rates")
    return state.drop("ahead"), totals, targets


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the labelled table's quality and toxic flags; a label without either is left out."""
    known = labels.filter("quality is not null and toxic is not null")
    return known.select("doc_id", F.concat(
        F.when(F.col("quality") == 1, F.lit("good")).otherwise(F.lit("poor")), F.lit("_"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("clean"))).alias("domain"))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, **fit) -> DataFrame:
    """doc_id, n_tokens, one posterior per domain and the rate of every row of ``docs``."""
    domains = tuple(sorted(targets))
    model = fit_domains(docs, labelled, domains)
    members = shared_table(memberships(docs.select("doc_id", "text"), model), "members")
    rated, _, _ = fit_rates(members, tuple(targets[d] for d in domains), **fit)
    return rated.select("doc_id", F.col("n").alias("n_tokens"),
                        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), label_domains(read_table(spark, sf_dir, "labels")))


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict[str, str] = {}
