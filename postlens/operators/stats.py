"""Paired model comparison: McNemar's test, Cohen's d, leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import erfc
from .metrics import averaged


def correctness(truth: DataFrame, pred: DataFrame, key: str = "doc_id", name: str = "correct",
                label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(key, name)``: 1 when the prediction equals the truth, else 0, also for a
    row that was not scored (keyed join)."""
    t = truth.select(key, F.col(label).alias("_y"))
    p = pred.select(key, F.col(prediction).alias("_p"))
    return t.join(p, key, "left").select(key, F.coalesce(F.col("_y") == F.col("_p"), F.lit(False)).cast("int").alias(name))


def binomial_tail(b, c):
    """Two-sided exact p of b against c: twice the tail of min(b, c) of b + c fair tosses, at most 1.

    Each term's logarithm is the one before plus ln((n - i + 1) / i); terms are
    added as they come, from the smallest.
    """
    n, least = b + c, F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    terms = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<bigint>"))

    def step(acc, i):
        t = acc["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    return F.least(F.lit(1.0), 2 * F.aggregate(terms, start, step)["s"])


def mcnemar(truth: DataFrame, pred_a: DataFrame, pred_b: DataFrame, key: str = "doc_id", exact_below: int = 25) -> DataFrame:
    """McNemar's test on the rows of the truth (an unscored row is a wrong one).

    b = A right & B wrong, c = A wrong & B right; statistic (b-c)^2/(b+c),
    continuity-corrected (|b-c|-1)^2/(b+c); p = P(chi2_1 > x) = erfc(sqrt(x/2)).
    b + c = 0 gives statistic 0 and p 1.  ``p_exact`` is the binomial test's,
    where b + c is below ``exact_below`` (there the chi-square form misleads),
    else null.
    """
    ca = correctness(truth, pred_a, key, "ca")
    cb = correctness(truth, pred_b, key, "cb")
    j = ca.join(cb, key)
    counts = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when((F.col("ca") == 1) & (F.col("cb") == 0), 1).otherwise(0)).cast("long").alias("b"),
        F.sum(F.when((F.col("ca") == 0) & (F.col("cb") == 1), 1).otherwise(0)).cast("long").alias("c"),
    )
    bc = F.col("b") + F.col("c")
    diff = F.abs(F.col("b") - F.col("c")).cast("double")
    stat = F.when(bc == 0, F.lit(0.0)).otherwise(diff * diff / bc)
    stat_cc = F.when(bc == 0, F.lit(0.0)).otherwise((diff - 1.0) * (diff - 1.0) / bc)
    out = counts.select("n", "b", "c", stat.alias("statistic"), stat_cc.alias("statistic_corrected"))
    return out.select(
        "*",
        erfc(F.sqrt(F.col("statistic") / 2.0)).alias("p_value"),
        erfc(F.sqrt(F.col("statistic_corrected") / 2.0)).alias("p_value_corrected"),
        F.when(F.col("b") + F.col("c") < exact_below, binomial_tail(F.col("b"), F.col("c"))).alias("p_exact"),
    )


def cohens_d(a: DataFrame, b: DataFrame, value: str = "correct") -> DataFrame:
    """Standardized mean difference of two per-row score samples (pooled sd).

    Both samples are tagged and unioned, then one aggregation computes the
    six moments with conditional aggregates (one pass, partial + final).
    """
    u = a.select(F.lit("a").alias("_s"), F.col(value).alias("_v")).unionByName(
        b.select(F.lit("b").alias("_s"), F.col(value).alias("_v")))
    aggs = []
    for tag in ("a", "b"):
        v = F.when(F.col("_s") == tag, F.col("_v"))
        aggs += [F.count(v).alias(f"n_{tag}"), F.avg(v).alias(f"mean_{tag}"), F.var_samp(v).alias(f"var_{tag}")]
    row = u.agg(*aggs)
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                    / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when(pooled > 0, (F.col("mean_a") - F.col("mean_b")) / pooled).otherwise(F.lit(0.0))
    return row.select("n_a", "n_b", "mean_a", "mean_b", pooled.alias("pooled_sd"), d.alias("d"))


def leaderboard(scored: dict[str, DataFrame], average: str = "weighted", by: str = "f1") -> DataFrame:
    """Models x metrics, ranked by ``by`` (descending; ties share a rank)."""
    parts = []
    for name, df in scored.items():
        a = averaged(df)
        parts.append(a.select(F.lit(name).alias("model"), "accuracy",
                              F.col(f"precision_{average}").alias("precision"),
                              F.col(f"recall_{average}").alias("recall"),
                              F.col(f"f1_{average}").alias("f1")))
    board = reduce(lambda x, y: x.unionByName(y), parts)
    # one row per model: the window is bounded by the number of models.
    return board.withColumn("rank", F.rank().over(Window.orderBy(F.desc(by))))
