"""Evaluation: keyed result table, confusion counts and averaged metrics.

Only the first step (``confusion``: one partial + final aggregation over the
scored rows) touches data proportional to the input.  Everything after it
works on at most ``#classes^2`` rows, so the averages cost nothing at scale.
Predictions are always aligned with the truth by key, never by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import as_percent, safe_div

AVERAGES = ("binary", "macro", "micro", "weighted")


def result_table(truth: DataFrame, pred: DataFrame, key: str = "doc_id",
                 label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Truth + prediction + match flag, joined on the key.

    Every row of the truth stays: one that the model did not score has a null
    prediction and does not match, so leaving out hard rows does not help."""
    t = truth.select(key, F.col(label).alias("label"))
    p = pred.select(key, F.col(prediction).alias("prediction"))
    return t.join(p, key, "left").withColumn("match", F.coalesce(F.col("label") == F.col("prediction"), F.lit(False)))


def unscored(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row ``(n, n_unscored)``: rows, and rows without a prediction."""
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.col(prediction).isNull().cast("long")).alias("n_unscored"))


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` counts (long form)."""
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_wide(scored: DataFrame, classes: list[int], label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """Wide confusion matrix: one row per true label, one column per predicted
    class.  A prediction outside ``classes`` raises; it is never left out."""
    conf = confusion(scored, label, prediction)
    known = F.col("prediction").isin(*classes)
    bad = F.raise_error(F.concat(F.lit("unlisted class: "), F.coalesce(F.col("prediction").cast("string"), F.lit("null"))))
    conf = conf.withColumn("prediction", F.when(known, F.col("prediction")).otherwise(bad.cast("int")))
    return (conf.groupBy("label").pivot("prediction", classes).agg(F.sum("n"))
            .fillna(0))


def per_class(conf: DataFrame) -> DataFrame:
    """``(label, tp, support, predicted)`` for every class seen as truth or prediction.

    Each confusion cell contributes to its true class (support, tp) and to its
    predicted class (predicted); one aggregation over the exploded cells, so
    the confusion table is computed once and no join is needed.
    """
    cells = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.when(F.coalesce(F.col("label") == F.col("prediction"), F.lit(False)), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")),
    )
    # a row without a prediction (null) counts for its true class only
    e = conf.select(F.explode(cells).alias("e")).filter("e.cls is not null")
    return e.groupBy(F.col("e.cls").alias("label")).agg(
        F.sum("e.tp").cast("long").alias("tp"),
        F.sum("e.support").cast("long").alias("support"),
        F.sum("e.predicted").cast("long").alias("predicted"))


def class_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision, recall, F1 and support (undefined -> 0)."""
    pc = per_class(confusion(scored, label, prediction))
    p = safe_div(F.col("tp"), F.col("predicted"))
    r = safe_div(F.col("tp"), F.col("support"))
    pr = pc.select("label", "tp", "support", "predicted", p.alias("precision"), r.alias("recall"))
    f1 = safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return pr.withColumn("f1", f1)


def averaged(scored: DataFrame, label: str = "label", prediction: str = "prediction",
             pos_label: int = 1) -> DataFrame:
    """One row: accuracy and precision / recall / F1 under every average.

    Columns ``accuracy``, ``{precision,recall,f1}_{binary,macro,micro,weighted}``.
    binary = the ``pos_label`` class; macro = unweighted class mean;
    weighted = support-weighted mean (weighted recall equals accuracy);
    micro = pooled counts (equals accuracy for single-label data).
    """
    rep = class_report(scored, label, prediction)
    n = F.sum("support")
    aggs = [safe_div(F.sum("tp"), n).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [
            F.coalesce(F.max(F.when(F.col("label") == F.lit(pos_label), F.col(m))), F.lit(0.0)).alias(f"{m}_binary"),
            F.avg(m).alias(f"{m}_macro"),
            # pooled counts: every row has one truth and one prediction, so
            # sum(predicted) = sum(support) = n and micro P = R = F1 = accuracy.
            safe_div(F.sum("tp"), n).alias(f"{m}_micro"),
            safe_div(F.sum(F.col(m) * F.col("support")), n).alias(f"{m}_weighted"),
        ]
    return rep.agg(*aggs)


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of matching rows: one row ``(n, accuracy)``."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")).alias("accuracy"))


def metric(scored: DataFrame, name: str, average: str = "weighted", label: str = "label",
           prediction: str = "prediction", pos_label: int = 1) -> DataFrame:
    """One averaged metric (``precision``/``recall``/``f1``) as a one-row frame."""
    if average not in AVERAGES:
        raise ValueError(f"average must be one of {AVERAGES}")
    return averaged(scored, label, prediction, pos_label).select(f"{name}_{average}")


def metrics_percent(scored: DataFrame, average: str = "weighted", label: str = "label",
                    prediction: str = "prediction") -> DataFrame:
    """The four headline metrics x100 with two decimals, plus their text form."""
    a = averaged(scored, label, prediction)
    cols = {"accuracy": "accuracy", "precision": f"precision_{average}",
            "recall": f"recall_{average}", "f1": f"f1_{average}"}
    out = a.select(*[as_percent(src).alias(f"{k}_pct") for k, src in cols.items()])
    text = F.format_string("Accuracy: %.2f%% Precision: %.2f%% Recall: %.2f%% F1 Score: %.2f%%",
                           *[F.col(f"{k}_pct") for k in cols])
    return out.withColumn("summary", text)
