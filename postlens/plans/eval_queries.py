"""Catalogue entries: evaluation aggregates and paired tests.

Models are replaced by deterministic pseudo-predictors over ``labels`` so the
metrics can be checked exactly: truth = toxic, A = 1 - quality, B = doc_id % 2.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.mathx import quantize
from ..operators import metrics, stats
from . import fixtures as fx
from .registry import register
from .sqlfrag import erfc, pct, q6, safe_div

T, A, B = fx.SQL_TRUTH, fx.SQL_PRED_A, fx.SQL_PRED_B


def scored_a(spark, sf_dir):
    return metrics.result_table(fx.truth(spark, sf_dir), fx.predictor_a(spark, sf_dir))


def scored_b(spark, sf_dir):
    return metrics.result_table(fx.truth(spark, sf_dir), fx.predictor_b(spark, sf_dir))


def _q(df, cols):
    return df.select(*[quantize(c).alias(c) if c not in ("label", "n", "tp", "support", "predicted")
                       else F.col(c) for c in cols])


@register("result_table", f"""
SELECT t.doc_id, t.label, p.prediction, t.label = p.prediction AS match
FROM {T} t JOIN {A} p ON t.doc_id = p.doc_id""")
def q_result_table(spark, sf_dir):
    return scored_a(spark, sf_dir)


_SCORED_A = f"(SELECT t.doc_id, t.label, p.prediction FROM {T} t JOIN {A} p ON t.doc_id = p.doc_id)"
_SCORED_B = f"(SELECT t.doc_id, t.label, p.prediction FROM {T} t JOIN {B} p ON t.doc_id = p.doc_id)"


@register("confusion", f"SELECT label, prediction, count(*) AS n FROM {_SCORED_A} GROUP BY label, prediction")
def q_confusion(spark, sf_dir):
    return metrics.confusion(scored_a(spark, sf_dir))


@register("accuracy", f"""
SELECT count(*) AS n, {q6("avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)")} AS accuracy
FROM {_SCORED_A}""")
def q_accuracy(spark, sf_dir):
    a = metrics.accuracy(scored_a(spark, sf_dir))
    return a.select("n", quantize("accuracy").alias("accuracy"))


def _per_class_sql(scored: str) -> str:
    return f"""
conf AS (SELECT label, prediction, count(*) AS n FROM {scored} GROUP BY label, prediction),
ts AS (SELECT label AS cls, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
       FROM conf GROUP BY label),
ps AS (SELECT prediction AS cls, sum(n) AS predicted FROM conf GROUP BY prediction),
pc AS (SELECT coalesce(ts.cls, ps.cls) AS label, CAST(coalesce(tp, 0) AS BIGINT) AS tp,
              CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(predicted, 0) AS BIGINT) AS predicted
       FROM ts FULL OUTER JOIN ps ON ts.cls = ps.cls),
pr AS (SELECT *, {safe_div("tp", "predicted")} AS precision, {safe_div("tp", "support")} AS recall FROM pc),
rep AS (SELECT *, {safe_div("2.0 * precision * recall", "precision + recall")} AS f1 FROM pr)"""


@register("class_report", f"""
WITH {_per_class_sql(_SCORED_A)}
SELECT label, tp, support, predicted, {q6("precision")} AS precision, {q6("recall")} AS recall,
       {q6("f1")} AS f1 FROM rep""")
def q_class_report(spark, sf_dir):
    rep = metrics.class_report(scored_a(spark, sf_dir))
    return _q(rep, ["label", "tp", "support", "predicted", "precision", "recall", "f1"])


def _avg_sql(m: str) -> str:
    micro = safe_div("sum(tp)", "sum(support)")
    return (f"{q6(f'coalesce(max(CASE WHEN label = 1 THEN {m} END), 0.0)')} AS {m}_binary, "
            f"{q6(f'avg({m})')} AS {m}_macro, {q6(micro)} AS {m}_micro, "
            f"{q6(safe_div(f'sum({m} * support)', 'sum(support)'))} AS {m}_weighted")


for _m in ("precision", "recall", "f1"):
    def _make(m):
        def q(spark, sf_dir):
            a = metrics.averaged(scored_a(spark, sf_dir))
            cols = [f"{m}_{avg}" for avg in metrics.AVERAGES]
            return a.select(*[quantize(c).alias(c) for c in cols])
        q.__name__ = f"q_{m}_avg"
        return q
    register(f"{_m}_avg", f"WITH {_per_class_sql(_SCORED_A)} SELECT {_avg_sql(_m)} FROM rep")(_make(_m))


@register("metrics_percent", f"""
WITH {_per_class_sql(_SCORED_A)},
a AS (SELECT {safe_div("sum(tp)", "sum(support)")} AS accuracy,
             {safe_div("sum(precision * support)", "sum(support)")} AS precision,
             {safe_div("sum(recall * support)", "sum(support)")} AS recall,
             {safe_div("sum(f1 * support)", "sum(support)")} AS f1 FROM rep),
p AS (SELECT {pct("accuracy")} AS accuracy_pct, {pct("precision")} AS precision_pct,
             {pct("recall")} AS recall_pct, {pct("f1")} AS f1_pct FROM a)
SELECT *, printf('Accuracy: %.2f%% Precision: %.2f%% Recall: %.2f%% F1 Score: %.2f%%',
                 accuracy_pct, precision_pct, recall_pct, f1_pct) AS summary FROM p""")
def q_metrics_percent(spark, sf_dir):
    return metrics.metrics_percent(scored_a(spark, sf_dir), "weighted")


@register("mcnemar", f"""
WITH j AS (SELECT t.doc_id, CAST(a.prediction = t.label AS INTEGER) AS ca, CAST(b.prediction = t.label AS INTEGER) AS cb
           FROM {T} t JOIN {A} a ON t.doc_id = a.doc_id JOIN {B} b ON t.doc_id = b.doc_id),
c AS (SELECT count(*) AS n, CAST(sum(CASE WHEN ca = 1 AND cb = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b,
             CAST(sum(CASE WHEN ca = 0 AND cb = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM j),
s AS (SELECT n, b, c,
             CASE WHEN b + c = 0 THEN 0.0 ELSE CAST(abs(b - c) AS DOUBLE) * CAST(abs(b - c) AS DOUBLE) / (b + c) END AS statistic,
             CASE WHEN b + c = 0 THEN 0.0 ELSE (CAST(abs(b - c) AS DOUBLE) - 1.0) * (CAST(abs(b - c) AS DOUBLE) - 1.0) / (b + c) END AS statistic_corrected
      FROM c)
SELECT n, b, c, {q6("statistic")} AS statistic, {q6("statistic_corrected")} AS statistic_corrected,
       {q6(erfc("sqrt(statistic / 2.0)"))} AS p_value, {q6(erfc("sqrt(statistic_corrected / 2.0)"))} AS p_value_corrected
FROM s""")
def q_mcnemar(spark, sf_dir):
    r = stats.mcnemar(fx.truth(spark, sf_dir), fx.predictor_a(spark, sf_dir), fx.predictor_b(spark, sf_dir))
    return r.select("n", "b", "c", *[quantize(c).alias(c) for c in
                                     ("statistic", "statistic_corrected", "p_value", "p_value_corrected")])


@register("mcnemar_exact", f"""
WITH j AS (SELECT CAST(a.prediction = t.label AS INTEGER) AS ca, CAST(b.prediction = t.label AS INTEGER) AS cb
           FROM {T} t JOIN {A} a ON t.doc_id = a.doc_id JOIN {B} b ON t.doc_id = b.doc_id),
c AS (SELECT count(*) AS n, CAST(sum(CASE WHEN ca = 1 AND cb = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b,
             CAST(sum(CASE WHEN ca = 0 AND cb = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM j)
SELECT n, b, c, {q6("least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(i)))")} AS p_exact
FROM c""")
def q_mcnemar_exact(spark, sf_dir):
    """The binomial form of the test, at any number of discordant rows."""
    r = stats.mcnemar(fx.truth(spark, sf_dir), fx.predictor_a(spark, sf_dir), fx.predictor_b(spark, sf_dir), exact_below=1 << 40)
    return r.select("n", "b", "c", quantize("p_exact").alias("p_exact"))


@register("cohens_d", f"""
WITH a AS (SELECT CAST(p.prediction = t.label AS INTEGER) AS correct FROM {T} t JOIN {A} p ON t.doc_id = p.doc_id),
b AS (SELECT CAST(p.prediction = t.label AS INTEGER) AS correct FROM {T} t JOIN {B} p ON t.doc_id = p.doc_id),
s AS (SELECT (SELECT count(correct) FROM a) AS n_a, (SELECT count(correct) FROM b) AS n_b,
             (SELECT avg(correct) FROM a) AS mean_a, (SELECT avg(correct) FROM b) AS mean_b,
             (SELECT var_samp(correct) FROM a) AS var_a, (SELECT var_samp(correct) FROM b) AS var_b),
p AS (SELECT *, sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS pooled_sd FROM s)
SELECT n_a, n_b, {q6("mean_a")} AS mean_a, {q6("mean_b")} AS mean_b, {q6("pooled_sd")} AS pooled_sd,
       {q6("CASE WHEN pooled_sd > 0 THEN (mean_a - mean_b) / pooled_sd ELSE 0.0 END")} AS d
FROM p""")
def q_cohens_d(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    a = stats.correctness(t, fx.predictor_a(spark, sf_dir))
    b = stats.correctness(t, fx.predictor_b(spark, sf_dir))
    r = stats.cohens_d(a, b)
    return r.select("n_a", "n_b", *[quantize(c).alias(c) for c in ("mean_a", "mean_b", "pooled_sd", "d")])


def _board_sql(name: str, scored: str) -> str:
    return f"""(WITH {_per_class_sql(scored)}
 SELECT '{name}' AS model, {safe_div("sum(tp)", "sum(support)")} AS accuracy,
        {safe_div("sum(precision * support)", "sum(support)")} AS precision,
        {safe_div("sum(recall * support)", "sum(support)")} AS recall,
        {safe_div("sum(f1 * support)", "sum(support)")} AS f1 FROM rep)"""


_SCORED_ZERO = f"(SELECT doc_id, label, 0 AS prediction FROM {T})"


@register("leaderboard", f"""
WITH b AS ({_board_sql('pseudo_a', _SCORED_A)} UNION ALL {_board_sql('pseudo_b', _SCORED_B)}
           UNION ALL {_board_sql('majority', _SCORED_ZERO)})
SELECT model, {q6("accuracy")} AS accuracy, {q6("precision")} AS precision, {q6("recall")} AS recall,
       {q6("f1")} AS f1, CAST(rank() OVER (ORDER BY {q6("f1")} DESC) AS INTEGER) AS rank FROM b""")
def q_leaderboard(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    zero = t.select("doc_id", F.lit(0).alias("prediction"))
    board = stats.leaderboard({
        "pseudo_a": scored_a(spark, sf_dir),
        "pseudo_b": scored_b(spark, sf_dir),
        "majority": metrics.result_table(t, zero),
    })
    q = board.select("model", *[quantize(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    from pyspark.sql import Window
    return q.withColumn("rank", F.rank().over(Window.orderBy(F.desc("f1"))))


@register("confusion_wide", f"""
SELECT label, CAST(sum(CASE WHEN prediction = 0 THEN n ELSE 0 END) AS BIGINT) AS "0",
       CAST(sum(CASE WHEN prediction = 1 THEN n ELSE 0 END) AS BIGINT) AS "1"
FROM (SELECT label, prediction, count(*) AS n FROM {_SCORED_B} GROUP BY label, prediction) c GROUP BY label""")
def q_confusion_wide(spark, sf_dir):
    return metrics.confusion_wide(scored_b(spark, sf_dir), [0, 1])


@register("argmax_scores", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS prediction FROM embeddings""")
def q_argmax_scores(spark, sf_dir):
    """The dense scorer's argmax (first index of the largest class score),
    applied to the pooled vectors as score vectors."""
    from ..operators.models import argmax_prediction
    e = fx.embeddings(spark, sf_dir)
    return e.select("vec_id", argmax_prediction("embedding").alias("prediction"))
