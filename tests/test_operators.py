"""Properties of feature, batching, metric and model operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from postlens.functions.features import tfidf_analyze
from postlens.operators import batching, metrics, models, splits, stats, vocab
from postlens.plans import fixtures as fx


def test_tfidf_rows_unit_or_zero(spark):
    d = fx.documents(spark, SF001).select("doc_id", tfidf_analyze("text").alias("tokens"))
    m = vocab.fit_tfidf(d, "tokens", 500)
    e = vocab.tfidf_entries(d, m, "doc_id", "tokens", 500)
    norms = e.select(F.aggregate("entries", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]).alias("n"))
    bad = norms.filter((F.abs(F.col("n") - 1.0) > 1e-9) & (F.col("n") != 0.0)).count()
    assert bad == 0
    assert e.count() == d.count()  # empty rows kept


def test_vocab_is_topk_by_tf(spark):
    d = fx.documents(spark, SF001).select(tfidf_analyze("text").alias("tokens"))
    v = vocab.vocab_fit(d, "tokens", 50).collect()
    assert len(v) == 50
    assert sorted(r.idx for r in v) == list(range(50))
    assert [r.term for r in sorted(v, key=lambda r: r.idx)] == sorted(r.term for r in v)


def test_folds_partition_keys(spark):
    lab = fx.labels(spark, SF01).select("doc_id")
    f = splits.fold_assign(lab, 5)
    assert f.count() == lab.count()
    assert {r.fold for r in f.select("fold").distinct().collect()} <= set(range(5))


def test_global_row_number_dense(spark):
    d = fx.documents(spark, SF01).select("doc_id")
    n = batching.assign_batches(d, ["doc_id"], 32)
    rows = n.orderBy("doc_id").collect()
    assert [r.row_number for r in rows] == list(range(1, len(rows) + 1))
    assert max(r.batch_id for r in rows) == (len(rows) - 1) // 32


def test_weighted_recall_is_accuracy(spark):
    s = metrics.result_table(fx.truth(spark, SF01), fx.predictor_a(spark, SF01))
    a = metrics.averaged(s).head()
    assert abs(a.recall_weighted - a.accuracy) < 1e-12
    assert abs(a.precision_micro - a.accuracy) < 1e-12
    conf = metrics.confusion(s).agg(F.sum("n")).head()[0]
    assert conf == s.count()


def test_metric_edge_cases(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "label int, prediction int")
    rep = {r.label: r for r in metrics.class_report(df).collect()}
    assert rep[0].precision == 0.0 and rep[0].recall == 0.0 and rep[0].f1 == 0.0  # never predicted
    allwrong = spark.createDataFrame([(0, 1), (1, 0)], "label int, prediction int")
    assert metrics.averaged(allwrong).head().accuracy == 0.0


def test_mcnemar_degenerate(spark):
    t = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    p = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, prediction int")
    r = stats.mcnemar(t, p, p).head()
    assert r.b == 0 and r.c == 0 and r.statistic == 0.0 and abs(r.p_value - 1.0) < 1e-6


def test_models_roundtrip(spark):
    from pyspark.ml.functions import array_to_vector
    e = fx.embeddings(spark, SF001).select("vec_id", array_to_vector("embedding").alias("features"),
                                           (F.col("label") % 2).alias("label"))
    m = models.fit_boosted(e, max_iter=3, max_depth=3)
    s = models.score(m, e, key="vec_id")
    assert s.count() == e.count()
    probs = m.transform(e).select("probability").collect()
    assert all(abs(sum(r.probability) - 1.0) < 1e-9 for r in probs)


def test_running_loss_hot_key_matches_plain_window(spark):
    """A third of the rows on one key: chunked result equals one window per key."""
    from pyspark.sql import Window
    ev = fx.events(spark, SF01).select(
        F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("user_id"),
        "event_id", "ts", "value")
    got = batching.running_loss(ev, "user_id", ["ts", "event_id"], "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = ev.select("event_id", F.row_number().over(w).alias("step"),
                     F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rs"),
                     F.avg("value").over(w.rowsBetween(-9, 0)).alias("tm"))
    j = got.join(want, "event_id")
    assert j.count() == ev.count()
    bad = j.filter((got["step"] != want["step"]) | (F.abs(F.col("running_sum") - F.col("rs")) > 1e-6)
                   | (F.abs(F.col("trailing_mean") - F.col("tm")) > 1e-6)).count()
    assert bad == 0


def test_encoder_hook_batches(spark):
    """Any Python encoder plugs in through predict_batch_udf (Arrow batches)."""
    import numpy as np

    from postlens.operators.embed import embed_with

    def make_fn():
        def f(texts):
            lengths = np.array([len(t) for t in texts], dtype=np.float32)
            return np.stack([lengths, lengths / 2.0], axis=1)
        return f

    d = fx.documents(spark, SF001).select("doc_id", "text")
    out = embed_with(d, make_fn, dim=2, batch_size=32)
    rows = out.join(d, "doc_id").collect()
    assert len(rows) == d.count()
    assert all(r.embedding[0] == float(len(r.text or "")) for r in rows)


def test_default_label_strings(spark):
    """Only missing labels get the default; a float of an integer is a label; other texts raise."""
    from postlens.operators.cleaning import default_label
    df = spark.createDataFrame([(1, "0"), (2, ""), (3, None), (4, " 1 "), (5, "1.0"), (6, "0.0")], "doc_id long, label string")
    got = {r.doc_id: r.label for r in default_label(df).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0}
    for bad in ("x", " ", "0.5"):
        with pytest.raises(Exception, match="not a label"):
            default_label(spark.createDataFrame([(1, bad)], "doc_id long, label string")).collect()


def test_lexicon_roundtrip_into_config(spark):
    from postlens.functions.tokenizer import DEFAULT, tokenize
    from postlens.sources.readers import lexicon_values, read_lexicon
    lex = read_lexicon(spark, items=["<o>  ", "", "<o>", ":)"])
    words = lexicon_values(lex)
    assert words == [":)", "<o>"]
    cfg = DEFAULT.with_lexicons(emoticons=words)
    df = spark.createDataFrame([("a<o>b",)], "t string")
    assert df.select(tokenize("t", cfg).alias("x")).head().x == ["a", "<o>", "b"]


def test_masks_leave_no_match(spark):
    from postlens.functions import text as tx
    d = fx.documents(spark, SF01).select("text")
    for kind in ("username", "time", "number"):
        masked = d.select(tx.mask("text", kind).alias("m"))
        pat = tx.jre(tx.MASK_PATTERNS[kind]())
        assert masked.filter(F.col("m").rlike(pat)).count() == 0, kind


def test_training_accuracy_beats_majority(spark):
    from pyspark.ml.functions import array_to_vector
    e = fx.embeddings(spark, SF001).select("vec_id", array_to_vector("embedding").alias("features"), "label")
    m = models.fit_dense(e, max_iter=50)
    scored = models.score(m, e, key="vec_id", keep=("label",), positive=None)
    acc = metrics.accuracy(scored).head().accuracy
    majority = e.groupBy("label").count().agg(F.max("count")).head()[0] / e.count()
    assert acc > majority


def test_save_load_gives_equal_predictions(spark):
    import __spark_entry__ as ent
    r = ent.queries()["save_model"](spark, SF001)
    assert r.count() > 0
    assert r.filter(~F.col("equal")).count() == 0


def test_spread_bounds_the_bytes_of_a_task(spark, tmp_path):
    from postlens.operators.joins import spread
    path = str(tmp_path / "rows.parquet")
    spark.range(200_000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "rows.parquet").glob("*.parquet"))
    dealt = spread(rows, "id", min_partitions=2, task_bytes=size // 40)
    assert dealt.rdd.getNumPartitions() >= 40 and dealt.count() == 200_000
    assert spread(rows, "id", min_partitions=2).rdd.getNumPartitions() == 2
