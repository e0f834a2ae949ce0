"""Persistence, transformers, epochs, stacking, sinks and readers on small rows."""

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from postlens.functions.tokenizer import DEFAULT, tokenize
from postlens.operators import batching, embed, metrics, models, splits, stack, stats, vocab
from postlens.operators.transformers import MessageTokenizer, TfidfAnalyzer
from postlens.sources.readers import drop_listed, read_labeled, read_lexicon
from postlens.sources.sinks import load_model, save_model, scratch_path, write_meta_features, write_table


def messages(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(("rude", "nasty", "mean") if bad else ("kind", "warm", "nice"), k=3) + rng.choices(("the", "sea", "road"), k=4)
        rows.append((i, " ".join(words), int(bad), [float(bad) + rng.random(), rng.random()]))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, vec array<double>")


def test_every_artifact_reloads(spark):
    """Vectorizer, boosted, dense and meta models load by the class their metadata names."""
    rows = messages(spark).withColumn("dense", array_to_vector("vec"))
    tokens = TfidfAnalyzer(inputCol="text", outputCol="tokens").transform(rows)
    vectorizer = vocab.tfidf_stages(vocab.fit_tfidf(tokens, "tokens", 50), "tokens", "features", 50)
    rows = vectorizer.transform(tokens).cache()
    boosted = models.fit_boosted(rows, max_iter=3, max_depth=2)
    dense = models.fit_dense(rows, "dense", max_iter=5)
    meta = models.fit_meta(rows.withColumn("meta_features", F.col("features")))
    for model in (vectorizer, boosted, dense, meta):
        loaded = load_model(save_model(model, scratch_path(spark, "artifact"), version="v1"))
        assert type(loaded) is type(model)
        df = rows.drop("features", "_tf", "_tfidf") if model is vectorizer else rows.withColumn("meta_features", F.col("features"))
        out = "features" if model is vectorizer else "prediction"
        assert [r[0] for r in loaded.transform(df).select(out).collect()] == [r[0] for r in model.transform(df).select(out).collect()]


def test_tokenizer_transformer_holds_its_settings(spark):
    from pyspark.ml import PipelineModel
    rows = spark.createDataFrame([(1, "@bob sooo COOL :) 42"), (2, None)], "doc_id long, text string")
    t = MessageTokenizer(inputCol="text", outputCol="toks", usernames="", numbers="N", emoticons=[":)"], lowercase=False)
    cfg = DEFAULT.update(usernames="", numbers="N", emoticons=(":)",), lowercase=False)
    want = [r[0] for r in rows.select(tokenize("text", cfg)).collect()]
    path = save_model(PipelineModel(stages=[t]), scratch_path(spark, "tokenizer"))
    loaded = load_model(path)
    assert [r.toks for r in loaded.transform(rows).collect()] == want == [r.toks for r in t.transform(rows).collect()]
    assert loaded.stages[0].config() == cfg
    with pytest.raises(TypeError):
        MessageTokenizer(nosuch=1)
    with pytest.raises(Exception, match="strict"):
        MessageTokenizer(strict=True).transform(rows).collect()


def test_epochs_are_saved_and_continue(spark):
    rows = messages(spark).withColumn("dense", array_to_vector("vec"))
    path = scratch_path(spark, "epochs")
    last = models.fit_dense_epochs(rows, path, epochs=3, features="dense")
    assert list(load_model(f"{path}/epoch-3").weights) == list(last.weights)
    assert list(load_model(f"{path}/epoch-1").weights) != list(last.weights)


def test_loss_log_feeds_running_loss(spark):
    rows = messages(spark).withColumn("meta_features", array_to_vector("vec"))
    log = models.loss_log(spark, models.fit_meta(rows))
    out = batching.running_loss(log, "epoch", ["step_no"], "loss").orderBy("step").collect()
    assert [r.step for r in out] == list(range(1, log.count() + 1))
    assert out[-1].running_sum == pytest.approx(sum(r.loss for r in out))


def test_stacking_never_fits_what_it_scores(spark):
    rows = splits.label_split(messages(spark, 120).withColumn("dense", array_to_vector("vec")))
    train, test = rows.filter("split = 'train'"), rows.filter("split != 'train'")
    seen = []

    def fit(df):
        seen.append({r.doc_id for r in df.select("doc_id").collect()})
        return models.fit_dense(df, "dense", max_iter=3, num_classes=2)

    meta, finals, oof = models.stack_oof(train, {"a": fit, "b": fit}, k=3)
    keys = {r.doc_id for r in train.collect()}
    assert len(seen) == 8 and all(s <= keys for s in seen) and meta.numFeatures == 2
    assert {r.doc_id for r in oof.collect()} == keys
    assert sum(s == keys for s in seen) == 2 and sum(len(keys - s) for s in seen) == 2 * len(keys)  # the folds part the rows
    assert models.score_stack(meta, finals, test).count() == test.count()


def test_copies_share_folds_and_only_the_text_guard_sees_them(spark):
    """Copies across splits: the keys are disjoint, the texts are not; dealt by text, neither is shared."""
    rows = spark.createDataFrame([(i, f"text {i % 20 if i < 200 else i}") for i in range(400)], "doc_id long, text string")
    by_key = splits.label_split(rows)
    train, test = (by_key.filter(F.col("split") == s) for s in ("train", "test"))
    assert splits.split_overlap(train, test, ["doc_id"]).first().n_shared == 0
    assert splits.split_overlap(train, test, ["text"]).first().n_shared > 0
    by_text = splits.label_split(rows, key=F.col("text"))
    assert splits.split_overlap(*(by_text.filter(F.col("split") == s) for s in ("train", "test")), ["text"]).first().n_shared == 0
    hot = rows.unionByName(spark.createDataFrame([(1000 + i, None) for i in range(150)], rows.schema))  # one class of over a quarter
    dealt = splits.group_folds(hot, 3, "text")
    per_text = dealt.groupBy("text").agg(F.countDistinct("fold").alias("n"))
    assert per_text.filter("n > 1").count() == 0
    sizes = [r["count"] for r in dealt.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) < 0.5 * sum(sizes)


def test_dense_model_is_right_on_held_out_rows(spark):
    rows = splits.label_split(messages(spark, 300).withColumn("dense", array_to_vector("vec")))
    m = models.fit_dense(rows.filter("split = 'train'"), "dense", num_classes=2)
    told = m.transform(rows.filter("split != 'train'")).agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("right"), F.avg("label").alias("ones")).first()
    assert told.right > max(told.ones, 1 - told.ones) + 0.1


def test_fits_run_side_by_side_and_artifacts_are_fitted_once(spark):
    import threading
    import time

    from postlens.plans import artifacts
    both = threading.Barrier(2, timeout=60)
    assert models.concurrently(spark, {"a": both.wait, "b": both.wait}, threads=2).keys() == {"a", "b"}
    fits = []

    def fit():
        fits.append(1)
        time.sleep(1)
        return spark.range(3)

    jobs = {i: lambda: artifacts.table(spark, "once", "/no/such/folder", {"t": 1}, fit).count() for i in range(4)}
    assert models.concurrently(spark, jobs) == dict.fromkeys(range(4), 3) and len(fits) == 1


def test_many_classes_are_boosted(spark):
    rows = spark.createDataFrame([(float(i % 3), [float(i % 3) + 0.01 * (i % 7), 1.0]) for i in range(90)], "label double, v array<double>")
    rows = rows.withColumn("features", array_to_vector("v"))
    m = models.fit_boosted(rows, max_iter=3, max_depth=2)
    assert len(m.models) == 3 and m.transform(rows).filter("prediction != label").count() == 0


def test_exact_mcnemar(spark):
    from math import comb
    for b, c in ((0, 0), (1, 0), (5, 2), (3, 3), (12, 12), (24, 0), (20, 5)):
        n = b + c
        truth = spark.createDataFrame([(i, 1) for i in range(n + 4)], "doc_id long, label int")
        a = spark.createDataFrame([(i, int(i < b or i >= n)) for i in range(n + 4)], "doc_id long, prediction int")
        z = spark.createDataFrame([(i, int(i >= b)) for i in range(n + 4)], "doc_id long, prediction int")
        r = stats.mcnemar(truth, a, z).first()
        assert (r.b, r.c) == (b, c)
        want = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
        assert r.p_exact == (pytest.approx(want, rel=1e-9) if n < 25 else None)


def test_trie_matches_the_longest_entry():
    import re

    from postlens.functions.tokenizer import trie_pattern
    rng = random.Random(8)
    entries = {"".join(rng.choices(":-)(]x|*.", k=rng.randint(1, 5))) for _ in range(300)}
    plain = re.compile("|".join(map(re.escape, sorted(entries, key=lambda e: (-len(e), e)))))
    trie = re.compile(trie_pattern(entries))
    for _ in range(300):
        text = "".join(rng.choices(":-)(]x|*. a", k=40))
        assert trie.findall(text) == plain.findall(text)


def test_refit_takes_the_penalty(spark):
    rows = messages(spark).withColumn("meta_features", array_to_vector("vec"))
    m = models.fit_meta(rows, c=10.0)
    again = models.refit_meta(m, rows.select("meta_features", F.col("label").cast("double").alias("label")), c=10.0)
    assert again.getRegParam() == pytest.approx(1 / (10 * 60)) and again.coefficients.toArray() == pytest.approx(m.coefficients.toArray())


def test_stacked_matrix_keeps_unmatched_rows_and_fits_small_vocabularies(spark):
    rows = TfidfAnalyzer().transform(messages(spark, 12))
    model = vocab.fit_tfidf(rows, "tokens", 11024)
    vectors = vocab.tfidf_vector(rows, model, "tokens", "features")
    dense = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    out = stack.stack_vectors(vectors, dense, vocab.width(model), 2)
    assert out.count() == 12 and {len(r.meta_features) for r in out.collect()} == {model.count() + 2}
    told = stack.unmatched(vectors, dense).first()
    assert (told.n_rows, told.n_unmatched) == (12, 7)


def test_meta_features_as_csv(spark):
    rows = messages(spark, 5).withColumn("meta_features", array_to_vector("vec"))
    path = scratch_path(spark, "meta-csv")
    write_meta_features(rows, path, fmt="csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    assert back.columns == ["doc_id", "f0", "f1"]
    assert {(r.doc_id, r.f0, r.f1) for r in back.collect()} == {(r.doc_id, *r.vec) for r in rows.collect()}


def test_csv_cells_and_keys(spark):
    cells = ["  lead", "trail  ", " ", "", None, 'say "hi", you', "two\nlines", "\\"]
    path = scratch_path(spark, "cells")
    write_table(spark.createDataFrame([(c, "1.0") for c in cells], "text string, label string"), path, mode="overwrite")
    one = read_labeled(spark, path)
    assert sorted(map(str, (r.text for r in one.collect()))) == sorted(map(str, cells))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in read_labeled(spark, path).repartition(3).collect()}


def test_lexicons_strip_white_space_and_join(spark):
    path = scratch_path(spark, "lexicon")
    spark.createDataFrame([("a\t",), ("\t",), ("b  ",), (" c",), ("a",)], "value string").write.text(path)
    assert sorted(r.word for r in read_lexicon(spark, path).collect()) == [" c", "a", "b"]
    assert sorted(r.word for r in read_lexicon(spark, path, strip="both").collect()) == ["a", "b", "c"]
    rows = spark.createDataFrame([(1, ["x", "a", "y", "a"]), (2, ["b"]), (3, [])], "doc_id long, tokens array<string>")
    got = {r.doc_id: r.tokens for r in drop_listed(rows, read_lexicon(spark, path)).collect()}
    assert got == {1: ["x", "y"], 2: [], 3: []}


def test_running_loss_with_nulls_and_large_values(spark):
    rows = [("big", i, 1e12 if i < 2000 else 0.13) for i in range(2100)]
    rows += [("gap", i, None if i % 5 in (0, 3) else float(i)) for i in range(120)] + [("none", 0, None)]
    log = spark.createDataFrame(rows, "part string, i int, v double")
    got = {(r.part, r.i): r for r in batching.running_loss(log, "part", ["i"], "v", chunks=7).collect()}
    for part in ("big", "gap", "none"):
        values = [v for p, _, v in rows if p == part]
        for i in range(len(values)):
            upto, near = [v for v in values[:i + 1] if v is not None], [v for v in values[max(0, i - 9):i + 1] if v is not None]
            r = got[part, i]
            assert r.step == i + 1
            assert r.running_sum == (pytest.approx(sum(upto)) if upto else None)
            assert r.trailing_mean == (pytest.approx(sum(near) / len(near), rel=1e-12) if near else None)


def test_unscored_rows_count_as_wrong(spark):
    truth = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int")
    pred = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, prediction int")
    scored = metrics.result_table(truth, pred)
    assert tuple(metrics.unscored(scored).first()) == (10, 4)
    a = metrics.averaged(scored).first()
    assert a.accuracy == a.recall_weighted == pytest.approx(0.6) == metrics.accuracy(scored).first().accuracy
    assert stats.mcnemar(truth, pred, truth.withColumnRenamed("label", "prediction")).first().c == 4
    with pytest.raises(Exception, match="unlisted class"):
        metrics.confusion_wide(scored, [0, 1]).collect()


def test_bounded_vocabulary_of_the_encoder(spark):
    rows = TfidfAnalyzer().transform(messages(spark))
    enc = embed.fit_word2vec(rows, "tokens", dim=4, vocabulary=5)
    assert 0 < enc.getVectors().count() <= 5
    with pytest.raises(ValueError):
        vocab.tfidf_stages(vocab.fit_tfidf(rows, "tokens", 8), k=4)
