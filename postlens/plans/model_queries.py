"""Catalogue entries: model fit / score / stack / persistence.

Learners do not give the same digits in two engines.  Their queries therefore
return what must hold of them (keys, labels and splits of the scored rows,
probabilities that sum to one, argmax, sizes of the fitted models, a vanishing
gradient, quality above the majority share), which the oracle states from the
tables.  All fits run at full strength.  ``tfidf_vector`` and the stacked
matrix have exact oracles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import tfidf_analyze
from ..functions.mathx import quantize
from ..operators import metrics, models, splits, stack, stats, vocab
from ..sources.readers import read_csv
from ..sources.sinks import load_model, save_model, scratch_path, write_table
from . import artifacts
from . import fixtures as fx
from .feature_queries import K, TEXT_SPLIT, TOK, _TFIDF_CTE, split_by_text, train_model
from .registry import register
from .sqlfrag import q6, split_case

#: Messages with a label and their split (by text), for oracles.
SQL_SPLIT = f"""(SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS label, {TEXT_SPLIT} AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SQL_ALL = f"""(SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS label, {TEXT_SPLIT} AS split
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _vectors(spark, sf_dir, labelled: bool = True):
    """Messages with TF-IDF vectors (vocabulary fitted on the train split)."""
    model = train_model(spark, sf_dir)
    rows = (fx.labelled_messages if labelled else fx.messages)(spark, sf_dir)
    rows = split_by_text(rows).select("doc_id", tfidf_analyze("text").alias("tokens"), "label", "split")
    return vocab.tfidf_vector(rows, model, "tokens", "features", K)


def _stacked(spark, sf_dir, labelled: bool = True):
    """The stacked feature matrix; its sparse width is that of the fitted vocabulary."""
    e = fx.embeddings(spark, sf_dir)
    return stack.stack_vectors(_vectors(spark, sf_dir, labelled), e, vocab.width(train_model(spark, sf_dir)), _dense_width(e))


def _dense_width(embeddings) -> int:
    return embeddings.select(F.size("embedding").alias("n")).head()["n"]


@register("tfidf_vector", f"""
WITH {_TFIDF_CTE}
SELECT w.doc_id, w.idx, {q6("w.w / nrm.nrm")} AS weight FROM w JOIN nrm ON w.doc_id = nrm.doc_id""")
def q_tfidf_vector(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", tfidf_analyze("text").alias("tokens"))
    v = vocab.tfidf_vector(docs, train_model(spark, sf_dir), "tokens", "features", K)
    entries = v.select("doc_id", F.explode(vocab.sparse_entries("features")).alias("e"))
    return entries.select("doc_id", F.col("e.idx").alias("idx"), quantize("e.weight").alias("weight"))


def checked_scores(model, df, key="doc_id", keep=("label", "split")):
    """``key``, ``keep`` and what must hold of every scored row."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    p = vector_to_array("probability")
    return out.select(key, *keep,
                      (F.col("prediction").cast("int") == models.argmax_prediction(p)).alias("is_argmax"),
                      (F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"))


def beats_majority(model, df, label="label") -> bool:
    """Whether the model is right on at least the largest class's share of the rows."""
    r = model.transform(df).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    row = r.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("right"), F.avg("y").alias("ones")).head()
    return bool(row["right"] >= max(row["ones"], 1 - row["ones"]) - 1e-12)


# -- sparse branch ---------------------------------------------------------------

def boosted_model(spark, sf_dir):
    """100 trees of depth 6 fitted on the train split (saved once per session
    and input; scoring jobs load it, as the reference's test script does)."""
    return artifacts.model(spark, "boosted", sf_dir, {"k": K},
                           lambda: models.fit_boosted(_vectors(spark, sf_dir).filter(F.col("split") == "train"), num_classes=2),
                           load_model)


@register("fit_boosted", f"""
WITH {_TFIDF_CTE}
SELECT 100 AS n_trees, CAST((SELECT count(*) FROM voc) AS INTEGER) AS n_features, TRUE AS beats_majority""")
def q_fit_boosted(spark, sf_dir):
    m = boosted_model(spark, sf_dir)
    good = beats_majority(m, _vectors(spark, sf_dir).filter(F.col("split") == "train"))
    return spark.createDataFrame([(m.getNumTrees, m.numFeatures, good)], "n_trees int, n_features int, beats_majority boolean")


@register("score_boosted", f"SELECT doc_id, label, split, TRUE AS is_argmax, TRUE AS sums_to_one FROM {SQL_ALL}")
def q_score_boosted(spark, sf_dir):
    return checked_scores(boosted_model(spark, sf_dir), _vectors(spark, sf_dir, labelled=False))


@register("fit_boosted_multiclass", """
SELECT CAST(max(label) + 1 AS INTEGER) AS n_classes, 100 AS n_trees, CAST(max(len(embedding)) AS INTEGER) AS n_features, TRUE AS beats_majority
FROM embeddings""")
def q_fit_boosted_multiclass(spark, sf_dir):
    """One boosted model per class of the ``embeddings`` (100 trees of depth 6 each), the likeliest class wins."""
    rows = _dense(spark, sf_dir).filter(F.col("split") == "train")
    m = artifacts.model(spark, "boosted-classes", sf_dir, {}, lambda: models.fit_boosted(rows, parallelism=8), load_model)
    told = m.transform(rows).select((F.col("prediction") == F.col("label")).cast("double").alias("right"), "label")
    share = told.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("s")).head()["s"]
    right = told.agg(F.avg("right").alias("r")).head()["r"]
    return spark.createDataFrame([(len(m.models), min(x.getNumTrees for x in m.models), m.models[0].numFeatures, right > share)],
                                 "n_classes int, n_trees int, n_features int, beats_majority boolean")


# -- dense branch ----------------------------------------------------------------

def _dense(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = splits.label_split(fx.embeddings(spark, sf_dir), key="vec_id")
    return e.select("vec_id", array_to_vector("embedding").alias("features"), "label", "split")


def dense_model(spark, sf_dir):
    """The dense classifier of the ``embeddings`` classes, 30 epochs, saved once."""
    return artifacts.model(spark, "dense", sf_dir, {"max_iter": 30},
                           lambda: models.fit_dense(_dense(spark, sf_dir).filter(F.col("split") == "train"), max_iter=30), load_model)


@register("fit_dense", """
SELECT CAST(max(len(embedding)) AS INTEGER) AS n_features, CAST(max(label) + 1 AS INTEGER) AS n_classes, 3 AS n_layers,
       TRUE AS beats_majority FROM embeddings""")
def q_fit_dense(spark, sf_dir):
    m = dense_model(spark, sf_dir)
    # On the fitted rows: the table's labels are all but independent of its vectors (README), so no model
    # is right more often on held-out ones; tests/test_models_io.py has a fixture that can be learned.
    told = m.transform(_dense(spark, sf_dir)).filter(F.col("split") == "train")
    share = told.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("s")).head()["s"]
    right = told.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("r")).head()["r"]
    return spark.createDataFrame([(int(m.numFeatures), int(m.numClasses), len(m.getLayers()), right > share)],
                                 "n_features int, n_classes int, n_layers int, beats_majority boolean")


@register("fit_dense_epochs", """
SELECT CAST(e AS INTEGER) AS epoch, max(len(embedding)) || '-32-' || (max(label) + 1) AS layers, TRUE AS same_after_loading,
       e > 1 AS moved FROM embeddings, range(1, 31) AS r(e) GROUP BY e""")
def q_fit_dense_epochs(spark, sf_dir):
    """The dense classifier fitted epoch by epoch and saved after each of 30: every save is loaded, has
    the layers, differs from the one before, and the last equals the fitted model."""
    path = scratch_path(spark, "epochs")
    last = models.fit_dense_epochs(_dense(spark, sf_dir).filter(F.col("split") == "train"), path, epochs=30)
    loaded = [load_model(f"{path}/epoch-{e}") for e in range(1, 31)]
    weights = [m.weights.toArray() for m in loaded]
    told = [(e, "-".join(map(str, m.getLayers())), bool(e < 30 or (weights[-1] == last.weights.toArray()).all()),
             bool(e > 1 and (weights[e - 1] != weights[e - 2]).any())) for e, m in enumerate(loaded, 1)]
    return spark.createDataFrame(told, "epoch int, layers string, same_after_loading boolean, moved boolean")


@register("score_dense", f"""
SELECT vec_id, label, {split_case("vec_id")} AS split, TRUE AS is_argmax, TRUE AS sums_to_one FROM embeddings""")
def q_score_dense(spark, sf_dir):
    return checked_scores(dense_model(spark, sf_dir), _dense(spark, sf_dir), "vec_id")


# -- stacked branch --------------------------------------------------------------

def meta_model(spark, sf_dir):
    """Meta logistic regression on train and validate (saved once per session)."""
    return artifacts.model(spark, "meta", sf_dir, {"k": K},
                           lambda: models.fit_meta(_stacked(spark, sf_dir).filter(F.col("split") != "test")), load_model)


def gradient_norm(model, df, features: str = "meta_features", label: str = "label", c: float = 1.0) -> float:
    """Largest entry of the gradient of the penalised objective at the fitted
    weights; the objective is convex, so zero means fitted.  Only the stored
    entries of the vectors become rows."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(df).select(
        (vector_to_array("probability")[1] - F.col(label).cast("double")).alias("d"),
        F.explode(vocab.sparse_entries(features)).alias("e"))
    n = df.count()
    sums = scored.groupBy(F.col("e.idx").alias("i")).agg((F.sum(F.col("d") * F.col("e.weight")) / n).alias("g"))
    weights = df.sparkSession.createDataFrame(list(enumerate(map(float, model.coefficients.toArray()))), "i int, w double")
    return weights.join(sums, "i", "left").agg(
        F.max(F.abs(F.coalesce("g", F.lit(0.0)) + F.col("w") / (c * n))).alias("m")).head()["m"]


@register("fit_meta", f"""
WITH {_TFIDF_CTE}
SELECT CAST((SELECT count(*) FROM voc) + (SELECT max(len(embedding)) FROM embeddings) AS INTEGER) AS n_features,
       TRUE AS converged""")
def q_fit_meta(spark, sf_dir):
    m = meta_model(spark, sf_dir)
    fitted = _stacked(spark, sf_dir).filter(F.col("split") != "test")
    return spark.createDataFrame([(int(m.numFeatures), gradient_norm(m, fitted) < 1e-3)], "n_features int, converged boolean")


@register("score_meta", f"SELECT doc_id, label, split, TRUE AS is_argmax, TRUE AS sums_to_one FROM {SQL_ALL}")
def q_score_meta(spark, sf_dir):
    return checked_scores(meta_model(spark, sf_dir), _stacked(spark, sf_dir, labelled=False))


def _base_rows(spark, sf_dir):
    """Labelled messages with tokens and dense vector (zeros without one)."""
    from pyspark.ml.functions import array_to_vector
    e = fx.embeddings(spark, sf_dir)
    zeros = F.array_repeat(F.lit(0.0), _dense_width(e))
    rows = split_by_text(fx.labelled_messages(spark, sf_dir)).select(
        "doc_id", tfidf_analyze("text").alias("tokens"), "label", "split", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    dense = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("_e"))
    return rows.join(dense, "doc_id", "left").withColumn("dense", array_to_vector(F.coalesce("_e", zeros))).drop("_e")


def fit_sparse_base(df):
    """Vectorizer and boosted trees, both fitted on the rows given."""
    from pyspark.ml import PipelineModel
    terms = vocab.fit_tfidf(df.select("tokens"), "tokens", K).cache()
    vectorizer = vocab.tfidf_stages(terms, "tokens", "features", K)
    trees = models.fit_boosted(vectorizer.transform(df), num_classes=2)
    terms.unpersist()
    return PipelineModel(stages=[*vectorizer.stages, trees])


def fit_dense_base(df):
    """The dense classifier on the rows given."""
    return models.fit_dense(df, "dense", num_classes=2)


BASES = {"sparse": fit_sparse_base, "dense": fit_dense_base}


def branch_table(spark, sf_dir):
    """Scores of every branch on the test split, written once per session: the
    out-of-fold stack and its bases, which were fitted on the whole train split
    for it.  ``(branch, doc_id, label, prediction, p_positive, n_shared)``."""
    def fit():
        rows = _base_rows(spark, sf_dir).persist()
        train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
        meta, finals, _ = models.stack_oof(train, BASES, group="content", threads=8)
        shared = splits.split_overlap(train, test, ["content"])
        scored = {"stacked": models.score_stack(meta, finals, test), **{n: models.score(m, test) for n, m in finals.items()}}
        named = [s.select(F.lit(n).alias("branch"), "doc_id", "label", "prediction", "p_positive") for n, s in scored.items()]
        return reduce(lambda x, y: x.unionByName(y), named).withColumn("n_shared", shared.select("n_shared").scalar())
    return artifacts.table(spark, "branches", sf_dir, {"k": K, "folds": 3, "group": "content"}, fit)


@register("stack_oof", f"""
SELECT doc_id, label, CAST(0 AS BIGINT) AS n_shared, TRUE AS is_probability FROM {SQL_SPLIT} WHERE split = 'test'""")
def q_stack_oof(spark, sf_dir):
    """Out-of-fold stacking of both bases: fitted on the train split, scored on
    the test split, copies of a text in one fold and one split; the guard counts
    the texts that both splits have."""
    s = branch_table(spark, sf_dir).filter(F.col("branch") == "stacked")
    return s.select("doc_id", "label", "n_shared", F.col("p_positive").between(0, 1).alias("is_probability"))


@register("refit_meta", f"""
SELECT doc_id, label, CAST(0 AS BIGINT) AS n_shared, TRUE AS is_argmax, TRUE AS sums_to_one
FROM {SQL_SPLIT} WHERE split = 'test'""")
def q_refit_meta(spark, sf_dir):
    """The saved meta-model refitted on the validate split, scored on the test
    split; the guard compares the texts fitted with the texts scored."""
    s = _stacked(spark, sf_dir)
    fitted, scored = s.filter(F.col("split") == "validate"), s.filter(F.col("split") == "test")
    m = models.refit_meta(meta_model(spark, sf_dir), fitted.select("meta_features", F.col("label").cast("double").alias("label")))
    texts = split_by_text(fx.labelled_messages(spark, sf_dir))
    overlap = splits.split_overlap(texts.filter(F.col("split") == "validate"), texts.filter(F.col("split") == "test"), ["text"])
    out = checked_scores(m, scored, keep=("label",))
    return out.withColumn("n_shared", overlap.select("n_shared").scalar())


# -- branch evaluation -----------------------------------------------------------

def branch_scores(spark, sf_dir):
    """Test-split rows scored by each branch: name -> (doc_id, label, prediction)."""
    truth = split_by_text(fx.labelled_messages(spark, sf_dir)).filter(F.col("split") == "test").select("doc_id", "label")
    scored = branch_table(spark, sf_dir)
    return {name: metrics.result_table(truth, scored.filter(F.col("branch") == name).select("doc_id", "prediction"))
            for name in (*BASES, "stacked")}


@register("evaluate_branches", f"""
SELECT b AS branch, count(*) AS n, CAST(0 AS BIGINT) AS n_unscored, CAST(sum(label) AS BIGINT) AS n_positive, TRUE AS metrics_agree
FROM {SQL_SPLIT}, (VALUES ('sparse'), ('dense'), ('stacked')) AS v(b) WHERE split = 'test' GROUP BY b""")
def q_evaluate_branches(spark, sf_dir):
    """Each branch on the held-out split: its predictions are written, read
    back and counted; rows, unscored rows, positives, and whether the averaged
    metrics equal those worked out from the counts in the file."""
    parts = []
    for name, scored in branch_scores(spark, sf_dir).items():
        path = scratch_path(spark, f"predictions-{name}")
        write_table(scored.select("doc_id", "label", "prediction"), path, "csv", mode="overwrite")
        back = read_csv(spark, path, T.StructType.fromDDL("doc_id long, label int, prediction int"))
        y, p = F.col("label"), F.col("prediction")
        n = back.agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("n_unscored"), F.sum(y).cast("long").alias("n_positive"),
                     F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                     F.count_if((y == 1) & ((p != 1) | p.isNull())).alias("fn"), F.count_if(y == p).alias("right"))
        counted = {"accuracy": F.col("right") / F.col("n"), "recall_weighted": F.col("right") / F.col("n"),
                   "precision_binary": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall_binary": F.try_divide("tp", F.col("tp") + F.col("fn")),
                   "f1_binary": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
        a = metrics.averaged(scored).select(*counted)
        same = F.lit(True)
        for c, value in counted.items():
            same = same & (F.abs(a.select(c).scalar() - F.coalesce(value, F.lit(0.0))) < 1e-12)
        parts.append(n.select(F.lit(name).alias("branch"), "n", "n_unscored", "n_positive", same.alias("metrics_agree")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("branch_leaderboard")
def q_branch_leaderboard(spark, sf_dir):
    """The branches ranked by F1 of the positive class on the held-out split."""
    return stats.leaderboard(branch_scores(spark, sf_dir), average="binary")


@register("branch_mcnemar")
def q_branch_mcnemar(spark, sf_dir):
    """McNemar's test of the stacked branch against either base."""
    scored = branch_scores(spark, sf_dir)
    truth = scored["stacked"].select("doc_id", "label")
    parts = [stats.mcnemar(truth, scored["stacked"], scored[name]).select(F.lit(name).alias("against"), "*") for name in ("sparse", "dense")]
    return parts[0].unionByName(parts[1])


# -- persistence -----------------------------------------------------------------

@register("save_model", f"SELECT doc_id, TRUE AS equal FROM {SQL_ALL}")
def q_save_model(spark, sf_dir):
    """One saved pipeline from text to prediction (analyzer, vectorizer, learner),
    loaded again: equal predictions for every message."""
    path = save_model(text_pipeline(spark, sf_dir), scratch_path(spark, "model"), version="v1")
    loaded = load_model(path)
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    a = models.score(text_pipeline(spark, sf_dir), docs, keep=()).select("doc_id", F.col("prediction").alias("before"), F.col("p_positive").alias("p"))
    b = models.score(loaded, docs, keep=()).select("doc_id", F.col("prediction").alias("after"), F.col("p_positive").alias("q"))
    return a.join(b, "doc_id").select("doc_id", ((F.col("before") == F.col("after")) & (F.col("p") == F.col("q"))).alias("equal"))


def text_pipeline(spark, sf_dir):
    """Text -> prediction as one ``PipelineModel`` (the sparse features and a
    logistic learner), fitted on the train split, saved once per session."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from ..operators.transformers import TfidfAnalyzer

    def fit():
        docs = split_by_text(fx.labelled_messages(spark, sf_dir))
        front = PipelineModel(stages=[TfidfAnalyzer(inputCol="text", outputCol="tokens"),
                                      *vocab.tfidf_stages(train_model(spark, sf_dir), "tokens", "features", K).stages])
        train = front.transform(docs.filter(F.col("split") == "train")).select("features", F.col("label").cast("double").alias("label"))
        return PipelineModel(stages=[*front.stages, LogisticRegression(regParam=1e-3).fit(train)])
    return artifacts.model(spark, "text-pipeline", sf_dir, {"k": K}, fit, load_model)


@register("training_loss", "SELECT TRUE AS has_steps, TRUE AS falls")
def q_training_loss(spark, sf_dir):
    """The meta fit's loss per iteration as a metric log, through ``running_loss``."""
    from ..operators.batching import running_loss
    fitted = models.fit_meta(_stacked(spark, sf_dir).filter(F.col("split") == "train"))
    log = models.loss_log(spark, fitted)
    out = running_loss(log, "epoch", ["step_no"], "loss", every=10)
    last = out.orderBy(F.desc("step")).limit(1)
    first = out.filter("step = 1")
    return out.agg((F.count("*") > 1).alias("has_steps")).select(
        "has_steps", (last.select("loss").scalar() < first.select("loss").scalar()).alias("falls"))


@register("embed_dense", "SELECT doc_id, 64 AS dim, TRUE AS is_finite FROM documents")
def q_embed_dense(spark, sf_dir):
    """Built-in encoder: Word2Vec fitted on the train split, mean-pooled
    vectors for every document (shape of the ``embeddings`` table)."""
    from ..operators.embed import embed_dense, fit_word2vec
    docs = split_by_text(fx.documents(spark, sf_dir)).select("doc_id", tfidf_analyze("text").alias("tokens"), "split")
    enc = fit_word2vec(docs.filter(F.col("split") == "train"), "tokens", dim=64)
    out = embed_dense(docs, enc, "doc_id", "tokens")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("doc_id", F.size("embedding").alias("dim"), (total.isNotNull() & ~F.isnan(total)).alias("is_finite"))


@register("cooccur_ppmi", f"""
WITH toks AS (SELECT doc_id, unnest({TOK}) AS term, generate_subscripts({TOK}, 1) AS pos FROM documents),
far AS (SELECT doc_id, term, pos, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM toks),
pairs AS (SELECT a.term, b.term AS other, count(*) AS n
          FROM far AS a JOIN toks AS b ON a.doc_id = b.doc_id AND a.pos + a.d = b.pos GROUP BY ALL),
sums AS (SELECT term, sum(n) AS r FROM pairs GROUP BY term),
seen AS (SELECT p.term, p.other, CAST(n AS DOUBLE) * CAST((SELECT sum(n) FROM pairs) AS DOUBLE) AS seen,
                CAST(a.r AS DOUBLE) * CAST(b.r AS DOUBLE) AS chance
         FROM pairs AS p JOIN sums AS a ON p.term = a.term JOIN sums AS b ON p.other = b.term)
SELECT term, count(*) AS n_others, CAST(sum(CAST(floor(ln(seen / chance) * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS micro_ppmi
FROM seen WHERE seen > chance GROUP BY term""")
def q_cooccur_ppmi(spark, sf_dir):
    """PPMI of all pairs of terms at most five places apart, summed per term in millionths."""
    from ..operators import factors
    from .feature_queries import analyzed_documents
    pairs = factors.written(factors.half_cooccurrences(analyzed_documents(spark, sf_dir)))
    micro = F.floor(F.col("value") * F.lit(1e6) + F.lit(0.5))
    return factors.mirrored(factors.ppmi(pairs, halves=True), "value").groupBy("term").agg(F.count("*").alias("n_others"), F.sum(micro).alias("micro_ppmi"))


@register("embed_factors", "SELECT doc_id, 64 AS dim, TRUE AS is_finite FROM documents")
def q_embed_factors(spark, sf_dir):
    """Word vectors factorised from the train split's co-occurrences, averaged over every document's tokens."""
    from ..operators import factors
    docs = split_by_text(fx.documents(spark, sf_dir)).select("doc_id", tfidf_analyze("text").alias("tokens"), "split")
    vectors = factors.fit_factors(docs.filter(F.col("split") == "train"), "tokens", dim=64)
    out = factors.embed_factors(docs, vectors, 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("doc_id", F.size("embedding").alias("dim"), (total.isNotNull() & ~F.isnan(total)).alias("is_finite"))


def text_shape(texts):
    """A stand-in encoder: code points and blanks of each text."""
    import numpy as np
    return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)


@register("embed_hook", """
SELECT doc_id, 2 AS dim, CAST(length(coalesce(text, '')) AS DOUBLE) AS first,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS second FROM documents""")
def q_embed_hook(spark, sf_dir):
    """Any Python encoder behind the hook: here one whose vectors the oracle can state."""
    from ..operators.embed import embed_with
    out = embed_with(fx.documents(spark, sf_dir), lambda: text_shape, dim=2)
    return out.select("doc_id", F.size("embedding").alias("dim"), F.col("embedding")[0].cast("double").alias("first"),
                      F.col("embedding")[1].cast("double").alias("second"))
