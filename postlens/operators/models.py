"""Model operators on MLlib (distributed learners; no per-row Python).

* boosted trees  -> :mod:`.boosting` (binary, over the stored entries; the model is MLlib's) /
  ``OneVsRest(GBTClassifier)``
* dense branch   -> ``MultilayerPerceptronClassifier`` on pooled vectors
* meta-learner   -> L2 ``LogisticRegression``, objective scaled like C=1
* stacking       -> out-of-fold base scores (key-hashed folds) -> meta fit

Iterative fits persist their input and use the shared checkpoint folder
(``checkpointInterval``) so a lost executor does not replay the lineage.
Every scoring function keeps the key: predictions are joined, never zipped.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .boosting import fit_entries
from .splits import fold_assign, group_folds


#: Rows per partition for iterative fits: every iteration ships the
#: coefficients or nodes to each task and aggregates a gradient or the nodes'
#: histograms per task, so a small input spread over many partitions pays that
#: fixed cost many times.
FIT_ROWS_PER_PARTITION = 50_000
#: Rows that are worth a task of their own while the cluster has idle cores.
FIT_ROWS_PER_TASK = 4_000
#: The same for boosted trees, where a row costs one histogram update per feature.
BOOSTED_ROWS_PER_PARTITION = 500


def _size_for_iterations(data: DataFrame, rows: int = FIT_ROWS_PER_PARTITION, few: int = FIT_ROWS_PER_TASK) -> tuple[DataFrame, int]:
    """The persisted input in about one partition per ``rows`` rows, or per
    ``few`` rows up to the cluster's parallelism, and its row count.  The count
    fills the cache, so the input is computed once; it is coalesced without a
    shuffle, so large inputs keep their parallelism; one that leaves cores idle
    (one row group is one partition) is dealt out once and persisted as dealt."""
    n = data.count()
    cores = data.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, -(-n // rows), min(-(-n // few), cores))
    if data.rdd.getNumPartitions() < min(wanted, cores):
        return data.repartition(min(wanted, cores)).persist(), n
    return data.coalesce(wanted), n


def _n_classes(df: DataFrame, label: str) -> int:
    # a scalar: the label domain of a classifier is small by construction
    return int(df.agg(F.max(label)).head()[0]) + 1


def _xgboost_spark():
    try:  # optional: the distributed XGBoost estimator, when installed
        from xgboost.spark import SparkXGBClassifier
        return SparkXGBClassifier
    except ImportError:
        return None


def fit_boosted(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100,
                max_depth: int = 6, step_size: float = 0.3, max_bins: int = 32, seed: int = 42,
                num_classes: int | None = None, engine: str = "entries", parallelism: int = 4):
    """Gradient-boosted trees (library defaults of the sparse branch: 100
    trees, depth 6, learning rate 0.3).

    ``engine='entries'``: the same trees as ``GBTClassifier`` from sums over the
    vectors' stored entries (:func:`.boosting.fit_entries`), for two classes;
    above two, as ``engine='mllib'``.
    ``engine='mllib'``: ``GBTClassifier`` (``OneVsRest`` above two classes, whose
    fits run ``parallelism`` at a time: each is a chain of small jobs).
    ``engine='xgboost'``: ``xgboost.spark.SparkXGBClassifier`` with the same
    settings when that package is installed (it is not in this image; asking
    for it without the package raises).
    """
    if engine == "xgboost":
        xgb = _xgboost_spark()
        if xgb is None:
            raise ImportError("xgboost.spark is not installed; use engine='mllib'")
        est = xgb(features_col=features, label_col=label, n_estimators=max_iter, max_depth=max_depth,
                  learning_rate=step_size, random_state=seed,
                  num_workers=df.sparkSession.sparkContext.defaultParallelism)
        return est.fit(df.select(features, F.col(label).cast("double").alias(label)))
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    checkpoint_dir(df.sparkSession)
    rows = df.select(features, F.col(label).cast("double").alias(label))
    if engine == "entries" and num_classes and num_classes <= 2:
        return fit_entries(rows, features, label, max_iter, max_depth, step_size, max_bins, seed)  # it persists what it reads
    data = rows.persist()
    k = num_classes or _n_classes(data, label)
    if engine == "entries" and k <= 2:
        try:
            return fit_entries(data, features, label, max_iter, max_depth, step_size, max_bins, seed)
        finally:
            data.unpersist()
    sized, _ = _size_for_iterations(data, BOOSTED_ROWS_PER_PARTITION)
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step_size, maxBins=max_bins, seed=seed, checkpointInterval=10)
    try:
        if k <= 2:
            return gbt.fit(sized)
        return OneVsRest(classifier=gbt, featuresCol=features, labelCol=label, parallelism=parallelism).fit(sized)
    finally:
        sized.unpersist()
        data.unpersist()


def fit_dense(df: DataFrame, features: str = "features", label: str = "label", hidden: tuple = (32,),
              max_iter: int = 30, seed: int = 42, num_classes: int | None = None, block_size: int = 128):
    """Dense classifier on pooled vectors (stand-in for fine-tuning a
    pretrained encoder: there are no weights offline)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    data = df.select(features, F.col(label).cast("double").alias(label)).persist()
    sized, _ = _size_for_iterations(data)
    width = len(sized.select(features).head()[0])
    k = num_classes or _n_classes(sized, label)
    mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[width, *hidden, k],
                                         maxIter=max_iter, seed=seed, blockSize=block_size)
    try:
        return mlp.fit(sized)
    finally:
        sized.unpersist()
        data.unpersist()


def fit_meta(df: DataFrame, features: str = "meta_features", label: str = "label", c: float = 1.0,
             max_iter: int = 10000, tol: float = 1e-6):
    """L2 logistic regression with the objective ``C*sum(loss) + |w|^2/2``
    expressed as MLlib's ``mean(loss) + regParam/2 |w|^2`` (regParam = 1/(C n)),
    unstandardized, intercept unpenalized."""
    from pyspark.ml.classification import LogisticRegression
    data = df.select(features, F.col(label).cast("double").alias(label)).persist()
    sized, n = _size_for_iterations(data)
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, tol=tol)
    try:
        return lr.fit(sized)
    finally:
        sized.unpersist()
        data.unpersist()


def fit_dense_epochs(df: DataFrame, path: str, epochs: int = 30, features: str = "features", label: str = "label",
                     hidden: tuple = (32,), seed: int = 42, num_classes: int | None = None):
    """The dense classifier epoch by epoch, each continuing from the weights of
    the one before and saved under ``path/epoch-<n>``; returns the last model."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    data = df.select(features, F.col(label).cast("double").alias(label)).persist()
    sized, _ = _size_for_iterations(data)
    layers = [len(sized.select(features).head()[0]), *hidden, num_classes or _n_classes(sized, label)]
    model = None
    try:
        for epoch in range(1, epochs + 1):
            est = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, maxIter=1, seed=seed)
            if model is not None:
                est.setInitialWeights(model.weights)
            model = est.fit(sized)
            model.write().overwrite().save(f"{path.rstrip('/')}/epoch-{epoch}")
        return model
    finally:
        sized.unpersist()
        data.unpersist()


def loss_log(spark, model, epoch: int = 1) -> DataFrame:
    """``(epoch, step_no, loss)`` of a freshly fitted model's iterations, the log
    that ``running_loss`` reads (one row per iteration of the solver)."""
    history = [(epoch, i, float(x)) for i, x in enumerate(model.summary.objectiveHistory, 1)]
    return spark.createDataFrame(history, "epoch int, step_no int, loss double")


def score(model, df: DataFrame, key: str = "doc_id", keep: tuple = ("label",), positive: int | None = 1) -> DataFrame:
    """``(key, *keep, prediction INT[, p_positive])`` from any fitted classifier."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    cols = [key, *[c for c in keep if c in df.columns], F.col("prediction").cast("int").alias("prediction")]
    if positive is not None and "probability" in out.columns:
        cols.append(vector_to_array("probability")[positive].alias("p_positive"))
    return out.select(*cols)


def argmax_prediction(scores) -> "F.Column":
    """Index of the largest class score (first on ties), as INT."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def concurrently(spark, jobs: dict, threads: int = 4) -> dict:
    """Results of ``jobs`` (name -> function), at most ``threads`` at a time, each in a job group of its name.

    An iterative fit is a chain of small jobs that leaves most of the cluster
    idle; several of them side by side take about as long as one.
    """
    def run(name, job):
        spark.sparkContext.setJobGroup(str(name), str(name))
        return job()

    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(run), name, job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


def stack_oof(train: DataFrame, bases: dict, label: str = "label", key: str = "doc_id", k: int = 3, salt: str = "oof",
              group: str | None = None, threads: int = 4):
    """Out-of-fold stacking over several bases.

    ``bases``: name -> ``fit(df)``, which fits everything the base needs, its
    vectorizer included, on the rows it is given and returns a model whose
    ``transform`` adds ``probability``.  Rows of ``train`` get a key-hashed fold,
    or with ``group`` one fold for all rows of a group (:func:`group_folds`), so
    that copies never stand on both sides; for each fold and base a model fitted
    on the other folds scores the held-out one.  The meta-learner is fitted on
    these scores, one column per base; the bases are also fitted on all of
    ``train`` to score other rows.  Returns ``(meta_model, final_bases,
    oof_scores)``.  The driver loops over folds and bases only, ``threads`` fits
    at a time; every fit and score is a distributed job.
    """
    folded = (group_folds(train, k, group, salt) if group else fold_assign(train, k, key, salt)).persist()
    try:
        folded.count()  # fills the cache once, for all threads
        jobs = {}
        for name, fit in bases.items():
            for f in [*range(k), None]:
                data = folded if f is None else folded.filter(F.col("fold") != f)
                jobs[name, f] = lambda fit=fit, data=data: fit(data)
        fitted = concurrently(train.sparkSession, jobs, threads)
        columns = []
        for name in bases:
            held = [_positive(fitted[name, f], folded.filter(F.col("fold") == f), key, name) for f in range(k)]
            columns.append(reduce(lambda a, b: a.unionByName(b), held))
        scores = reduce(lambda a, b: a.join(b, key), [folded.select(key, label), *columns])
        scores = cut_lineage(scores)  # one pass over every fold's model, before the fold table goes
        meta = fit_meta(_assembled(scores, list(bases)), "meta_features", label)
        finals = {name: fitted[name, None] for name in bases}
    finally:
        folded.unpersist()
    return meta, finals, scores


def score_stack(meta, finals: dict, df: DataFrame, key: str = "doc_id", keep: tuple = ("label",)) -> DataFrame:
    """``(key, *keep, prediction, p_positive)`` of the stacked model for rows it was not fitted on."""
    rows = df.select(key, *[c for c in keep if c in df.columns])
    for name, model in finals.items():
        rows = rows.join(_positive(model, df, key, name), key)
    return score(meta, _assembled(rows, list(finals)), key, keep)


def _positive(model, df: DataFrame, key: str, name: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(df).select(key, vector_to_array("probability")[1].alias(f"p_{name}"))


def _assembled(scores: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="meta_features").transform(scores)


def refit_meta(model, df: DataFrame, c: float = 1.0):
    """Refit a fitted meta-model's estimator on another split, with the same
    parameters; the penalty is again ``c`` scaled to the number of rows (the
    fitted model only knows the product)."""
    from pyspark.ml.classification import LogisticRegression
    est = LogisticRegression()
    for p in model.extractParamMap():
        if est.hasParam(p.name):
            est.set(est.getParam(p.name), model.getOrDefault(p))
    data = df.persist()
    sized, n = _size_for_iterations(data)
    est.set(est.getParam("regParam"), 1.0 / (c * n))
    try:
        return est.fit(sized)
    finally:
        sized.unpersist()
        data.unpersist()
