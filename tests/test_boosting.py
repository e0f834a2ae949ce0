"""Boosted trees over stored entries: MLlib's trees, bins, blocks and models."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlens.operators import boosting, models
from postlens.sources.sinks import load_model, save_model, scratch_path


def sparse_rows(spark, n=1500, width=12, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = {j: rng.gauss(0.2, 1) if j % 3 else float(rng.randint(1, 3)) for j in range(width) if rng.random() < 0.5}
        rows.append((i, Vectors.sparse(width, v), float(v.get(3, 0) + v.get(4, 0) + rng.gauss(0, 1) > 0.8)))
    return spark.createDataFrame(rows, ["id", "features", "label"])


def shape(model):
    """Every tree's splits, and its leaves to nine digits."""
    def walk(node):
        if node.numDescendants() == 0:
            return round(node.prediction(), 9)
        return node.split().featureIndex(), node.split().threshold(), round(node.gain(), 9), walk(node.leftChild()), walk(node.rightChild())
    trees = model._java_obj.trees()
    return [walk(t.rootNode()) for t in trees]


def test_the_trees_are_those_of_mllib(spark):
    rows = sparse_rows(spark).repartition(5).cache()
    want = GBTClassifier(maxIter=13, maxDepth=3, stepSize=0.3, seed=42).fit(rows)
    got = models.fit_boosted(rows, max_iter=13, max_depth=3, num_classes=2)
    assert type(got) is GBTClassificationModel and got.numFeatures == 12 and got.getNumTrees == 13
    assert shape(got) == shape(want) and got.treeWeights == want.treeWeights
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    p = vector_to_array("probability")[1]
    pairs = got.transform(rows).select("id", p.alias("p")).join(want.transform(rows).select("id", p.alias("q")), "id")
    assert pairs.filter(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0


def test_blocks_and_tasks_change_nothing(spark, monkeypatch):
    rows = sparse_rows(spark, 600)
    one = shape(boosting.fit_entries(rows.coalesce(1), max_iter=4, max_depth=3))
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    monkeypatch.setattr(boosting, "MARGIN_EVERY", 2)
    assert shape(boosting.fit_entries(rows.repartition(6), max_iter=4, max_depth=3)) == one


def test_a_level_holds_the_stored_entries_only():
    """The work of a task follows the entries, not rows times features."""
    width = 5000
    bins = boosting.number_bins({f: [0.5] for f in range(width)}, width)
    block = boosting.Block(np.array([1.0, -1.0, 1.0]), np.zeros(3), np.array([1, 3, 3], dtype=np.int32), np.array([0, 0, 1], dtype=np.int32))
    tree = boosting._Growing().tree()
    sent = list(boosting._level_sums(0, iter([block]), [], True, tree, np.array([0]), bins, 4))
    assert sum(len(keys) for _, (_, _, keys, _) in sent) == 2
    assert [p for p, _ in sent] == [0, 1, 2, 3]
    (found,) = boosting._best(iter([sent[0]]), bins)
    node, gain, cut, left = found[1][0]
    # feature 0 parts row 0 from the two rows in its zero bin, feature 1 row 2 from the others: of equal gains the first counts
    assert (node, cut, found[0].tolist()) == (0, 0, [[3.0, 1.0, 3.0]]) and gain == pytest.approx(0 + 1 - 1 / 3) and left == [2.0, 0.0, 2.0]


def test_cuts_take_all_middles_or_even_strides():
    assert boosting.feature_cuts([(0.0, 5), (1.0, 1), (3.0, 4)], 10, 32) == [0.5, 2.0]
    assert boosting.feature_cuts([(2.0, 10)], 10, 32) == []
    assert boosting.feature_cuts([(float(i), 1) for i in range(8)], 8, 4) == [1.5, 3.5, 5.5]


def test_constant_rows_and_bad_labels(spark):
    flat = spark.createDataFrame([(Vectors.sparse(3, {1: 2.0}), float(i % 2)) for i in range(6)], ["features", "label"])
    m = boosting.fit_entries(flat, max_iter=2, max_depth=3)
    assert m.totalNumNodes == 2 and [r[0] for r in load_model(save_model(m, scratch_path(spark, "flat"))).transform(flat).select("prediction").collect()] == [0.0] * 6
    for bad in (None, 2.0):
        rows = flat.withColumn("label", F.lit(bad).cast("double"))
        with pytest.raises(Exception, match="labels must be 0 or 1"):
            boosting.fit_entries(rows, max_iter=1)


def test_sums_with_and_without_a_sort_agree():
    rng = np.random.default_rng(3)
    for nodes, entries in ((1, 400), (3, 400), (30, 40)):  # the last has too few entries for a table of all pairs
        bins = np.sort(rng.integers(0, 90, entries)).astype(np.int32)
        block = boosting.Block(np.ones(50), np.zeros(50), bins, rng.integers(0, 50, entries).astype(np.int32))
        at, moments = rng.integers(-1, nodes, 50), rng.random((50, 3))
        at[0] = nodes - 1
        used = at[block.rows] >= 0
        keys, stats = boosting.summed(at[block.rows][used] * 90 + bins[used], moments[block.rows[used]])
        got = block.summed(at, moments, 90)
        assert (got[0] == keys).all() and np.allclose(got[1], stats)


def test_one_task_and_jobs_grow_the_same_trees(spark, monkeypatch):
    """A level's sums need no job where the entries fit in a task; beyond, jobs give the same trees."""
    rows = sparse_rows(spark, 700, 9).repartition(4)
    rows = rows.withColumn("label", F.when(F.rand(2) < 0.02, 1 - F.col("label")).otherwise(F.col("label"))).cache()
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-task", "one-task")
    one = shape(boosting.fit_entries(rows, max_iter=12, max_depth=5))
    jobs = len(stages.getJobIdsForGroup("one-task"))
    spark.sparkContext.setJobGroup("jobs", "jobs")
    monkeypatch.setattr(boosting, "TASK_ENTRIES", 0)
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "MARGIN_EVERY", 5)
    many = shape(boosting.fit_entries(rows, max_iter=12, max_depth=5))
    assert many == one and jobs < 30 < len(stages.getJobIdsForGroup("jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_larger_sibling_is_what_its_parent_has_left():
    rng = np.random.default_rng(8)
    rows, n_bins = 400, 60
    bins = np.sort(rng.integers(0, n_bins, 3000)).astype(np.int32)
    block = boosting.Block(np.ones(rows), np.zeros(rows), bins, rng.integers(0, rows, 3000).astype(np.int32))
    moments = boosting._moments(rng.normal(size=rows))
    parents, children = rng.integers(0, 2, rows), np.full(rows, -1)
    children[parents == 1] = np.where(rng.random((parents == 1).sum()) < 0.8, 1, 0)  # place 1 has most of parent 1
    table = lambda at: (np.zeros((2, 3)), *block.summed(at, moments, n_bins))
    got = boosting.with_larger(table(np.where(children == 0, 0, -1)), table(parents), {1: (1, 0)}, n_bins)
    want = table(children)
    assert (got[1] == want[1]).all() and np.allclose(got[2], want[2])


def test_blocks_are_packed_and_joined_without_loss():
    rng = np.random.default_rng(4)
    blocks = []
    for n in (5, 0, 7):
        bins = np.sort(rng.integers(0, 20, 4 * n)).astype(np.int32)
        blocks.append(boosting.Block(rng.choice([-1.0, 1.0], n), rng.random(n), bins, rng.integers(0, max(n, 1), 4 * n).astype(np.int32)))
    again = [boosting.unpacked(boosting.packed(b)) for b in blocks]
    for b, c in zip(blocks, again, strict=True):
        assert all((x == y).all() for x, y in zip(b[:4], c[:4], strict=True))
    pairs = sorted((int(x), int(r) + base) for b, base in zip(blocks, (0, 5, 5)) for x, r in zip(b.bins, b.rows))
    whole = boosting.joined(again, 20)
    assert (whole.starts == whole._replace(starts=None).bin_starts()).all()
    assert sorted(zip(whole.bins.tolist(), whole.rows.tolist())) == pairs and (np.diff(whole.bins) >= 0).all() and not again
    assert (whole.label == np.concatenate([b.label for b in blocks])).all() and (whole.margin == np.concatenate([b.margin for b in blocks])).all()
