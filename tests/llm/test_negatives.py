"""Operator 12: hard negatives against all pairs, and the tree's elimination."""

import math
import random

import numpy as np
import pytest

from postlens.llm import op12_negatives as op
from postlens.llm.op12_negatives import Tree, mine_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows):
    """All pairs; rows are told apart by their position."""
    kept = [(k, y, [math.floor(256 * float(np.float32(x))) for x in v]) for k, y, v in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def dot(a, b):
        return sum(x * z for x, z in zip(a, b))

    def first(items):
        return sorted(items, key=lambda e: (-e[0], e[1] is None, e[1] or 0))

    out = []
    for i, (k, y, v) in enumerate(kept):
        if k is None or k % 100:
            continue
        scored = [(dot(v, w), j, z) for n, (j, z, w) in enumerate(kept) if n != i]
        for p, pid, _ in first([s for s in scored if s[2] == y])[:5]:
            hard = first([s for s in scored if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p])[:5]
            out += [(k, pid, rank, nid, p, s) for rank, (s, nid, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dims))
    x = centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dims))
    return (x / 4).astype(np.float32)


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(op, "MIN_LEAF", 16)
    monkeypatch.setattr(op, "SAMPLE", 256)


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_mining_equals_all_pairs(spark, small_leaves, spread):
    x = vectors(1, 600, 12, spread)
    rng = random.Random(2)
    rows = [(i * 10, rng.randint(0, 4), v.tolist()) for i, v in enumerate(x)]
    rows += [(100_000 + i, i % 5, x[7].tolist()) for i in range(120)]  # many copies of one vector
    rows += [(700, 1, x[3].tolist()), (None, 1, x[3].tolist()), (100, None, x[4].tolist()), (200, 1, None), (None, 2, x[5].tolist()),
             (300, 2, [float("nan")] * 12), (400, 2, [0.5] * 11 + [None]), (500, 3, [float("inf")] * 12), (20_000, 1, [0.0] * 12),
             (20_100, 2, [0.5, 0.25]), (20_200, 2, []), (20_300, 3, (-x[9]).tolist()), (20_400, 77, x[1].tolist())]
    df = spark.createDataFrame([(*r, 5, 5, "x") for r in rows], SCHEMA + ", row int, leaf int, v string")
    got = sorted([tuple(r) for r in mine_negatives(df).collect()], key=str)
    want = brute(rows)
    assert got == want and len(want) > 200


def test_empty_and_all_zero_tables(spark):
    empty = mine_negatives(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:2] == ["anchor_id", "positive_id"]
    rows = [(100 * i, i % 2, [0.0, 0.0]) for i in range(8)]
    assert sorted([tuple(r) for r in mine_negatives(spark.createDataFrame(rows, SCHEMA)).collect()], key=str) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(50 * i, i % 3, [rng.uniform(-3e6, 3e6) for _ in range(3)]) for i in range(60)]
    assert sorted([tuple(r) for r in mine_negatives(spark.createDataFrame(rows, SCHEMA)).collect()], key=str) == brute(rows)
    with pytest.raises(ValueError):
        mine_negatives(spark.createDataFrame([(100, 1, [1e30])], SCHEMA))


@pytest.mark.parametrize("spread,share", [(0.02, 0.5), (3.0, 1.0)])
def test_no_leaf_with_a_hit_is_eliminated(spread, share):
    x = np.floor(256 * vectors(5, 2000, 16, spread)).astype(np.int64)
    norms = (x.astype(float) ** 2).sum(1)
    tree = Tree(16, norms.max(), False)
    tree.fit(x[:500], np.zeros(500, int), np.arange(500), 20)
    leaf = tree.assign(x, tree.low, tree.high)
    q = x[::50]
    scores = q @ x.T
    for low, high in ((0.8, 1.0), (0.3, 0.35), (-2.0, -1.5), (1.1, 9.0)):
        least, most = np.minimum(low * norms[::50], high * norms[::50]), np.maximum(low * norms[::50], high * norms[::50])
        seen = tree.visited(q, least, most)
        hit = (scores >= least[:, None]) & (scores <= most[:, None])
        for i in range(len(q)):
            assert seen[i][np.unique(leaf[hit[i]])].all()
        if (low, high) == (0.8, 1.0):
            assert seen.mean() <= share


def test_query_equals_its_sql(spark):
    from conftest import SF01
    from oracle_check import compare
    assert compare(spark, SF01, ["op12_hard_negatives"], verbose=False)["op12_hard_negatives"][0] == "ok"
