"""Co-occurrence factorisation against brute force and dense eigenvectors."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import factors

SCHEMA = "doc_id long, tokens array<string>"


def texts(seed=3, rows=120):
    """Sentences of two kinds; within a kind, the first two words are exchangeable."""
    rng = random.Random(seed)
    kinds = [("cat", "dog"), ("car", "bus")], [["fur", "paw", "tail", "vet"], ["road", "wheel", "fuel", "driver"]]
    out = []
    for i in range(rows):
        kind = i % 2
        out.append((i, [rng.choice(kinds[0][kind]), *rng.sample(kinds[1][kind], 3), "the"]))
    return [*out, (1000, []), (1001, None), (1002, ["alone"]), (1003, [None, "fur", None, "paw"]), (1004, ["the"] * 9)]


def brute_pairs(rows, window):
    n = Counter()
    for _, tokens in rows:
        tokens = [t for t in tokens or [] if t is not None]
        for i, a in enumerate(tokens):
            for b in tokens[i + 1:i + 1 + window]:
                n[a, b] += 1
                n[b, a] += 1
    return n


def test_pairs_and_ppmi_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for window in (1, 2, 5):
        pairs = factors.cooccurrences(df, "tokens", window)
        want = brute_pairs(rows, window)
        assert {(r.term, r.other): r.n for r in pairs.collect()} == dict(want)
        total, row = sum(want.values()), Counter()
        for (a, _), n in want.items():
            row[a] += n
        got = {(r.term, r.other): r.value for r in factors.ppmi(pairs).collect()}
        brute = {k: math.log(n * total / (row[k[0]] * row[k[1]])) for k, n in want.items() if n * total > row[k[0]] * row[k[1]]}
        assert got.keys() == brute.keys()
        assert all(abs(got[k] - brute[k]) < 1e-9 for k in brute)


def test_steps_do_not_cut_pairs(spark, monkeypatch):
    rows = [(1, [f"w{i % 7}" for i in range(50)]), (2, ["w1", "w2", "w3"])]
    batch = spark.createDataFrame(rows, SCHEMA).select("tokens").toArrow().combine_chunks().to_batches()
    for step in (1, 4, 49, 1000):
        monkeypatch.setattr(factors, "STEP", step)
        got = Counter()
        for out in factors.pair_counter(5)(iter(batch)):
            for r in out.to_pylist():
                got[r["term"], r["other"]] += r["n"]
        assert got == brute_pairs(rows, 5)


def test_a_task_counts_a_pair_once(spark, monkeypatch):
    """In one order, and added up over its steps and batches; what it holds is bounded."""
    rows = [(i, [f"w{(i * j) % 5}" for j in range(20)]) for i in range(1, 40)]
    table = spark.createDataFrame(rows, SCHEMA).select("tokens").toArrow().combine_chunks()
    monkeypatch.setattr(factors, "STEP", 64)
    want = {k: n for k, n in brute_pairs(rows, 3).items() if k[0] <= k[1]}
    told = [r for out in factors.pair_counter(3, halves=True)(iter(table.to_batches(max_chunksize=4))) for r in out.to_pylist()]
    assert len(told) == len(want) and {(r["term"], r["other"]): r["n"] for r in told} == want
    monkeypatch.setattr(factors, "HELD", 16)
    got, most = Counter(), 0
    for out in factors.pair_counter(3, halves=True)(iter(table.to_batches(max_chunksize=4))):
        for r in out.to_pylist():
            got[r["term"], r["other"]] += r["n"]
        most = max(most, out.num_rows)
    assert got == want and most <= 16


def test_factors_are_the_leading_eigenvectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 5)) * [5, 4, 3, 2, 0.1]
    dense = base @ np.diag([1, 1, -1, 1, 1]) @ base.T
    rows = [(f"t{i:02d}", f"t{j:02d}", float(dense[i, j])) for i in range(30) for j in range(30)]
    got = factors.factorize(spark.createDataFrame(rows, "term string, other string, value double"), 4, 12)
    vectors = np.array([r.vector for r in got.orderBy("term").collect()])
    sizes, axes = np.linalg.eigh(dense)
    lead = np.argsort(-np.abs(sizes))[:4]
    assert np.allclose((vectors ** 2).sum(0), np.abs(sizes[lead]), rtol=1e-6)
    for i, at in enumerate(lead):
        assert abs(abs(vectors[:, i] @ axes[:, at]) / np.linalg.norm(vectors[:, i]) - 1) < 1e-6


def test_exchangeable_words_are_near_and_documents_averaged(spark):
    df = spark.createDataFrame(texts(), SCHEMA).withColumn("vector", F.lit("clash")).withColumn("term", F.lit(1))
    vectors = factors.fit_factors(df, "tokens", dim=6)
    by = {r.term: np.array(r.vector) for r in vectors.collect()}
    assert set(by) == {"cat", "dog", "car", "bus", "fur", "paw", "tail", "vet", "road", "wheel", "fuel", "driver", "the"}

    def cosine(a, b):
        return by[a] @ by[b] / np.linalg.norm(by[a]) / np.linalg.norm(by[b])
    assert cosine("cat", "dog") > 0.8 and cosine("car", "bus") > 0.8
    assert cosine("cat", "car") < 0.3 and cosine("dog", "wheel") < 0.3
    out = {r.doc_id: r.embedding for r in factors.embed_factors(df, vectors, 6).collect()}
    assert len(out) == df.count()
    assert out[1000] == out[1001] == out[1002] == [0.0] * 6
    assert np.allclose(out[1003], (by["fur"] + by["paw"]) / 2, atol=1e-5)
    assert np.allclose(out[1004], by["the"], atol=1e-5)


def test_small_rank_and_empty_table(spark):
    pair = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "term string, other string, value double")
    vectors = {r.term: r.vector for r in factors.factorize(pair, 4, 3).collect()}
    assert np.allclose(sorted(np.abs(vectors["a"]))[:2], 0, atol=1e-6)
    empty = spark.createDataFrame([], SCHEMA)
    fitted = factors.fit_factors(empty, "tokens", dim=4, iterations=2)
    assert fitted.count() == 0
    alone = spark.createDataFrame([(1, ["a"])], SCHEMA)
    assert factors.embed_factors(alone, fitted, 4).first().embedding == [0.0] * 4


def test_tables_of_past_iterations_are_removed(spark):
    import os

    from postlens.session import checkpoint_dir
    docs = spark.createDataFrame([(i, [f"a{i % 3}", f"b{i % 4}", "c", f"d{i % 5}"]) for i in range(40)], "doc_id long, tokens array<string>")
    there = lambda: {f for f in os.listdir(checkpoint_dir(spark)) if f.startswith("factors-")}
    before = there()
    vectors = factors.fit_factors(docs, dim=3, iterations=4)
    left = there() - before
    assert len(left) <= 2 and vectors.count() == 13  # the vectors, and the terms' sums
    assert any(f in vectors.inputFiles()[0] for f in left)
