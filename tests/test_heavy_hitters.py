"""Vocabulary from heavy-hitter summaries: bounds and rows against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.operators import heavy_hitters as hh
from postlens.operators import vocab


def corpus(spark, rows, seed=5, terms=400, parts=4):
    rng = random.Random(seed)
    docs = [(i, [f"t{min(int(rng.paretovariate(0.7)), terms):03d}" for _ in range(rng.randrange(40))]) for i in range(rows)]
    return docs, spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(parts, "doc_id")


@pytest.mark.parametrize("counters", [3, 20, 100, 1000])
def test_summary_bounds_hold(spark, counters):
    docs, df = corpus(spark, 300)
    true = Counter(t for _, ts in docs for t in ts)
    rows = {r.term: r for r in hh.term_summary(df, "tokens", counters).collect()}
    error = rows.pop(None).error
    assert error <= sum(true.values()) / (counters + 1)
    assert (error == 0) == (counters == 1000)
    for term, n in true.items():
        low = rows[term].low if term in rows else 0
        assert low <= n <= low + error
    assert len(rows) <= 4 * counters


@pytest.mark.parametrize("counters, k", [(3, 50), (20, 2), (60, 5), (100, 10), (1000, 60), (1000, 5000)])
def test_bounded_vocabulary_equals_the_plain_one(spark, counters, k):
    _, df = corpus(spark, 300)
    want = vocab.vocab_fit(df, "tokens", k).collect()
    assert sorted(hh.vocab_fit_bounded(df, "tokens", k, counters).collect()) == sorted(want)


def test_candidates_hold_all_ties_at_the_cut_and_little_else(spark):
    docs = [(i, ["a", "b", "b", f"only{i}"]) for i in range(50)] + [(99, ["c"] * 50)]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>").coalesce(1)
    summary = hh.term_summary(df, "tokens", 1000)
    assert {r.term for r in hh.candidates(summary, 2).collect()} == {"a", "b", "c"}
    assert hh.candidates(hh.term_summary(df, "tokens", 2), 3) is None
    got = hh.vocab_fit_bounded(df, "tokens", 2, 10).collect()
    assert sorted((r.term, r.idx, r.tf, r.df) for r in got) == [("a", 0, 50, 50), ("b", 1, 100, 50)]


def test_empty_null_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y"), (3, [None, "w"], "z")],
                               "doc_id long, tokens array<string>, low string")
    assert [tuple(r) for r in hh.vocab_fit_bounded(df, "tokens", 5, 4).collect()] == [("w", 0, 1, 1)]
    assert hh.vocab_fit_bounded(df.filter(F.lit(False)), "tokens", 5, 4).count() == 0
