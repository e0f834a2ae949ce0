"""Operator 5 and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import brute_lines_of, classes, jaccard_links, odd_rows, prose, shingles, with_clashes, words
from pyspark.sql import functions as F

import corpus_pipeline
from postlens.llm.common import read_table
from postlens.llm.op5_mixing import fit_domains, fit_rates, memberships, mix
from postlens.llm.op6_quality import judge_quality


def two_kinds(n=200):
    """Documents of two vocabularies, the label of every second one."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        own = ("alpha", "beta", "gamma", "delta") if good else ("uno", "dos", "tres", "cuatro")
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.3 else rng.choice(("the", "of", "and", "to")) for _ in range(rng.randint(5, 60)))))
        labels.append((i, "good" if good else "poor"))
    return rows, labels


def test_domains_on_held_out_rows_and_against_brute_force(spark):
    rows, labels = two_kinds()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    taught = [x for x in labels if x[0] % 2]
    model = fit_domains(docs, spark.createDataFrame(taught, "doc_id long, domain string"), ("good", "poor"))
    got = {r.doc_id: (r.n, r.p0, r.p1) for r in memberships(docs, model).collect()}
    common = {"the", "of", "and", "to"}
    held = [x for x in labels if x[0] % 2 == 0 and set(words(dict(rows)[x[0]])) - common]  # those that tell their kind
    assert np.mean([(got[k][1] > 0.5) == (d == "good") for k, d in held]) > 0.95
    counts = {d: Counter(w for k, t in rows for w in words(t) if (k, d) in taught) for d in ("good", "poor")}
    for key, text in rows[:40]:
        w, scores = words(text), []
        for d in ("good", "poor"):
            prior = math.log((sum(x[1] == d for x in taught) + 1) / (len(taught) + 2))
            total, every = sum(counts[d].values()), sum(sum(c.values()) for c in counts.values()) + 0.5 * model.buckets
            scores.append(prior + sum(math.log((counts[d][x] + 500 * (sum(c[x] for c in counts.values()) + 0.5) / every)
                                               / (total + 500)) for x in w) * min(1, 40 / len(w)))
        want = 1 / (1 + math.exp(scores[1] - scores[0]))
        assert got[key][0] == len(w) and got[key][1] == pytest.approx(want, abs=1e-4)
        assert got[key][1] + got[key][2] == pytest.approx(1)


def brute_rates(n, p, shares, steps):
    """Accelerated projected gradient in numpy."""
    targets, r, ahead, th = np.array(shares) * n.sum(), np.ones(len(n)), np.ones(len(n)), 1.0
    w = np.linalg.pinv((p * n[:, None]).T @ p)
    for _ in range(steps):
        new = np.maximum(0, ahead - p @ (w @ ((ahead * n) @ p - targets)))
        longer = (1 + math.sqrt(1 + 4 * th * th)) / 2
        r, ahead, th = new, new + (th - 1) / longer * (new - r), longer
    left = (r * n) @ p - targets
    return r, left @ w @ left


@pytest.mark.parametrize("shares", [(0.5, 0.3, 0.2), (0.9, 0.05, 0.05), (0.0001, 0.0001, 0.9998)])
def test_rates_equal_brute_force(spark, shares):
    rng = np.random.default_rng(8)
    n = rng.integers(0, 300, 150)
    p = rng.dirichlet((0.4, 0.4, 0.4), 150)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(150)], "doc_id long, n long, p0 double, p1 double, p2 double")
    rated, totals, targets = fit_rates(members, shares, max_iter=20, tolerance=0, every=4)
    want, _ = brute_rates(n, p, shares, 20)
    got = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
    assert np.allclose(got, want) and np.allclose(totals, (got * n) @ p) and (got >= 0).all()
    start = np.abs(n @ p - targets).max()
    assert np.abs(np.array(totals) - targets).max() < start / 4


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(9)
    n, p = rng.integers(1, 300, 200), rng.dirichlet((0.2, 0.2, 0.2), 200)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n long, p0 double, p1 double, p2 double")
    _, totals, targets = fit_rates(members, (0.8, 0.12, 0.08))
    assert np.allclose(totals, targets, rtol=1e-4)


def test_mixing_of_odd_rows(spark):
    rows = odd_rows() + two_kinds(40)[0]
    rows = [(k if i < 12 else 1000 + k, t) for i, (k, t) in enumerate(rows)]
    labels = spark.createDataFrame([(1000 + k, d) for k, d in two_kinds(40)[1]] + [(None, "good"), (1, "poor"), (1000, "zzz"), (77777, "good")],
                                   "doc_id long, domain string")
    docs = with_clashes(spark, rows)
    out = mix(docs, labels, {"good": 0.8, "poor": 0.2}).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in rows)
    sizes = dict(rows)
    assert all(r.n_tokens == len(words(sizes[r.doc_id])) and r.rate >= 0 for r in out)
    tokens = sum(r.n_tokens for r in out)
    assert sum(r.rate * r.n_tokens * r.p_good for r in out) == pytest.approx(0.8 * tokens, rel=1e-3)
    assert len({(r.n_tokens, r.rate) for r in out if r.doc_id == 4}) == 1
    empty = mix(docs.limit(0), labels, {"good": 0.8, "poor": 0.2})
    assert empty.count() == 0
    blind = mix(docs, labels.limit(0), {"good": 0.5, "poor": 0.5}).collect()
    assert all(r.p_good == pytest.approx(0.5) for r in blind)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "mixing"]


def test_every_stage_against_brute_force(spark):
    """Each stage on what its predecessor kept, at sf0.001."""
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    kept = stages["quality"](spark, docs, sf).persist()
    verdict = {r.doc_id: r.kept for r in judge_quality(docs, read_table(spark, sf, "labels")).collect()}
    after = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(after) == {k for k, v in verdict.items() if v}
    assert all(after[k] == before[k] for k in after) and 0 < len(after) < len(before)

    lined = stages["line_dedup"](spark, kept, sf).persist()
    want = {k: t for k, _, _, t in brute_lines_of([(k, r.text) for k, r in after.items()], corpus_pipeline.MIN_DOCS)}
    after = {r.doc_id: r for r in lined.collect()}
    assert lined.columns == columns and {k: r.text for k, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())

    single = stages["near_duplicates"](spark, lined, sf).persist()
    texts = {k: r.text for k, r in after.items()}
    want = {k for k, c in classes(texts, jaccard_links(texts, 5, 80)).items() if k == c}
    after = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and set(after) == want and len(want) < len(texts)

    clean = stages["decontaminate"](spark, single, sf).persist()
    items = [shingles(r.text.lower(), 5) for r in read_table(spark, sf, "benchmark").collect()]
    want = {k for k, r in after.items() if not any(100 * len(i & shingles(r.text.lower(), 5)) >= 80 * len(i) for i in items)}
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(after) == want

    mixed = stages["mixing"](spark, clean, sf).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(after)
    assert all(r.n_tokens == len(words(after[r.doc_id].text)) and r.rate >= 0 for r in mixed)


def test_stages_keep_odd_columns_and_rows(spark, tmp_path):
    """Clashing columns stay; empty and repeated rows do no harm."""
    sf = "/root/testdata/sf0.001"
    rows = odd_rows() + [(200 + i, prose(i, 120)) for i in range(5)]
    docs = with_clashes(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    lone = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in lone)[4] == 1  # equal rows: one stays
    assert 6 in {r.doc_id for r in lone} and 7 not in {r.doc_id for r in lone}
    assert {None, 1, 2, 3} <= {r.doc_id for r in lone}


def test_labels_with_a_null_flag_are_left_out(spark):
    from postlens.llm.op5_mixing import label_domains
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, None), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in label_domains(labels).collect()} == {(1, "good_clean"), (5, "poor_toxic")}


def test_near_duplicates_move_no_text(spark):
    docs = spark.createDataFrame([(i, prose(i % 3, 60) + " end" * (i // 3)) for i in range(9)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lone = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = lone._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in lone.collect()) == [0, 1, 2]
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
