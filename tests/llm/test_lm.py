"""Operator 13: the Kneser-Ney model against a plain one, and on held-out texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import odd_rows, prose, with_clashes, words
from pyspark.sql import functions as F

from postlens.llm import op13_kneser_ney as lm


class Plain:
    """Interpolated modified Kneser-Ney by the definition."""

    def __init__(self, texts, order):
        self.order = order
        full = Counter(g for t in texts for g in self.grams(t))
        self.count = Counter(w for t in texts for w in self.tokens(t))
        self.levels = {order: full}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.d, self.ctx = {}, {}
        for k, grams in self.levels.items():
            n = [sum(1 for c in grams.values() if c == i) for i in (1, 2, 3, 4)]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
                self.d[k] = [0] + [min(max(x, 0), i) for i, x in enumerate(d, 1)]
            else:
                self.d[k] = [0, 0.5, 1, 1.5]
            total, left = defaultdict(int), defaultdict(float)
            for g, c in grams.items():
                total[g[:-1]] += c
                left[g[:-1]] += self.d[k][min(c, 3)]
            self.ctx[k] = (total, left)

    def tokens(self, text):
        return [*words(text, lower=True), None]

    def grams(self, text):
        t = ["\n"] * (self.order - 1) + self.tokens(text)
        return [tuple(t[i:i + self.order]) for i in range(len(t) - self.order + 1)]

    def p(self, gram):
        out = 1 / (len(self.count) + 1)
        for k in range(1, self.order + 1):
            g = gram[-k:]
            total, left = self.ctx[k]
            if total.get(g[:-1]):
                c = self.levels[k].get(g, 0)
                out = (c - self.d[k][min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * out
        return out

    def row(self, text):
        n, v = sum(self.count.values()), len(self.count)
        t = self.tokens(text)
        return (len(t), sum(self.count[w] > 0 for w in t), n, sum(math.log10((self.count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
                sum(math.log10(self.p(g)) for g in self.grams(text)))


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def texts():
    rng = random.Random(5)
    rows = odd_rows() + [(100 + i, prose(i % 30, rng.randint(1, 60)).upper() + " the the of") for i in range(120)]
    return rows + [(300 + i, "the " * rng.randint(0, 900)) for i in range(60)]


def check(got, want):
    assert got[:3] == want[:3]
    assert got[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    """Several chunks and shards, a word of a third of all tokens, unknown words, begin marks."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    rows = texts()
    plain = Plain([t for k, t in rows if not held(k)], order)
    docs = with_clashes(spark, rows).withColumn("held", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0).repartition(3)
    model, out = lm.train_and_score(docs, order)
    assert len(model.hot) >= 1 and max(model.hot.values()) > 2
    got = defaultdict(list)
    for r in out.collect():
        assert r.held_out == held(r.doc_id)
        got[r.doc_id].append(tuple(r)[2:])
    want = defaultdict(list)
    for k, t in rows:
        want[k].append(plain.row(t))
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k])
        for g, w in zip(sorted(got[k]), sorted(want[k]), strict=True):
            check(g, w)
    # the stored model scores other documents
    others = [(1, "the of"), (2, "never seen words"), (3, None), (4, prose(3, 40))]
    for r in lm.score(model, spark.createDataFrame(others, "doc_id long, text string")).collect():
        check(tuple(r)[2:], plain.row(dict(others)[r.doc_id]))


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in texts()[:80]], 3)
    for ctx in (("\n", "\n"), ("the", "the"), ("no", "such"), ("\n", "for")):
        assert sum(plain.p((*ctx, w)) for w in [*plain.count, "unknown word"]) == pytest.approx(1)


def test_empty_tables_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held boolean")
    assert lm.train_and_score(empty)[1].count() == 0
    rows = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held boolean")
    assert sorted(tuple(r) for r in lm.train_and_score(rows)[1].collect()) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


def test_query_beats_its_base_on_held_out_texts(spark):
    from conftest import SF01
    rows = lm.op13_lm_scores(spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    out = [r for r in rows if r.held_out]
    assert out and len({r.train_tokens for r in rows}) == 1
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert np.isfinite([r.score for r in rows]).all()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), np.zeros(5, np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64), np.array([2**64 - 1], np.uint64)):
        assert (lm.unpack(lm.pack(x)) == x).all()
        assert (lm.unpack_steps(lm.pack_steps(x)) == x).all()
        y = x >> np.uint64(24)
        assert (lm.unpack_steps(lm.pack_steps(y, 40), 40) == y).all()


def test_words_of_chunks_are_met_in_waves(spark, monkeypatch):
    """The chunks' words meet the model's a part of the chunks at a time, never all in one shuffle."""
    made, write = [], lm.shared_table

    def kept(df, name):
        out = write(df, name)
        if name == "known":
            made.append({r.chunk for r in out.select("chunk").collect()})
        return out
    monkeypatch.setattr(lm, "shared_table", kept)
    docs = spark.createDataFrame([(i, f"a b c {i}", i % 5 == 0) for i in range(200)], "doc_id long, text string, held boolean")
    chunks = docs.repartitionByRange(16, "doc_id")
    assert lm.train_and_score(chunks)[1].count() == 200
    assert len(made) == lm.WAVES and sum(map(len, made)) == len(set().union(*made)) == 16
    assert max(map(len, made)) < 16


def test_a_hot_words_contexts_are_unpacked_in_steps(spark, monkeypatch):
    """A hot word's contexts are asked of all its shards; a task holds a bounded number of them, with the same scores."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(lm, "CONTEXTS", 60)
    rows = [(i, " ".join(f"the w{(i * 31 + j) % 200}" for j in range(40))) for i in range(90)]
    plain = Plain([t for k, t in rows if not held(k)], 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    model, out = lm.train_and_score(docs.repartition(3))
    assert max(model.hot.values()) > 2
    for r in out.collect():
        check(tuple(r)[2:], plain.row(dict(rows)[r.doc_id]))

    # one shard's parts, each with more n-grams than fit
    table = docs.select(F.col("doc_id").alias("id"), "text", "held").toArrow().combine_chunks().to_batches()[0]
    held_chunks = list(lm.encode(table.slice(i, 15) for i in range(0, 90, 15)))
    asked = []
    for batch in held_chunks:
        for sent in lm.parts(iter([batch.select(["chunk", "held", "sizes", "tokens", "words"])]), 3, 1, {}, 0):
            asked += zip(sent.column("chunk").to_pylist(), sent.column("blobs").to_pylist())
    found = lm.Asked(list(asked), 3)
    assert len(found.steps) == len(asked) > 1 and not found.kept
    whole = [lm.Part(b, 3).contexts for _, b in asked]
    for step in found.steps:
        got, ends = found.contexts(step)
        assert ends[-1] == len(got[3]) and all((got[k] == whole[step[0]][k]).all() for k in (2, 3))


def test_contexts_are_dealt_shard_by_shard():
    chunk = lm.Chunk(lm.pack(np.tile([0, 1, 0, 2, 0, 3, 1, 2], 5)), np.array([40]), lm.pack_steps(np.array([7, 1 << 61, 5 << 60, 9 << 60], np.uint64)))
    for wave in range(lm.WAVES):
        grams = lm.Grams(chunk, 3, wave)
        if not len(grams.at):
            continue
        hot = {int(w): 3 for w in chunk.words[:2]}
        sent, borders, contexts = lm.deal(chunk, grams, 5, hot)
        got = [contexts(s) for s in range(5)]
        assert all((np.diff(c) > 0).all() for c in got)
        copies = np.bincount(np.concatenate(got), minlength=len(grams.contexts))
        assert (copies == [hot.get(int(chunk.words[n]), 1) for n in grams.contexts[:, 0]]).all()
        for s in range(5):  # every n-gram's context is where the n-gram is
            assert set(grams.context[sent[borders[s]:borders[s + 1]]]) <= set(got[s].tolist())
