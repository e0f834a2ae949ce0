"""Operators 3, 8, 9: passages, benchmark items and near copies against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import classes, edited, jaccard_links, odd_rows, prose, shingles, with_clashes, words
from hypothesis import given, settings
from hypothesis import strategies as st

from postlens.llm.linking import components
from postlens.llm.common import WordBatch, mix64
from postlens.llm.op3_passages import (HASHES, flat_tokens, join_windows, repeated_passages, sketch, tree_windows,
                                       window_minima)
from postlens.llm.op8_benchmark import drop_leaks, find_leaks
from postlens.llm.op9_jaccard import jaccard_classes, screen_match, slack, survivors


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes({x for l in links for x in l}, links)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies():
    """Families of near copies at many distances, chains, and strangers that share lines."""
    rows, key = [], 100
    shared = prose(77, 12)
    for family in range(12):
        base = prose(family, 40 + 30 * family)
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            rows.append((key, edited(base, key, share)))
            key += 1
        rows.append((key, base.upper()))
        rows.append((key + 1, base + " " + prose(key, max(1, len(base.split()) // 12))))
        rows.append((key + 2, " ".join(base.split()[:-3])))
        key += 3
    chain = prose(500, 200)
    for i in range(12):
        chain = edited(chain, i, 0.012)
        rows.append((key + i, chain))
    rows += [(900 + i, shared + " " + prose(1000 + i, 20)) for i in range(30)]
    rows += [(950, "one"), (951, "ONE"), (952, "one two"), (953, "two one"), (954, "one two"), (955, "a b c"), (956, "a b c d")]
    return rows


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_classes_equal_brute_force(spark, size, percent):
    rows = odd_rows() + copies()
    docs = {k: t for k, t in rows if k is not None}
    want = classes(docs, jaccard_links(docs, size, percent))
    out = jaccard_classes(with_clashes(spark, rows), size, percent).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(shingles(docs[r.doc_id], size)), want[r.doc_id])
    assert len(set(want.values())) < len(want)


def test_jaccard_of_families_that_share_what_their_hub_lacks(spark):
    base, rows = prose(1, 300).split(), []
    for family in range(6):
        own = base[:]
        own[family * 40:family * 40 + 14] = prose(50 + family, 14).split()
        for copy in range(9):
            mine = own[:]
            for at in random.Random(family * 100 + copy).sample(range(300), 2):
                mine[at] = f"y{family}x{copy}x{at}"
            rows.append((family * 100 + copy, " ".join(mine)))
    docs = dict(rows)
    want = classes(docs, jaccard_links(docs, 5, 80))
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_jaccard_screen_moves_row_numbers_only(spark):
    rows = [(0, b"a" * 16, 1, [7, 1]), (1, b"b" * 16, 2, [7, 2, 3]), (2, b"c" * 16, 2, [7, 2, 4]), (3, b"d" * 16, 1, [5])]
    out = survivors(spark.createDataFrame(rows, "row long, node binary, m long, prefix array<long>"))
    assert sorted(r.row for r in out.collect()) == [0, 1, 2]
    steps = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x or "Aggregate" in x]
    assert len(steps) == 2 and not any("node" in x for x in steps)  # no digest with every shingle


def test_jaccard_of_repeated_rows_beside_copies_under_one_key(spark):
    one, two = prose(1, 120), prose(2, 120)
    rows = [(5, one), (5, two), (3, two), (5, one), (9, one + " end"), (8, two + " end")]
    out = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    got = Counter((r.doc_id, r.component_id) for r in out)
    assert got == {(5, 5): 2, (5, 3): 1, (3, 3): 1, (9, 5): 1, (8, 3): 1}


def test_jaccard_of_equal_keys_and_empty_tables(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50)), (3, prose(1, 50))]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.sampled_from([80, 90]), st.randoms(use_true_random=False))
def test_screen_keeps_every_pair_that_is_alike(n, other, percent, rng):
    """A true pair shares m prefix shingles for the m of either side."""
    n, other = max(n, other), min(n, other)
    for shared in {other, -(-percent * (n + other) // (100 + percent))}:
        if shared > other or 100 * shared < percent * (n + other - shared):
            continue
        pool = rng.sample(range(10**6), n + other - shared)
        both, x, y = pool[:shared], pool[shared:n], pool[n:]
        p = [sorted(both + own)[:slack(len(both) + len(own), percent) + screen_match(len(both) + len(own), percent) + 1] for own in (x, y)]
        met = len(set(p[0]) & set(p[1]))
        assert met >= screen_match(n, percent) and met >= screen_match(other, percent)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=60), st.integers(1, 12))
def test_tree_windows_hold_every_subsequence(values, t):
    h = np.array([9, *values, 3], np.uint64) + np.uint64(1)  # a text amid others
    minima = window_minima(h, np.array([0, 1, len(h) - 1]), np.array([1, len(h) - 1, len(h)]), t)
    h, at = h[1:-1], np.flatnonzero(minima[1:-1])
    found = tree_windows(h[at].tolist(), at.tolist(), len(h), t)
    assert len(found) == len(set(found))
    for v, left, c, right in found:
        assert h[c] == v == h[left:right + 1].min() and right - left + 1 >= t
    for i in range(len(h)):
        for j in range(i + t - 1, len(h)):
            assert sum(v == h[i:j + 1].min() and left <= i and j <= right for v, left, _, right in found) == 1


def test_joint_signatures_equal_brute_force_with_repeated_lines():
    """The minima of two functions over every run of t tokens or more, lines repeated before the passage included."""
    t = 10
    passage = prose(60, 30)
    line = " ".join(passage.split()[5:17])
    texts = [passage, *[f"{prose(61, n)} {' '.join([line] * k)} {passage} {prose(62, 5)} {line}" for n in (0, 7) for k in (1, 2, 5)],
             "for " * 40, " ".join([line] * 6)]
    windows = pa.Table.from_batches(sketch(iter([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})]), t, HASHES))
    got = [set(m) for b in join_windows(iter(windows.select(["node", "windows"]).to_batches()), t) for m in b.column("marks").to_pylist()]
    tokens, starts, ends = flat_tokens(WordBatch(pa.array(texts), lower=True))
    for found, a, b in zip(got, starts, ends, strict=True):
        h = [mix64(tokens[a:b] ^ mix64(np.array([fn + 1], np.uint64))[0]) for fn in range(HASHES)]
        want = set()
        for i in range(b - a):
            least = [np.minimum.accumulate(x[i:])[t - 1:] for x in h]
            for f in range(HASHES):
                for g in range(f + 1, HASHES):
                    kind = np.uint64((f * HASHES + g) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    want |= set(mix64(mix64(kind + least[f]) + least[g]).view(np.int64).tolist())
        assert found == want


def passage_rows():
    rows = []
    for i in range(60):
        rows.append((100 + i, prose(3000 + i, 90)))
    for k, n in enumerate((50, 51, 60, 90, 200)):  # exact passages amid own text
        p = prose(4000 + k, n)
        for i in range(4):
            rows.append((200 + 10 * k + i, f"{prose(5000 + 10 * k + i, 30 + 40 * i)} {p.upper() if i == 3 else p} {prose(6000 + 10 * k + i, 25 * i)}"))
    for k, n in enumerate((30, 44)):  # too short to count
        p = prose(4100 + k, n)
        for i in range(3):
            rows.append((300 + 10 * k + i, f"{prose(7000 + 10 * k + i, 60)} {p} {prose(7100 + 10 * k + i, 60)}"))
    near = prose(4200, 150)
    rows += [(400 + i, f"{prose(8000 + i, 50)} {edited(near, i, 0.01)} {prose(8100 + i, 50)}") for i in range(5)]
    rows += [(500, prose(9000, 100)), (501, prose(9000, 100)), (502, prose(9000, 30)), (503, prose(9000, 30))]
    return rows


def test_passages_equal_brute_force(spark):
    rows = odd_rows() + passage_rows()
    docs = {k: t for k, t in rows if k is not None}
    held = defaultdict(set)
    for k, t in docs.items():
        w = words(t, lower=True)
        for i in range(len(w) - 49):
            held[tuple(w[i:i + 50])].add(k)
    exact = classes(docs, [(min(g), k) for g in held.values() for k in g if k != min(g)])
    near = classes(docs, [(a, b) for a, b in exact.items() if a != b] + [(400, 400 + i) for i in range(5)])
    out = repeated_passages(with_clashes(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.class_id is None
            continue
        assert r.class_id == near[r.doc_id], r
        assert r.n_words == len(words(docs[r.doc_id]))
        assert (r.repeat_words > 0) == (Counter(near.values())[r.class_id] > 1 or r.doc_id == 4), r
    words_of = {r.doc_id: r.repeat_words for r in out}
    assert words_of[500] == 100 and words_of[502] == 0
    assert 40 <= words_of[200] <= 60 and 195 <= words_of[240] <= 215
    assert repeated_passages(with_clashes(spark, rows).limit(0)).count() == 0


def test_words_of_two_passages_inside_one_component(spark):
    """A text that shares one passage with one hub and another with a second hub,
    where the hubs are linked already, has both passages' words covered."""
    p, q, between, one, two = (prose(4300 + i, n) for i, n in enumerate((100, 100, 100, 900, 600)))
    rows = [(1, f"{prose(1, 30)} {p} {prose(2, 30)} {between} {prose(3, 30)} {one}"), (2, f"{one} {prose(4, 40)}"),
            (3, f"{prose(5, 30)} {q} {prose(6, 30)} {between} {prose(7, 30)} {two}"), (4, f"{two} {prose(8, 40)}")]
    rows += [(10 + i, f"{prose(50 + i, 60)} {p} {prose(60 + i, 60)} {q} {prose(70 + i, 60)}") for i in range(3)]
    docs = {k: words(t, lower=True) for k, t in rows}
    held = defaultdict(set)
    for k, w in docs.items():
        for i in range(len(w) - 49):
            held[tuple(w[i:i + 50])].add(k)
    out = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, w in docs.items():
        covered = {j for i in range(len(w) - 49) if len(held[tuple(w[i:i + 50])]) > 1 for j in range(i, i + 50)}
        assert out[k].class_id == 1
        assert len(covered) <= out[k].repeat_words <= len(covered) + 40, (k, len(covered), out[k].repeat_words)


def test_recall_of_passages_with_one_changed_word(spark):
    """Of the pairs of 50-word passages that brute force finds alike, nearly all are linked."""
    rows, alike = [], []
    for i in range(400):
        w = prose(20_000 + i, 50).split()
        v = [*w[:8 + i % 34], f"x{i}", *w[9 + i % 34:]]
        rows += [(2 * i + j, f"{prose(30_000 + 2 * i + j, 30)} {' '.join(p)} {prose(40_000 + 2 * i + j, 30)}") for j, p in enumerate((w, v))]
        a, b = (shingles(" ".join(p), 5) for p in (w, v))
        if 100 * len(a & b) >= 80 * len(a | b):
            alike.append(2 * i)
    out = {r.doc_id: r.class_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(alike) > 300
    assert sum(out[k + 1] == out[k] for k in alike) >= 0.97 * len(alike)


def brute_leaks(docs, items):
    sets = {}
    for k, t in sorted(items):
        w = [x for x in words((t or "").lower())]
        size = min(5, len(w))
        if w:
            g = frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
            sets.setdefault((size, g), k)
    out = set()
    for key, text in docs:
        w = words((text or "").lower())
        for (size, g), k in sets.items():
            mine = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else set()
            if 100 * len(g & mine) >= 80 * len(g):
                out.add((key, k, len(g), len(g & mine)))
    return out


def leak_tables():
    items = [(i, prose(100 + i, n)) for i, n in enumerate((5, 6, 9, 15, 20, 33, 60, 120))]
    items += [(20, None), (21, ""), (22, "short one"), (23, "x"), (24, items[4][1]), (25, items[4][1].upper()), (None, prose(999, 20)),
              (26, "common start of every item here " + prose(50, 9)), (27, "common start of every item here " + prose(51, 9))]
    docs = odd_rows()
    key = 100
    for i, (_, t) in enumerate(items[:8]):
        for share in (0, 0.02, 0.05, 0.1, 0.3):
            docs.append((key, f"{prose(key, 200)} {edited(t, key, share)} {prose(key + 1, 100)}"))
            key += 1
        docs.append((key, " ".join(t.split()[:max(1, int(len(t.split()) * 0.85))])))
        key += 1
    docs += [(key, f"This is a Short ONE indeed {items[8 + 7][1]}"), (key + 1, "common start of every item here and more"), (key, "another text")]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_tables()
    table = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, hash int")
    frame = with_clashes(spark, docs)
    found = {(r.doc_key, r.item_id, r.n_item, r.n_shared) for r in find_leaks(frame, table).collect()}
    want = brute_leaks(docs, [(k, t) for k, t in items if k is not None])
    assert {x for x in found if x[1] is not None} == want and len(want) > 20
    kept = drop_leaks(frame, table)
    leaky = {t for k, t in docs if any(x[0] == k for x in brute_leaks([(k, t)], [(0 if a is None else a, b) for a, b in items]))}
    assert kept.columns == frame.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t in docs if t not in leaky)


def test_leaks_of_empty_tables(spark):
    docs, items = leak_tables()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert find_leaks(with_clashes(spark, docs), table.limit(0)).count() == 0
    assert find_leaks(with_clashes(spark, docs).limit(0), table).count() == 0
    assert drop_leaks(with_clashes(spark, docs), table.limit(0)).count() == len(docs)
