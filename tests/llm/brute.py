"""Plain-Python versions of the operators' definitions, and shared fixtures."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(ASCII) if lower else text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, size):
    w = words(text, lower=True)
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def classes(keys, linked):
    """Smallest key reachable, by key."""
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in linked:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def jaccard_links(docs: dict, size: int, percent: int):
    sets = {k: shingles(t, size) for k, t in docs.items()}
    held = defaultdict(list)
    for k in sorted(sets):
        met = Counter(j for g in sets[k] for j in held[g])
        for j, n in met.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                yield j, k
        for g in sets[k]:
            held[g].append(k)


def line_key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(ASCII)


def brute_lines_of(rows, min_docs):
    """(key, lines, dropped lines, text left) of every row."""
    held = Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for key, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[line_key(x)] < min_docs]
        out.append((key, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


def prose(seed: int, n: int) -> str:
    """``n`` words of invented prose."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ras", "tel")) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    """The text with a share of its words replaced."""
    rng = random.Random(seed)
    return " ".join(f"x{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split(" "))


#: Columns whose names the operators use inside.
CLASH = "id long, node long, n long, text_key string, kept boolean, hi long, word_text string, copy int"


def with_clashes(spark, rows):
    """(doc_id, text) rows with extra columns of clashing names."""
    return spark.createDataFrame([(k, t, 7, 7, 7, "k", False, 7, "w", 7) for k, t in rows],
                                 f"doc_id long, text string, {CLASH}")


def odd_rows():
    """Null, empty, blank, very long, repeated and null-keyed rows."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (4, long), (None, prose(2, 80)), (5, "Ärger Straße 日本語 \x1c ok"),
            (6, prose(3, 120)), (7, prose(3, 120)), (8, "a\nb\n\nA \n"), (9, "x" * 200_000), (10, "For " * 5_000)]
