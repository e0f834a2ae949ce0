"""Operator 11: conversation repair against a plain search over edit strings."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import sha

from postlens.llm.op11_repair import BASE, Grammar, compress, damage_and_repair, learn_rules, pair_table, repair

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, repaired rows): all edit strings, the best kept per state."""
    best = {"": (0, "", [])}  # state: what the next turn may follow

    def spread(best):
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                found = (cost + 3, audit + "I", done + [(role, "")])
                if role[0] not in best or found < best[role[0]]:
                    best[role[0]] = found
        return best

    for role, text, fault in rows:
        step = {}
        for state, (cost, audit, done) in spread(best).items():
            more = 3 if fault == "truncated" else 0
            moves = [(state, (cost + 4, audit + "D", done))]
            if fault not in ("blank", "duplicate"):
                turn = "assistant" if state == "u" else "user"
                moves.append((turn[0], (cost + 3 + more, audit + "R", done + [(turn, text)])))
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    moves.append((role[0], (cost + more, audit + "K", done + [(role, text)])))
            for to, found in moves:
                if to not in step or found[:2] < step[to][:2]:
                    step[to] = found
        best = step
    ends = [v for k, v in spread(best).items() if k in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def brute(rows):
    """{conv_id: everything} of rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in rows if r[0] == conv],
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            inner = text.strip(BLANKS)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, done = cheapest(marked)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                     sha("\n".join(f"{r}:{t}" for r, t in done)))
    return out


def talk(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User"]
    return [(conv, rng.choice([i, i, i, i + 3, None]), rng.choice(roles[:5] if rng.random() < 0.8 else roles),
             rng.choice(["Yes.", "No!", "hm", "so what?", " ok. \t", "", " \n", "a\x1c", "é…", "Line one.\nline two."])) for i in range(n)]


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 7, "s", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, seq string, kind int, piece long, digest string, key int")


def test_repair_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randint(1, 14))]
    rows += [(500, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(300)]
    rows += [(501, i, rng.choice(["user", "assistant"]), f"Turn {i}" + rng.choice(["", "."])) for i in range(200)]
    rows += [(None, 1, "user", "Key lost."), (None, None, None, None), (600, None, None, "Odd."), (601, 1, "user", "x" * 300_000 + ".")]
    rows += [(602, 1, "user", "Twice."), (602, 1, "user", "Twice."), (602, 1, "assistant", "Twice.")]
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = {r[0]: tuple(r)[1:] for r in repair(spark.createDataFrame(filled, "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute(filled)
    damaged = brute(hurt(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    out = damage_and_repair(clashing(spark, rows)).collect()
    assert len(out) == len({r[0] for r in rows})
    assert {r[0]: tuple(r)[1:] for r in out} == {c: damaged.get(c, nothing) for c in {r[0] for r in rows}}


def test_query_equals_brute_force_on_its_table(spark):
    from conftest import SF001

    from postlens.llm.op11_repair import op11_conversation_repair
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = brute(hurt(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, SF001).collect()}
    assert got == {c: damaged.get(c, nothing) for c in {r[0] for r in rows}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert damage_and_repair(empty).count() == 0


def test_grammar_expands_and_its_matrices_equal_the_plain_program(spark):
    """Rules lose no symbol; the compressed program finds the audit that the uncompressed one finds."""
    rng = random.Random(3)
    seqs = ["".join(rng.choice(["ua", "ua", "uA", "X", "sua", "o", "uu", "aa"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    seqs += ["u" * n for n in range(9)] + ["ua" * 500]
    rounds = learn_rules(spark.createDataFrame([(s,) for s in seqs], "seq string"), max_rules=40, a_round=6)
    tables = [pair_table(r) for r in rounds]
    rules = {made: (a, b) for r in rounds for a, b, made in r}
    assert 6 < len(rules) <= 40
    plain, grammar = Grammar([]), Grammar(rounds)

    def expand(code):
        return BASE[code] if code < len(BASE) else "".join(map(expand, rules[code]))

    short = 0
    for seq, codes in zip(seqs, compress(seqs, tables), strict=True):
        assert "".join(map(expand, codes.tolist())) == seq
        assert grammar.best(codes.tolist()) == plain.best([BASE.index(c) for c in seq])
        short += len(codes)
    assert short < sum(map(len, seqs)) / 2


@pytest.mark.parametrize("seq,want", [("", (0, "")), ("s", (4, "D")), ("ua", (0, "KK")), ("a", (3, "IK")), ("uu", (3, "KR")), ("X", (4, "D"))])
def test_small_cases(seq, want):
    assert Grammar([]).best([BASE.index(c) for c in seq]) == want
    assert np.array(compress([seq], [])[0]).tolist() == [BASE.index(c) for c in seq]
