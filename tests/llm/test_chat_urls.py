"""Operators 2 and 10: chat formatting and URL filters."""

import json
from collections import Counter, defaultdict

import pytest
from brute import sha
from pyspark.sql import functions as F

from postlens.llm.op2_chat import (LAYOUTS, PROBE, canonical_turns, format_chats, layout_fingerprints, read_loss_text,
                                   read_turns, turn_records)
from postlens.llm.op10_urls import RULES, judge_urls

RECORDS = [
    ({"id": 1, "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi"},
                            {"role": "assistant", "content": None}]}, "messages",
     [("system", "be kind"), ("user", "hi"), ("assistant", "")]),
    ({"id": 2, "messages": [{"role": "user", "content": "hi", "name": "bob"}]}, "messages", [("user", "hi")]),
    ({"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value",
     [("user", "q"), ("assistant", "a")]),
    ({"id": 4, "prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"id": 5, "prompt": "p", "completion": "c", "system": "s"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"id": 6, "prompt": "p", "response": None}, "prompt_response", [("user", "p"), ("assistant", "")]),
    ({"id": 7, "instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"id": 8, "instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"id": 9, "instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"id": 10, "turn": 0, "role": "user", "text": "t"}, "turn_rows", [("user", "t")]),
    ({"id": 11, "question": "?", "answers": [1, 2]}, None, []),
    ({"id": 12, "messages": []}, None, []),
]


def records(spark, items):
    rows = [(r["id"], json.dumps(r)) for r in items]
    return spark.createDataFrame(rows, "conv_id long, j string").select("conv_id", F.parse_json("j").alias("v"))


def test_fingerprints_select_the_mapping(spark):
    out = {r.conv_id: r for r in canonical_turns(records(spark, [r for r, _, _ in RECORDS])).collect()}
    for record, layout, turns in RECORDS:
        got = out[record["id"]]
        assert got.layout == layout
        assert [(t.role, t.text) for t in got.turns] == turns
    marks = [m for m, _ in layout_fingerprints(LAYOUTS)]
    assert len(marks) == len(set(marks))


def read_back(df):
    rows = df.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                     read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), "loss_mask").collect()
    return {r.conv_id: r for r in rows}


NASTY = [PROBE, "", "\\", "\\s<|\\p", "<", "<|", "|im_end|>", "a\n<|im_start|>user\nb<|im_end|>\n", "\\n", "🙂ä<|im_end|", "x" * 50_000, None]


def test_template_is_reversible(spark):
    turns = [(k, i, role, text) for k, base in enumerate(NASTY) for i, (role, text) in enumerate(
        [("user", base), ("assistant", NASTY[-1 - k]), ("odd\nrole<|", base), (None, base), ("assistant", base)])]
    rows = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn int, role string, text string, layout int, formatted string")
    out = read_back(format_chats(turn_records(rows)))
    for k in range(len(NASTY)):
        mine = [(r or "", t or "") for c, _, r, t in turns if c == k]
        assert [(t.role, t.text) for t in out[k].turns] == mine
        learned = [t for r, t in mine if r == "assistant"]
        assert out[k].loss == "".join(learned) and len(out[k].loss_mask) == len(learned)


def test_turn_order_ties_nulls_and_empty_tables(spark):
    rows = [(1, 2, "user", "late"), (1, None, "user", "first"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"),
            (None, 0, "assistant", "lost")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = read_back(format_chats(turn_records(table)))
    assert [t.text for t in out[1].turns] == ["first", "a", "a", "b", "late"]
    assert out[None].loss == "lost"
    assert format_chats(turn_records(table.limit(0))).count() == 0
    mixed = read_back(format_chats(records(spark, [r for r, _, _ in RECORDS])))
    assert [len(mixed[r["id"]].turns) for r, _, _ in RECORDS] == [len(t) for _, _, t in RECORDS]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[:min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow" if host else "block"


URLS = [None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/12",
        "http://xexample.org/en/1", "http://a.b.com/de/x", "http://com/fr/", "x://y.com?/de/", "http://a.com#/de/", "http://..com/de/",
        "http://u:p@h.com:80/de/1", "http://é.com/de/ü", "http://a.com/de/" + "z" * 100_000, "http://b.org/en/1://x", "http://a.com//de/"]


@pytest.mark.parametrize("per_cell", [100_000, 2])
def test_urls_equal_brute_force(spark, per_cell):
    rules = [*RULES, ("a.com", "/de/", "allow"), ("b.org", "/", "allow"), ("b.org", "/", "block"), ("example.org", "/", "allow"),
             *[(f"h{i}.b.com", f"/p{i % 3}", "block") for i in range(12)], ("b.com", "/p", "allow")]
    urls = URLS + [f"https://w{i}.h{i % 14}.b.com/p{i % 4}/x" for i in range(60)] + ["http://z.h3.b.com/p0"] * 20
    pages = spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(urls)] + [(None, urls[7], "x", 1, "y")],
                                  "page_id long, url string, host string, cell int, verdict string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("x.org", None, "allow")], "host string, path string, verdict string")
    out = judge_urls(pages, table, rules_per_cell=per_cell, urls_per_lane=7).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out)
    want = Counter((i, *brute_url(u, rules)) for i, u in [*enumerate(urls), (None, urls[7])])
    assert got == want


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).first().verdict == "allow"
