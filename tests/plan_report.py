"""Write PLANS.md: the operator skeleton of each headline query's physical
plan (exchanges, joins, aggregates, windows, generators, scans).

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HEADLINE = ["preprocess_job", "vocab_fit", "tfidf_transform", "encode_ids", "stack_features", "class_report",
            "mcnemar", "split_overlap", "running_loss", "assign_batches", "decode_entities", "token_policy"]
KEEP = re.compile(r"(Exchange|Join|Aggregate|Window|TakeOrdered|Generate|Scan|Subquery|BroadcastExchange|Sort |Union)")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^]]*\], ", "", line)
        line = re.sub(r"PartitionFilters: \[\], ", "", line)
        out.append(line[:200].rstrip())
    return out


def main() -> None:
    from postlens.session import get_session
    import __spark_entry__ as ent
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    qs = ent.queries()
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tests/plan_report.py` at `{sf}` (`local[8]`, 8 shuffle partitions, AQE on; the",
             "initial plan before runtime re-optimization). Only exchanges, joins, aggregates, windows,",
             "generators and scans are kept; `tests/test_plans.py` asserts the key properties.", ""]
    for name in HEADLINE:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            qs[name](spark, sf).explain()
        lines += [f"## {name}", "", "```", *skeleton(buf.getvalue()), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
