"""Run catalogue queries on Spark and their SQL on DuckDB; compare row count,
column names and an order-insensitive hash of the values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (int,)):
        return str(int(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as ent
    qs, sqls = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or sorted(qs)):
        if name not in sqls:
            continue
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK ERROR {str(e)[:400]}")
            continue
        ts = time.time() - t0
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SQL ERROR {str(e)[:400]}")
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                  for f in sdf.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in cur.description}
        ok_types = stypes == dtypes
        ok_cols = ok_cols and ok_types
        ok_n = len(srows) == len(drows)
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = ok_cols and ok_n and hs == hd
        results[name] = ("ok" if ok else "mismatch", len(srows))
        if verbose:
            print(f"{name:28s} {'OK ' if ok else 'BAD'} rows {len(srows)}/{len(drows)} cols {ok_cols} "
                  f"hash {hs == hd} {ts:.1f}s")
            if not ok:
                if not ok_cols:
                    print("   spark cols", stypes, "\n   duck cols ", dtypes)
                a, b = set(ls), set(ld)
                print("   only spark:", sorted(a - b)[:3])
                print("   only duck: ", sorted(b - a)[:3])
    return results


if __name__ == "__main__":
    from postlens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] != "ok"]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
