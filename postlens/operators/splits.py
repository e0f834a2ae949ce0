"""Deterministic, key-hashed splits, folds and row order.

Every assignment is a pure function of the row key (md5), so it is stable
across re-execution after executor loss, across engines (the same expression
runs in DuckDB) and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hash(key, salt: str = "") -> Column:
    """First 32 bits of ``md5(key || salt)`` as a non-negative BIGINT."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def label_split(df: DataFrame, key: str = "doc_id", fractions=(("train", 0.7), ("validate", 0.15), ("test", 0.15)),
                salt: str = "split", out: str = "split") -> DataFrame:
    """Assign each row to a named split with the given fractions (by key hash)."""
    bucket = (key_hash(key, salt) % F.lit(10000)).cast("int")
    expr = None
    upper = 0.0
    for i, (name, frac) in enumerate(fractions):
        upper += frac
        bound = 10000 if i == len(fractions) - 1 else int(round(upper * 10000))
        cond = bucket < F.lit(bound)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn(out, expr)


def fold_assign(df: DataFrame, k: int, key: str = "doc_id", salt: str = "fold", out: str = "fold") -> DataFrame:
    """Fold id in ``[0, k)`` per key."""
    return df.withColumn(out, (key_hash(key, salt) % F.lit(k)).cast("int"))


def group_folds(df: DataFrame, k: int, group: str, salt: str = "fold", out: str = "fold") -> DataFrame:
    """Fold id in ``[0, k)`` per value of ``group``, so that all its rows (copies of a text, say) share one.

    Groups of more than 1/(8 k) of the rows, fewer than 8 k of them, are dealt
    largest first to the lightest fold; the others by their hash, in shares
    that fill the folds up evenly.  Null is a group.  Sizes come from one partial
    aggregation.
    """
    name = F.sha2(F.coalesce(F.col(group).cast("string"), F.lit("")), 256)
    sizes = df.groupBy(name.alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    large = sizes.filter(F.col("_n") > total / (8 * k)).collect()
    load, dealt = [0] * k, {}
    for row in sorted(large, key=lambda r: (-r["_n"], r["_g"])):
        fold = min(range(k), key=lambda f: (load[f], f))
        dealt[row["_g"]] = fold
        load[fold] += row["_n"]
    room = [max(0.0, total / k - n) for n in load]
    fold = F.lit(k - 1)
    for f in range(k - 2, -1, -1):
        upto = sum(room[:f + 1]) / sum(room) if sum(room) else 0.0
        fold = F.when(key_hash(name, salt) < int(upto * 2**32), F.lit(f)).otherwise(fold)
    for g, f in dealt.items():
        fold = F.when(name == g, F.lit(f)).otherwise(fold)
    return df.withColumn(out, fold)


def split_overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Leak guard: rows of ``left`` whose ``on`` values also occur in ``right``
    (rows with a null among them are shared with nothing).

    One row ``(n_left, n_right, n_shared)``.  Both sides are reduced to a
    256-bit hash of the values, so that no texts are shuffled; the right side is
    de-duplicated (partial aggregation) and flagged, and a left outer join
    counts left rows and hits in one aggregation.  De-duplication means a hot
    key costs one row on the right; AQE splits a hot key on the left.
    """
    def marked(df: DataFrame) -> DataFrame:
        whole = F.lit(True)
        for c in on:
            whole = whole & F.col(c).isNotNull()
        return df.select(F.when(whole, F.sha2(F.to_json(F.struct(*on)), 256)).alias("_mark"))

    r = marked(right).dropDuplicates(["_mark"]).withColumn("_hit", F.lit(1))
    counted = marked(left).join(r, on="_mark", how="left").agg(
        F.count(F.lit(1)).alias("n_left"), F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("n_shared"))
    return counted.select("n_left", right.select(F.count(F.lit(1))).scalar().alias("n_right"), "n_shared")
