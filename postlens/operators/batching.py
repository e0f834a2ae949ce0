"""Row numbering, batching and running (windowed) metrics.

A global ``row_number()`` over an un-partitioned window funnels every row
through one task.  ``global_row_number`` instead range-partitions by the
order key (a hot key spreads over many partitions because the order key is
unique), materializes partition id and in-partition position once into the
shared checkpoint folder, and adds per-partition offsets taken from a table
with one row per partition (a broadcast with a provable bound).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import bounded_broadcast


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_row_number(df: DataFrame, order: list, out: str = "row_number", key: str | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (which must be a total order,
    e.g. end with the key) without a single-partition window.

    With ``key`` (a unique column), only the key and the order columns are
    range-sorted and checkpointed; the numbers are then joined back to the
    full rows on the key, so wide rows (token arrays) are never written to the
    checkpoint.  Without it the whole rows are numbered in place.
    """
    cols = df.columns
    narrow = key is not None
    src = df
    if narrow:
        if not all(isinstance(c, str) for c in order):
            raise ValueError("with key=, give the order as column names")
        src = df.select(*dict.fromkeys([key, *order]))
    tagged = src.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    tagged = cut_lineage(tagged)  # fixes ids; re-reads after executor loss stay identical
    stats = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select("_pid", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per range partition: bounded by spark.sql.shuffle.partitions.
    joined = tagged.join(bounded_broadcast(offs, _shuffle_partitions(df)), "_pid")
    rn = (F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(1)).cast("long")
    if not narrow:
        return joined.select(*cols, rn.alias(out))
    numbers = joined.select(F.col(key).alias("_k"), rn.alias(out))
    # unique key on both sides: an equi-join with no hot key
    return df.join(numbers, df[key] == numbers["_k"]).select(*cols, out)


def assign_batches(df: DataFrame, order: list, size: int, out: str = "batch_id",
                   key: str | None = None) -> DataFrame:
    """Number rows in ``order`` and cut them into batches of ``size``
    (``ceil(n/size)`` batches; the last may be short).  ``key``: a unique
    column, to checkpoint only keys (see :func:`global_row_number`)."""
    narrow = key is not None and set(df.columns) <= {key, *order}  # nothing to join back
    numbered = global_row_number(df, order, "row_number", None if narrow else key)
    return numbered.withColumn(out, F.floor((F.col("row_number") - 1) / F.lit(size)).cast("long"))


def shuffled_positions(df: DataFrame, key: str = "doc_id", seed: int = 0,
                       out: str = "position") -> DataFrame:
    """Reproducible shuffled order as explicit positions (md5 of key||seed)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    narrow = set(df.columns) == {key}  # nothing to join back
    numbered = global_row_number(df.withColumn("_h", h), ["_h", key], out, None if narrow else key)
    return numbered.drop("_h")


def running_loss(log: DataFrame, part: str, order: list, value: str, every: int = 10,
                 trailing: int = 10, chunks: int | None = None) -> DataFrame:
    """Per-``part`` running metric over ``order``: step number, cumulative sum,
    trailing mean of the last ``trailing`` values, the cumulative sum divided
    by the report interval (what a loss printed every ``every`` steps without
    resetting its accumulator shows) and a flag on report steps.  Null values
    take a step and count in neither sum nor mean, as SQL's aggregates have it.

    Skew-safe: a single ``part`` value may hold a large share of the rows, so
    the work is not one window per ``part``.  Rows are range-partitioned on
    ``(part, order)`` -- the sampled boundaries split a hot ``part`` into
    several chunks -- and the chunk id is fixed by a checkpoint.  Windows run
    per ``(part, chunk)`` (bounded by one range partition); per-chunk totals
    (one row per chunk) give each chunk its offsets.  The trailing mean is a
    window, too, never a difference of large sums: inside a chunk for all rows
    but its first ``trailing - 1``, and for those over the rows around the
    chunk borders (at most ``2 * (trailing - 1)`` per chunk).
    """
    n = chunks or _shuffle_partitions(log)
    keyed = log.repartitionByRange(n, F.col(part), *[F.col(c) for c in order]).withColumn(
        "_chunk", F.spark_partition_id())
    keyed = cut_lineage(keyed)
    w = Window.partitionBy(part, "_chunk").orderBy(*order)
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = w.rowsBetween(-(trailing - 1), Window.currentRow)
    local = keyed.select("*", F.row_number().over(w).alias("_ls"), F.sum(value).over(cum).alias("_lsum"),
                         F.avg(value).over(near).alias("_near"))
    tot = keyed.groupBy(part, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    chunk = Window.partitionBy(part).orderBy("_chunk")
    before = chunk.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(part, "_chunk", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_on"),
                      F.sum("_s").over(before).alias("_os"), F.lead("_n").over(chunk).isNull().alias("_last"))
    running = F.when(F.col("_os").isNull(), F.col("_lsum")).otherwise(F.col("_os") + F.coalesce("_lsum", F.lit(0.0)))
    ran = local.join(offs, [part, "_chunk"]).select(
        *log.columns, "_near", (F.col("_on") + F.col("_ls")).cast("long").alias("step"), running.alias("running_sum"),
        ((F.col("_on") > 0) & (F.col("_ls") < trailing)).alias("_head"),
        (~F.col("_last") & (F.col("_n") - F.col("_ls") < trailing - 1)).alias("_tail"))
    ran = cut_lineage(ran)
    border = Window.partitionBy(part).orderBy("step").rangeBetween(-(trailing - 1), 0)
    heads = ran.filter(F.col("_head") | F.col("_tail")).withColumn("trailing_mean", F.avg(value).over(border)).filter("_head")
    inner = ran.filter(~F.col("_head")).withColumn("trailing_mean", F.col("_near"))
    out = inner.unionByName(heads).select(*log.columns, "step", "running_sum", "trailing_mean")
    return out.withColumn("reported_loss", F.col("running_sum") / F.lit(float(every))).withColumn(
        "reported", (F.col("step") % every) == 0)
