"""Join helpers: broadcast only behind a checked bound, shuffle join otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest row bound we are willing to broadcast (each executor holds a copy).
MAX_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``row_bound`` rows and that
    bound is small; otherwise leave it to the planner (sort-merge or
    shuffle-hash join, AQE may still convert at runtime).

    The bound is checked: by the plan where it ends in a limit, else by a count
    of the rows (``df`` is then a fitted table, not an unfinished computation).
    """
    if row_bound is None or row_bound > MAX_BROADCAST_ROWS:
        return df
    known = df._jdf.queryExecution().optimizedPlan().maxRows()
    within = (known.isDefined() and known.get() <= row_bound) or df.limit(row_bound + 1).count() <= row_bound
    return F.broadcast(df) if within else df


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None, task_bytes: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenizing whole texts) enough tasks.

    A scan yields one task per file split, and a file written as one row group
    cannot be split.  When the scan of ``df``, a table as read, has too few
    files and bytes to occupy the cluster, its rows are dealt by ``key`` (later
    aggregations on ``key`` reuse this partitioning) or round-robin without a
    key.  Larger inputs are left alone.  With ``task_bytes`` no task gets more
    of the table's bytes than that, for work that holds what it makes of a
    task's rows.  Only file listings and sizes are looked at: building the frame
    runs nothing.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    if task_bytes:
        target = max(target, -(-size // task_bytes))
    if files == 0 or max(files, size // split) >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
