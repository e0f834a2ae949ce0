"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Tables the driver generates under ``/root/testdata/sf*/``.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


LOCAL_MASTER = r"local(\[.*\])?"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "postlens") -> SparkSession:
    """Return the active session, or build one tuned for this workload.

    On a cluster the session already exists (``spark-submit``) and is returned
    untouched.  Locally we enable AQE (partition coalescing and skew-join
    splitting), keep the UI off and size shuffles to the core count.  Only a
    local master gets a temporary checkpoint folder; a cluster has to name one
    that its executors share (:func:`checkpoint_dir` raises without it).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("POSTLENS_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POSTLENS_DRIVER_MEMORY", "16g"))
    )
    if re.fullmatch(LOCAL_MASTER, master):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="postlens-ckpt-"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent, a session with a local master (one JVM, as in
    tests) gets a temporary folder, registered with the context so that
    ``DataFrame.checkpoint`` and MLlib's ``checkpointInterval`` use it; on a
    cluster there is no folder to fall back on, and this raises.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not re.fullmatch(LOCAL_MASTER, sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="postlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
