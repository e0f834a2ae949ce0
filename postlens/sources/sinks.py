"""Writers and model persistence."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "append",
                partition_by: list[str] | None = None) -> None:
    """Write a table; CSV gets a header and quoting, vectors/arrays are
    written as parquet or flattened to text first by the caller.

    ``mode`` is explicit (the reference appended and rewrote the header on
    every run); one file per task, no coalesce to a single writer.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # cells as they are: no trimming; null is an empty cell, an empty string a quoted one
        (w.option("header", True).option("escape", '"').option("quoteAll", False)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", "").option("emptyValue", '""').csv(path))
    else:
        w.format(fmt).save(path)


def append_run(df: DataFrame, path: str, run_id: str, fmt: str = "csv") -> None:
    """Append ``df`` as one run that can be repeated: the rows go to the folder
    ``run=<run_id>``, which a rerun replaces as a whole.  Spark's committer
    writes ``_SUCCESS`` into it last; :func:`read_runs` sees only folders that
    hold this mark, so a failed run shows nothing."""
    if not run_id or "/" in run_id or "=" in run_id:
        raise ValueError("a run id without '/' and '='")
    write_table(df, f"{path.rstrip('/')}/run={run_id}", fmt, mode="overwrite")


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the runs under ``path`` that ended."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "run=*/_SUCCESS"))
    return sorted(f.getPath().getParent().toString() for f in found or [])


def write_meta_features(df: DataFrame, path: str, vector_col: str = "meta_features", key: str = "doc_id",
                        fmt: str = "parquet", mode: str = "overwrite", width: int | None = None) -> None:
    """Persist the stacked feature matrix: parquet keeps the vector; CSV gets a
    header and one column per feature.

    A CSV line is put together in the row, as one text: thousands of features
    as columns of the plan would take longer to plan than to write.  ``width``
    (else read from the first row) names the columns.
    """
    if fmt == "parquet":
        df.select(key, vector_col).write.mode(mode).parquet(path)
        return
    from pyspark.ml.functions import vector_to_array
    arr = df.select(key, vector_to_array(vector_col).alias("_v"))
    if width is None:
        first = arr.select(F.size("_v").alias("n")).head()
        width = first["n"] if first else 0
    header = ",".join([key, *[f"f{i}" for i in range(width)]])
    line = F.concat_ws(",", F.col(key).cast("string"), F.array_join("_v", ","))
    (arr.select(line.alias(header)).write.mode(mode).option("header", True)
     .option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).csv(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp dir on a cluster)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def save_model(model, path: str, version: str | None = None) -> str:
    """Save an MLlib model/pipeline; with ``version``, under ``path/version``."""
    target = os.path.join(path, version) if version else path
    model.write().overwrite().save(target)
    return target


def load_model(path: str):
    """Load what ``save_model`` wrote: a pipeline, a learner's model or any
    other MLlib stage, by the class that its metadata names."""
    from pyspark.ml.util import DefaultParamsReader
    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())
