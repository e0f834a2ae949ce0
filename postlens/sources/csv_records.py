"""Header CSV files with line ends inside quoted cells, read by many tasks.

Spark's own multi-line CSV reader gives a file to one task.  Here the file is
read as lines, which split anywhere, and records are cut where the quotes say:

1. every split counts its quotes; a prefix sum of their parity over the splits
   of a file tells whether a split starts inside a quoted cell, and which
   record, begun in which split, is still open there (one row per split);
2. a line whose quotes are even and that starts outside a cell is a record;
   only the lines of longer records are grouped, by the place where their
   record starts, and joined again;
3. ``from_csv`` parses the records with the header's columns, all as text.

A doubled quote inside a cell counts twice and so changes nothing.  Files of
one read share one header line; unlike headers raise.  Empty lines between
records are skipped, as Spark's reader does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKED = ("file string, block long, at long, line string, inside boolean, odd boolean, start_outside long, start_inside long")


def mark_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, line) in file order -> ``MARKED``: the line's number in its split; whether it
    starts inside a cell if the split starts outside one; whether its quotes are odd; and the line at
    which its record starts, should the split start outside or inside a cell (-1: before the split)."""
    where, n, parity, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        file, block = batch.column("file"), batch.column("block")
        quotes = pc.count_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False)
        out: dict[str, list] = {k: [] for k in ("at", "inside", "odd", "outside", "within")}
        for f, b, q in zip(file.to_pylist(), block.to_pylist(), quotes, strict=True):
            if (f, b) != where:
                where, n, parity, starts = (f, b), 0, 0, [-1, -1]
            starts[parity] = n  # the line starts a record if the split's start makes the parity even
            out["at"].append(n)
            out["inside"].append(parity == 1)
            out["odd"].append(bool(q & 1))
            out["outside"].append(starts[0])
            out["within"].append(starts[1])
            parity ^= int(q & 1)
            n += 1
        yield pa.RecordBatch.from_arrays(
            [file, block, pa.array(out["at"], pa.int64()), batch.column("line"), pa.array(out["inside"], pa.bool_()),
             pa.array(out["odd"], pa.bool_()), pa.array(out["outside"], pa.int64()), pa.array(out["within"], pa.int64())],
            names=["file", "block", "at", "line", "inside", "odd", "start_outside", "start_inside"])


def records(spark: SparkSession, path) -> DataFrame:
    """``(file, block, at, record)``: the records of the files under ``path`` and where they start."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    marked = lines.mapInArrow(mark_lines, MARKED)

    # One row per split: does it start inside a cell, and where does the record that is open at its end start?
    blocks = marked.groupBy("file", "block").agg(
        (F.count_if("odd") % 2).alias("odd"), F.max("start_outside").alias("last_outside"), F.max("start_inside").alias("last_inside"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("cell", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    last = F.when(F.col("cell"), F.col("last_inside")).otherwise(F.col("last_outside"))
    place = F.when(last >= 0, F.struct(F.col("block").alias("block"), last.alias("at")))
    blocks = blocks.withColumn("open", F.last(place, ignorenulls=True).over(before)).select("file", "block", "cell", "open")

    told = marked.join(blocks, ["file", "block"])
    start = F.when(F.col("cell"), F.col("start_inside")).otherwise(F.col("start_outside"))
    told = told.select(
        "file", "block", "at", "line", (F.col("inside") != F.col("cell")).alias("within"), "odd",
        F.when(start >= 0, F.struct(F.col("block").alias("block"), start.alias("at"))).otherwise(F.col("open")).alias("start"))
    whole = told.filter("not within and not odd").select("file", "block", "at", F.col("line").alias("record"))
    pieces = told.filter("within or odd").groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    long = pieces.select("file", F.col("start.block").alias("block"), F.col("start.at").alias("at"),
                         F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("record"))
    return whole.unionByName(long).withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record != ''")


def read_split_csv(spark: SparkSession, path, null_cell: str) -> DataFrame:
    """The files under ``path`` with the header's columns, all as text, plus ``_file``."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header)
    rows = records(spark, path)
    first = rows.filter("block = 0 and at = 0")
    if first.select("record").distinct().limit(2).count() > 1:
        raise ValueError("files with unlike header lines; read them one by one")
    options = {"escape": '"', "nullValue": null_cell, "mode": "PERMISSIVE"}
    body = rows.filter("not (block = 0 and at = 0)")
    return body.select(F.from_csv("record", schema, options).alias("_r"), F.col("file").alias("_file")).select("_r.*", "_file")
