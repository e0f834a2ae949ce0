"""Readers for labelled messages and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CLASS_BODIES
from .csv_records import read_split_csv

#: What an unquoted empty cell stands for while reading; no text holds it.
NULL_CELL = "\x00"


def read_labeled(spark: SparkSession, path: str, fmt: str = "csv", text_col: str | int = "text",
                 label_col: str | int = "label", key: str = "doc_id", schema: T.StructType | None = None,
                 multi_line: bool = True) -> DataFrame:
    """Labelled messages as ``(doc_id, text, label)``.

    CSV: header row, quoted UTF-8 cells; columns are picked by the header's
    names, or by position in the file; an empty cell is null, a quoted empty
    cell an empty string.  Cells may hold line ends (``multi_line``): large files
    are split all the same (``csv_records``).  With ``multi_line=False``, where
    cells have none, Spark's reader splits them.  ``schema`` names the columns
    explicitly and is checked against the header.  Parquet / ORC / JSON are read
    with their own schema.

    Rows without a key get a hash of file, text and label: it does not change
    with the file splits, and equal rows of one file share it.
    """
    file = F.col("_metadata.file_path")
    if fmt == "csv" and schema is None and multi_line:
        df = read_split_csv(spark, path, NULL_CELL)
        file = F.col("_file")
    elif fmt == "csv":
        reader = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
                  .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("nullValue", NULL_CELL))
        df = (reader.schema(schema).option("enforceSchema", False) if schema else reader).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    cols = df.columns
    t = cols[text_col] if isinstance(text_col, int) else text_col
    lab = cols[label_col] if isinstance(label_col, int) else label_col
    missing = [c for c in (t, lab) if c not in cols]
    if missing:
        raise ValueError(f"no column {missing} in the header {cols}")
    k = F.col(key) if key in cols else F.xxhash64(file, F.col(t), F.col(lab))
    return df.select(k.alias(key), F.col(t).alias("text"), F.col(lab).alias("label"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """A header CSV as ``write_table`` writes it, with an explicit schema."""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
            .option("encoding", "UTF-8").option("nullValue", NULL_CELL).schema(schema).csv(path))


def read_lexicon(spark: SparkSession, path: str | None = None, items=None, strip: str = "right") -> DataFrame:
    """A word list as a one-column frame ``word``: one entry per line,
    stripped of white space (right side, or both for ``strip='both'``), blanks dropped,
    de-duplicated."""
    if path is not None:
        raw = spark.read.text(path).select(F.col("value").alias("word"))
    else:
        raw = spark.createDataFrame([(w,) for w in (items or [])], "word string")
    blank = "[" + CLASS_BODIES["s"] + "]+"
    w = F.regexp_replace("word", blank + "$" if strip == "right" else f"^{blank}|{blank}$", "")
    return raw.select(w.alias("word")).filter(F.col("word") != "").distinct()


def lexicon_values(lexicon: DataFrame, limit: int = 1_000_000) -> list[str]:
    """Collect a lexicon for use as a literal set in expressions.

    A literal set is for lexicons of at most ``limit`` entries; a larger one
    raises here and is joined instead (:func:`drop_listed`).
    """
    rows = lexicon.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lexicon larger than {limit} entries; use drop_listed")
    return sorted(r["word"] for r in rows)


def drop_listed(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``(key, tokens)`` without the tokens listed in ``lexicon`` (``word``), of any size.

    The tokens are exploded with their positions, anti-joined with the lexicon
    and put together again by key; a row left without tokens stays, empty.
    """
    apart = df.select(key, F.posexplode_outer(tokens).alias("_p", "word"))
    listed = lexicon.select("word", F.lit(True).alias("_listed"))
    kept = apart.join(listed, "word", "left").select(
        key, F.when(F.col("_listed").isNull() & F.col("word").isNotNull(), F.struct("_p", "word")).alias("_t"))
    back = kept.groupBy(key).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    return back.select(key, F.transform("_t", lambda t: t["word"]).alias(tokens))
