"""Projection, null policy and label hygiene (all narrow, pushdown-friendly)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import MISSING_LABEL


def _name(df: DataFrame, c: str | int) -> str:
    return df.columns[c] if isinstance(c, int) else c


def project_text_label(df: DataFrame, text: str | int = "text", label: str | int = "label",
                       key: str | None = "doc_id") -> DataFrame:
    """Pick the text and label columns by name or position, renamed to
    ``text``/``label``; the key (if any) is carried along."""
    cols = [F.col(_name(df, text)).alias("text"), F.col(_name(df, label)).alias("label")]
    if key is not None:
        cols.insert(0, F.col(key))
    return df.select(*cols)


def drop_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop rows whose text is null (a typed schema makes 'not a string' moot)."""
    return df.filter(F.col(text).isNotNull())


def fill_null_text(df: DataFrame, value: str = "", text: str = "text") -> DataFrame:
    """Null text -> ``value`` ("" for the sparse branch, "default_value" for dense scoring)."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit(value)))


def skip_empty_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Skip rows whose text is null or empty."""
    return df.filter(F.col(text).isNotNull() & (F.col(text) != F.lit("")))


def default_label(df: DataFrame, label: str = "label", default: int = MISSING_LABEL) -> DataFrame:
    """Missing (null or empty) label -> ``default`` (2); result is INT.

    A label text may be an integer or a float of an integer (``1.0``); any
    other text is no label, and reading it raises."""
    c = F.col(label)
    if dict(df.dtypes)[label] != "string":
        return df.withColumn(label, F.coalesce(c.cast("int"), F.lit(default)))
    number = c.try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not a label: "), c)).cast("int")
    return df.withColumn(label, F.when(c.isNull() | (c == ""), F.lit(default))
                         .when(number == F.floor(number), number.cast("int")).otherwise(bad))


def cast_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels to INT."""
    return df.withColumn(label, F.col(label).cast("int"))


def num_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of distinct labels (sets the arity of a classifier): one row."""
    return df.agg(F.countDistinct(label).alias("num_labels"))
