"""Analyzer expressions for the sparse (TF-IDF) branch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import TFIDF_TOKEN_RE


def tfidf_analyze(text) -> Column:
    """Lower-case the text and keep every run of two or more word characters.

    Equivalent to the usual ``(?u)\\b\\w\\w+\\b`` term pattern; null text gives
    an empty array (the branch fills nulls with "" before analysis).
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TFIDF_TOKEN_RE), 0)
