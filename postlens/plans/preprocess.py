"""Preprocessing job: labelled messages -> tokenized, filtered text.

read -> skip empty text -> default label (2) -> tokenize -> bilingual
stop-word / punctuation filter -> join with blanks -> write.  One narrow
stage; a few large files are dealt out at the source (``joins.spread``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filter_bilingual
from ..functions.tokenizer import DEFAULT, TokenizerConfig, tokenize
from ..operators.cleaning import default_label, skip_empty_rows


def preprocess(df: DataFrame, cfg: TokenizerConfig = DEFAULT, key: str = "doc_id", text: str = "text",
               label: str = "label", tagalog=None, english=None) -> DataFrame:
    """``(key, text, label)`` -> ``(key, text, label)`` with processed text."""
    df = default_label(skip_empty_rows(df, text), label)
    toks = filter_bilingual(tokenize(text, cfg), tagalog, english)
    return df.select(key, F.array_join(toks, " ").alias("text"), F.col(label).alias("label"))
