"""Catalogue entries: preprocessing job, readers and writers.

Writers are exercised as round trips through the shared checkpoint folder:
write with the sink, read back with the reader, return what was read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..functions.mathx import quantize
from ..sources.readers import read_csv, read_labeled
from ..sources.sinks import append_run, committed_runs, scratch_path, write_meta_features, write_table
from . import fixtures as fx
from .preprocess import preprocess
from .registry import register


def _sql_preprocessed() -> str:
    from ..functions import fixed_values as fv
    from . import tokenizer_sql as tsql
    stop = ", ".join(tsql.lit(w) for w in sorted(set(fv.STOPWORDS_TL) | set(fv.STOPWORDS_EN)))
    return f"""
WITH RECURSIVE {tsql.tokens("(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL AND text <> '')")},
kept AS (SELECT id, list_filter(toks, lambda t: NOT list_contains([{stop}], lower(t))
                                AND strpos({tsql.lit(fv.ASCII_PUNCTUATION)}, t) = 0) AS toks FROM tokens)
SELECT id AS doc_id, coalesce(array_to_string(toks, ' '), '') AS text, CAST(coalesce(l.toxic, 2) AS INTEGER) AS label
FROM kept LEFT JOIN labels l ON l.doc_id = kept.id"""


@register("preprocess_job", _sql_preprocessed())
def q_preprocess_job(spark, sf_dir):
    return preprocess(fx.messages(spark, sf_dir))


@register("write_preprocessed", f"SELECT text, CAST(label AS VARCHAR) AS label FROM ({_sql_preprocessed()})")
def q_write_preprocessed(spark, sf_dir):
    """The job's append, run twice under one run id: the rows are there once.  The texts are tokenized
    once, into a scratch table that both runs write from."""
    rows = scratch_path(spark, "preprocessed-rows")
    preprocess(fx.messages(spark, sf_dir)).select("text", "label").write.parquet(rows)
    out = spark.read.parquet(rows)
    path = scratch_path(spark, "preprocessed")
    for _ in range(2):
        append_run(out, path, "first")
    return read_labeled(spark, committed_runs(spark, path), "csv").select("text", "label")


@register("read_labeled", f"""
SELECT d.text, CAST(coalesce(l.toxic, 2) AS VARCHAR) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_read_labeled(spark, sf_dir):
    """Messages written as a header CSV with quoted multi-line cells, read back."""
    m = fx.messages(spark, sf_dir).select("text", F.coalesce("label", F.lit(2)).cast("string").alias("label"))
    path = scratch_path(spark, "labeled")
    write_table(m, path, "csv", mode="overwrite")
    return read_labeled(spark, path, "csv").select("text", "label")


@register("read_labeled_columns", f"""
SELECT d.text, CAST(coalesce(l.toxic, 2) AS VARCHAR) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_read_labeled_columns(spark, sf_dir):
    """Files, one per task, whose header has the label first and columns beside: picked by name."""
    m = fx.messages(spark, sf_dir).select(F.coalesce("label", F.lit(2)).cast("string").alias("label"), F.col("doc_id").alias("source id"),
                                          "text", F.lit("a,\nb").alias("note"))
    path = scratch_path(spark, "columns")
    write_table(m, path, "csv", mode="overwrite")
    return read_labeled(spark, path, "csv").select("text", "label")


@register("write_predictions", f"""
SELECT d.doc_id, d.text, t.label AS True_Labels, p.prediction AS Model_Predictions, t.label = p.prediction AS Match
FROM {fx.SQL_TRUTH} t JOIN {fx.SQL_PRED_A} p ON t.doc_id = p.doc_id JOIN documents d ON d.doc_id = t.doc_id""")
def q_write_predictions(spark, sf_dir):
    """The input columns and the three result columns as CSV, read back."""
    r = metrics.result_table(fx.truth(spark, sf_dir), fx.predictor_a(spark, sf_dir))
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    out = docs.join(r, "doc_id").select("doc_id", "text", F.col("label").alias("True_Labels"),
                                        F.col("prediction").alias("Model_Predictions"), F.col("match").alias("Match"))
    path = scratch_path(spark, "predictions")
    write_table(out, path, "csv", mode="overwrite")
    return read_csv(spark, path, out.schema)


#: Cells that a trimming or quoting writer would change: id, text.
ODD_CELLS = [(1, "  lead"), (2, "trail  "), (3, " "), (4, ""), (5, None), (6, 'a "quoted", cell'), (7, "two\nlines"), (8, "back\\slash"),
             (9, "\ttab\t"), (10, "1.0")]


@register("write_cells", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, " + ("NULL" if t is None else "'" + t.replace("'", "''") + "'") + ")" for i, t in ODD_CELLS)
    + """) AS v(id, text) UNION ALL SELECT doc_id + 100, text FROM documents""")
def q_write_cells(spark, sf_dir):
    """Blanks, empty and null cells, quotes and line ends survive the CSV round trip."""
    odd = spark.createDataFrame(ODD_CELLS, "id long, text string")
    cells = odd.unionByName(fx.documents(spark, sf_dir).select((F.col("doc_id") + 100).alias("id"), "text"))
    path = scratch_path(spark, "cells")
    write_table(cells, path, "csv", mode="overwrite")
    return read_csv(spark, path, cells.schema)


def _sql_stacked():
    from .feature_queries import _TFIDF_CTE, q6
    return f"""
WITH {_TFIDF_CTE},
lab AS (SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT e.vec_id AS doc_id, CAST((SELECT count(*) FROM voc) + u.j - 1 AS INTEGER) AS idx, CAST(u.v AS DOUBLE) AS value
          FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(v, j) WHERE u.v <> 0)
SELECT w.doc_id, w.idx, {q6("w.w / nrm.nrm")} AS value FROM w JOIN nrm ON w.doc_id = nrm.doc_id JOIN lab ON lab.doc_id = w.doc_id
UNION ALL SELECT x.doc_id, x.idx, {q6("x.value")} AS value FROM dense x JOIN lab ON lab.doc_id = x.doc_id"""


@register("write_meta_features", _sql_stacked())
def q_write_meta_features(spark, sf_dir):
    """The stacked matrix of the labelled messages, written and read back:
    its entries other than zero."""
    from ..operators.vocab import sparse_entries
    from .model_queries import _stacked
    path = scratch_path(spark, "meta")
    write_meta_features(_stacked(spark, sf_dir), path, "meta_features", "doc_id", "parquet")
    back = spark.read.parquet(path).select("doc_id", F.explode(sparse_entries("meta_features")).alias("e")).filter("e.weight <> 0")
    return back.select("doc_id", F.col("e.idx").cast("int").alias("idx"), quantize("e.weight").alias("value"))


@register("read_lexicon", """
WITH toks AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
top AS (SELECT term, count(*) AS tf FROM toks GROUP BY term ORDER BY tf DESC, term LIMIT 11024)
SELECT term AS word FROM top""")
def q_read_lexicon(spark, sf_dir):
    """A lexicon file (one entry per line, with trailing blanks, blank lines
    and duplicates) built from the fitted vocabulary, read back."""
    from ..functions.features import tfidf_analyze
    from ..operators.vocab import vocab_fit
    from ..sources.readers import read_lexicon
    top = vocab_fit(fx.documents(spark, sf_dir).select(tfidf_analyze("text").alias("tokens")), "tokens", 11024)
    lines = top.select(F.explode(F.array(F.concat("term", F.lit("  ")), F.col("term"), F.lit(""))).alias("value"))
    path = scratch_path(spark, "lexicon")
    lines.write.mode("overwrite").text(path)
    return read_lexicon(spark, path)
