"""Catalogue entries: TF-IDF, encoding, stacking, batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import tfidf_analyze
from ..functions.fixed_values import TFIDF_MAX_FEATURES, TFIDF_TOKEN_RE
from ..functions.mathx import quantize
from ..operators import batching, encode, heavy_hitters, splits, stack, vocab
from . import fixtures as fx
from .registry import register
from .sqlfrag import q6, split_case

K = TFIDF_MAX_FEATURES
TEXT_SPLIT = split_case("coalesce(text, '')")
TOK = f"regexp_extract_all(lower(coalesce(text, '')), '{TFIDF_TOKEN_RE}')"


#: Bytes of the documents' files per task where a task counts (document, term) pairs.
COUNT_BYTES = 16 << 20


def analyzed_documents(spark, sf_dir, task_bytes=None):
    """documents -> fill null text -> ``(doc_id, tokens)``."""
    return fx.documents(spark, sf_dir, task_bytes).select("doc_id", tfidf_analyze("text").alias("tokens"))


def split_by_text(df):
    """The split of a message goes by its text, so that copies share one and no test text was learned from."""
    return splits.label_split(df, key=F.coalesce("text", F.lit("")))


def train_model(spark, sf_dir, k=K):
    """Vocabulary + idf fitted on the train split of ``documents`` (fitted
    once per session and input, then read back like a saved vectorizer)."""
    def fit():
        docs = split_by_text(fx.documents(spark, sf_dir).select("doc_id", "text"))
        train = docs.filter(F.col("split") == "train").select(tfidf_analyze("text").alias("tokens"))
        return vocab.fit_tfidf(train, "tokens", k)
    from . import artifacts
    return artifacts.table(spark, "tfidf", sf_dir, {"k": k, "split": "train"}, fit)


@register("tfidf_analyze", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {TOK} AS t FROM documents)""")
def q_tfidf_analyze(spark, sf_dir):
    d = analyzed_documents(spark, sf_dir)
    return d.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


_VOCAB_CTE = f"""
toks AS (SELECT doc_id, unnest({TOK}) AS term FROM documents),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM toks GROUP BY term),
top AS (SELECT term, tf, df FROM stats ORDER BY tf DESC, term LIMIT {K})"""


SQL_VOCAB = f"""
WITH {_VOCAB_CTE}
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, tf, df FROM top"""


@register("vocab_fit", SQL_VOCAB)
def q_vocab_fit(spark, sf_dir):
    return vocab.vocab_fit(analyzed_documents(spark, sf_dir), "tokens", K)


@register("vocab_fit_bounded", SQL_VOCAB)
def q_vocab_fit_bounded(spark, sf_dir):
    """The same vocabulary from a summary of heavy hitters and an exact count of its candidates."""
    return heavy_hitters.vocab_fit_bounded(analyzed_documents(spark, sf_dir), "tokens", K)


@register("idf_fit", f"""
WITH {_VOCAB_CTE}
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df,
       {q6("ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0")} AS idf
FROM top""")
def q_idf_fit(spark, sf_dir):
    m = vocab.fit_tfidf(analyzed_documents(spark, sf_dir), "tokens", K)
    return m.select("term", "idx", "df", quantize("idf").alias("idf"))


_TFIDF_CTE = f"""
docs AS (SELECT doc_id, text, {TEXT_SPLIT} AS split FROM documents),
ttoks AS (SELECT doc_id, unnest({TOK}) AS term FROM docs WHERE split = 'train'),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ttoks GROUP BY term),
top AS (SELECT term, tf, df FROM stats ORDER BY tf DESC, term LIMIT {K}),
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
               ln((1.0 + (SELECT count(*) FROM docs WHERE split = 'train')) / (1.0 + df)) + 1.0 AS idf
        FROM top),
atoks AS (SELECT doc_id, unnest({TOK}) AS term FROM docs),
cnt AS (SELECT doc_id, term, count(*) AS c FROM atoks GROUP BY doc_id, term),
w AS (SELECT cnt.doc_id, voc.idx, cnt.c * voc.idf AS w FROM cnt JOIN voc ON cnt.term = voc.term),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)"""


@register("tfidf_transform", f"""
WITH {_TFIDF_CTE}
SELECT d.doc_id, w.idx, {q6("w.w / nrm.nrm")} AS weight
FROM docs d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN nrm ON w.doc_id = nrm.doc_id""")
def q_tfidf_transform(spark, sf_dir):
    model = train_model(spark, sf_dir)
    out = vocab.tfidf_long(analyzed_documents(spark, sf_dir, COUNT_BYTES), model, "doc_id", "tokens", K)
    return out.select("doc_id", "idx", quantize("weight").alias("weight"))


@register("stack_features", f"""
WITH {_TFIDF_CTE},
sparse AS (SELECT w.doc_id, w.idx, w.w / nrm.nrm AS value FROM w JOIN nrm ON w.doc_id = nrm.doc_id),
dense AS (SELECT e.vec_id AS doc_id, CAST((SELECT count(*) FROM voc) + u.j - 1 AS INTEGER) AS idx, CAST(u.v AS DOUBLE) AS value
          FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(v, j))
SELECT s.doc_id, s.idx, {q6("s.value")} AS value FROM sparse s
UNION ALL
SELECT x.doc_id, x.idx, {q6("x.value")} AS value FROM dense x JOIN docs d ON x.doc_id = d.doc_id""")
def q_stack_features(spark, sf_dir):
    model = train_model(spark, sf_dir)
    ent = vocab.tfidf_entries(analyzed_documents(spark, sf_dir, COUNT_BYTES), model, "doc_id", "tokens", K)
    emb = fx.embeddings(spark, sf_dir)
    out = stack.stack_long(ent, emb, vocab.n_rows(model).cast("int"))
    return out.select("doc_id", "idx", quantize("value").alias("value"))


@register("encode_ids", f"""
WITH {_VOCAB_CTE},
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top),
lab AS (SELECT doc_id, {TOK} AS t FROM documents),
num AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM lab),
pos AS (SELECT n.doc_id, n.rn, u.term, u.p FROM num n, unnest(n.t[1:256]) WITH ORDINALITY AS u(term, p)),
ids AS (SELECT pos.doc_id, pos.p, coalesce(voc.idx + 2, 1) AS id FROM pos LEFT JOIN voc ON pos.term = voc.term),
lists AS (SELECT doc_id, list(id ORDER BY p) AS id_list FROM ids GROUP BY doc_id),
enc AS (SELECT n.doc_id, CAST(n.rn // 32 AS BIGINT) AS batch_id, CAST(least(len(n.t), 256) AS INTEGER) AS n_ids,
               coalesce(l.id_list, []) AS id_list
        FROM num n LEFT JOIN lists l ON n.doc_id = l.doc_id),
padded AS (SELECT *, max(n_ids) OVER (PARTITION BY batch_id) AS width FROM enc)
SELECT doc_id, batch_id, n_ids, CAST(width AS INTEGER) AS width,
       array_to_string(list_concat(id_list, list_transform(range(width - n_ids), lambda x: 0)), ' ') AS input_ids,
       array_to_string(list_concat(list_transform(range(n_ids), lambda x: 1), list_transform(range(width - n_ids), lambda x: 0)), ' ') AS attention_mask
FROM padded""")
def q_encode_ids(spark, sf_dir):
    from . import artifacts
    model = artifacts.table(spark, "vocab", sf_dir, {"k": K, "split": "all"},
                            lambda: vocab.vocab_fit(analyzed_documents(spark, sf_dir), "tokens", K))
    docs = analyzed_documents(spark, sf_dir)
    out = encode.encode_ids(docs, model, key="doc_id", tokens="tokens", max_len=256,
                            batch_size=32, k=K)
    return out.select("doc_id", "batch_id", "n_ids", "width",
                      F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"))


@register("shuffle_rows", """
SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '7'), doc_id) AS position
FROM documents""")
def q_shuffle_rows(spark, sf_dir):
    d = fx.documents(spark, sf_dir).select("doc_id")
    return batching.shuffled_positions(d, "doc_id", seed=7)


@register("assign_batches", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS row_number,
       (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id
FROM documents""")
def q_assign_batches(spark, sf_dir):
    d = fx.documents(spark, sf_dir).select("doc_id")
    return batching.assign_batches(d, ["doc_id"], 32, key="doc_id")


SQL_RUNNING_LOSS = f"""
WITH s AS (
  SELECT user_id, event_id, value,
         row_number() OVER w AS step,
         sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_sum,
         avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS trailing_mean
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, step, {q6("running_sum")} AS running_sum, {q6("trailing_mean")} AS trailing_mean,
       {q6("running_sum / 10.0")} AS reported_loss, step % 10 = 0 AS reported
FROM s"""


@register("running_loss", SQL_RUNNING_LOSS)
def q_running_loss(spark, sf_dir):
    ev = fx.events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    out = batching.running_loss(ev, part="user_id", order=["ts", "event_id"], value="value", every=10)
    return out.select("user_id", "event_id", "step", quantize("running_sum").alias("running_sum"),
                      quantize("trailing_mean").alias("trailing_mean"),
                      quantize("reported_loss").alias("reported_loss"), "reported")


@register("encode_ids_dataset", f"""
WITH {_VOCAB_CTE},
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top),
d AS (SELECT doc_id, {TOK} AS t FROM documents),
wide AS (SELECT CAST(max(least(len(t), 512)) AS INTEGER) AS width FROM d),
pos AS (SELECT d.doc_id, u.term, u.p FROM d, unnest(d.t[1:512]) WITH ORDINALITY AS u(term, p)),
ids AS (SELECT pos.doc_id, list(coalesce(voc.idx + 2, 1) ORDER BY pos.p) AS ids
        FROM pos LEFT JOIN voc ON pos.term = voc.term GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(least(len(d.t), 512) AS INTEGER) AS n_ids, width,
       array_to_string(list_concat(coalesce(ids, []), list_transform(range(width - least(len(d.t), 512)), lambda x: 0)), ' ') AS input_ids
FROM d LEFT JOIN ids ON d.doc_id = ids.doc_id, wide""")
def q_encode_ids_dataset(spark, sf_dir):
    """All rows padded to one width, the longest of the data set (512 at most)."""
    from . import artifacts
    model = artifacts.table(spark, "vocab", sf_dir, {"k": K, "split": "all"},
                            lambda: vocab.vocab_fit(analyzed_documents(spark, sf_dir), "tokens", K))
    out = encode.encode_ids(analyzed_documents(spark, sf_dir), model, max_len=512, k=K, pad_to="dataset")
    return out.select("doc_id", "n_ids", "width", F.array_join("input_ids", " ").alias("input_ids"))
