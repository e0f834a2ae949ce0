"""Benchmark decontamination: size-partitioned MinHash containment search,
verified by exact shingle containment.  DataFrame functions only.

An item *leaks* into a document that holds at least ``containment`` (0.8) of
the item's distinct five-word shingles.  Documents are long, items short, so a
signature of the document says little; the sketch is taken of the item alone.
Items are partitioned by size, [2^c, 2^(c+1)) shingles.  In a partition every
item keeps its ``s`` smallest shingles (in the order of their hashes), where ``s`` is set by the partition's largest size u:
s = u - ceil(0.8 u) + ``hits``.  A document with 0.8 of an item can miss at
most q - ceil(0.8 q) of its shingles, hence holds at least
s - (q - ceil(0.8 q)) >= ``hits`` of the sketch: the search misses nothing.
Candidates are then verified on the words themselves.

Documents are exploded into shingle hashes and joined with the sketches (hash
join against a broadcast of the sketches where their checked number allows it,
otherwise Spark's shuffle join with skew splitting); only hits are shuffled.

Words are runs of non-blanks, lower-cased.  An item of fewer than five words
has one shingle, all its words, and is looked for among shingles of that
length.  Defined results: null or empty items and texts have no shingles and
no leaks; items with equal shingle sets are one item with the smallest id;
repeated document rows give one result row per key and item; null keys are
kept (as one key); extra columns are not read by ``find_leaks`` and pass through
``drop_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import if_small, read_table, shared_table

SHINGLE = 5
CONTAINMENT_PERCENT = 80
#: Sketch hits that every true pair is sure to have, and the sketch rows that may be broadcast.
HITS = 2
MAX_BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def windows(w: Column, size: int) -> Column:
    """Runs of ``size`` words of the word array ``w`` (none where it is shorter)."""
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(w, i, F.lit(size)))


def need(q: Column) -> Column:
    """Shingles of an item of ``q`` that a document must hold."""
    return F.ceil(q * CONTAINMENT_PERCENT / 100).cast("long")


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, size (shingle length), grams (distinct shingles as strings), q; one row per distinct set."""
    cut = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    cut = cut.withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1),
                       lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))
    cut = cut.select("item_id", "size", F.array_sort(F.array_distinct(runs)).alias("grams"))
    return cut.groupBy("size", "grams").agg(F.min("item_id").alias("item_id")).withColumn("q", F.size("grams").cast("long"))


def sketches(grams: DataFrame, hits: int) -> DataFrame:
    """item_id, hash, least (sketch hits that a true pair has) of the items' bottom sketches."""
    top = F.pow(F.lit(2), F.floor(F.log2("q")) + 1).cast("long") - 1  # the largest size of the partition
    sized = grams.withColumn("s", F.least(F.col("q"), top - need(top) + hits))
    sized = sized.withColumn("least", F.col("s") - (F.col("q") - need(F.col("q"))))
    rows = sized.select("item_id", "s", "least", F.explode(F.transform(
        "grams", lambda g: F.xxhash64(F.split(g, " ")))).alias("hash"))
    ranked = rows.groupBy("item_id", "s", "least").agg(F.array_sort(F.collect_list("hash")).alias("order"))
    return ranked.select("item_id", "least", F.explode(F.slice("order", F.lit(1), F.col("s").cast("int"))).alias("hash"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", hits: int = HITS) -> DataFrame:
    """``doc_key``, text_key, item_id, n_item, n_shared of every leak.

    ``text_key`` is the MD5 of the text, so that rows with one key but several
    texts are told apart.
    """
    grams = shared_table(item_shingles(items, item_id, item_text), "items")
    keys = shared_table(sketches(grams, hits), "sketches")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE values
    small = keys.count() <= MAX_BROADCAST_ROWS

    rows = docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    split = rows.select("doc_key", words(F.col("text")).alias("w"))
    hashes = F.concat(*[F.transform(windows(F.col("w"), k), lambda g: F.xxhash64(g)) for k in sizes])
    probes = split.select("doc_key", F.explode(hashes).alias("hash"))
    candidates = (probes.join(F.broadcast(keys) if small else keys, "hash")
                  .groupBy("doc_key", "item_id", "least").agg(F.count_distinct("hash").alias("n"))
                  .filter("n >= least").select("doc_key", "item_id"))
    candidates = shared_table(candidates, "candidates")

    # Verification on the words of the candidates' documents.
    there = rows.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    hit = shared_table(candidates.select(F.col("doc_key").alias("hit_key")).distinct(), "hits")
    texts = there.join(if_small(hit), F.col("doc_key").eqNullSafe(F.col("hit_key")), "left_semi") \
        .select("doc_key", "text_key", words(F.col("text")).alias("w"))
    said = F.concat(*[F.transform(windows(F.col("w"), k), lambda g: F.array_join(g, " ")) for k in sizes])
    spoken = texts.select("doc_key", "text_key", F.explode(F.array_distinct(said)).alias("gram"))
    asked = candidates.join(grams.select("item_id", "q", F.explode("grams").alias("gram")), "item_id") \
        .select(F.col("doc_key").alias("hit_key"), "item_id", "q", F.col("gram").alias("hit_gram"))
    shared = spoken.join(asked, F.col("doc_key").eqNullSafe(F.col("hit_key")) & (F.col("gram") == F.col("hit_gram")))
    return (shared.groupBy("doc_key", "text_key", "item_id", "q")
            .agg(F.count_distinct("gram").alias("n_shared"))
            .filter(F.col("n_shared") >= need(F.col("q")))
            .select("doc_key", "text_key", "item_id", F.col("q").alias("n_item"), "n_shared"))


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    leaks = if_small(shared_table(find_leaks(docs, items, id_col, text_col).select("doc_key", "text_key").distinct(), "leaks"))
    same = docs[id_col].eqNullSafe(leaks["doc_key"]) & (
        F.md5(F.coalesce(docs[text_col], F.lit(""))) == leaks["text_key"])
    return docs.join(leaks, same, "left_anti")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return leaks.groupBy(F.col("doc_key").alias("doc_id"), "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def _cut(table: str, key: str) -> str:
    return (f"SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), "
            f"lambda w: w <> '') AS w FROM {table}")


SQL = f"""
WITH d AS ({_cut('documents', 'doc_id')}), i AS ({_cut('benchmark', 'item_id')}),
sized AS (SELECT item_id, w, least(len(w), {SHINGLE}) AS size FROM i WHERE len(w) > 0),
said AS (SELECT item_id, size, list_sort(list_distinct(list_transform(range(1, len(w) - size + 2),
                lambda x: array_to_string(w[x:x + size - 1], ' ')))) AS grams FROM sized),
items AS (SELECT min(item_id) AS item_id, size, grams, len(grams) AS q FROM said GROUP BY size, grams),
asked AS (SELECT item_id, q, size, unnest(grams) AS gram FROM items),
sizes AS (SELECT DISTINCT size FROM asked),
spoken AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - size + 2),
                  lambda x: array_to_string(w[x:x + size - 1], ' ')))) AS gram FROM d, sizes WHERE len(w) >= size)
SELECT doc_id, item_id, q AS n_item, count(*) AS n_shared
FROM spoken JOIN asked USING (gram) GROUP BY doc_id, item_id, q
HAVING 100 * count(*) >= {CONTAINMENT_PERCENT} * q
"""

QUERIES = {"op8_benchmark_leaks": op8_benchmark_leaks}
ORACLE_SQL = {"op8_benchmark_leaks": SQL}
