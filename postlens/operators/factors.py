"""Word and document vectors from a distributed co-occurrence factorisation.

Terms that occur within ``window`` places of each other in a text are counted,
the counts become positive pointwise mutual information (PPMI), and block power
iteration finds the ``dim`` leading eigenvectors of that symmetric matrix.  The
matrix is a table keyed by (term, other) and the block a table keyed by term, so
neither the vocabulary nor its vectors visit the driver: what does is one
``dim x dim`` matrix per iteration, whatever the corpus.

Plan shape: counting is one shuffle by the pair, in one order only, after a per-task sum; an
iteration is one join on the column's term (a frequent term's rows are split by
AQE, which copies its single block row) and one aggregation by the row's term
with map-side combine.  Blocks are written to the shared scratch folder; each write takes its
query's shuffle files away with it, and the table that it replaces.

Null tokens are no terms; a text of one token gives no pair; a text none of
whose tokens has a vector gets zeros.  An empty table has no pairs and no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .joins import bounded_broadcast

#: Places of a text that are paired at once; bounds a step's memory, not the text.
STEP = 1 << 16
#: Sums of pairs that a task holds.
HELD = 1 << 19
#: Terms whose sums may be broadcast (a string and a long each: about 30 MB).
MAX_BROADCAST_SUMS = 500_000
#: Terms whose vectors may be broadcast (64 doubles each: about 50 MB).
MAX_BROADCAST_TERMS = 100_000
#: Share of the largest eigenvalue below which a direction of the block counts as lost.
LOST = 1e-12


#: What holds while a table is written: the query's shuffle files go when it ends, and Arrow batches have 4 MB.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
            "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` for the queries run inside."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` from a table in the shared scratch folder, without its shuffle files.  ``instead_of``: a
    frame over a table written before that nothing reads after this one; it is removed."""
    spark = df.sparkSession
    path = scratch_path(spark, "factors")
    with settings(spark):
        df.write.parquet(path)
    if instead_of is not None:
        remove(instead_of)
    return spark.read.parquet(path)


def remove(table: DataFrame) -> None:
    """Takes away the folders of the scratch tables that ``table`` reads."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def pair_counter(window: int, halves: bool = False):
    """The ``mapInArrow`` function that counts each task's pairs, in both orders or, as ``halves``, once with the
    lesser term first.  It holds at most ``HELD`` sums and the terms they name."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def add_up() -> None:
            nonlocal size
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            held.append((key[first], np.add.reduceat(n[order], first)))
            size = len(first)

        def told() -> Iterator[pa.RecordBatch]:
            terms = pa.array(list(names), pa.string())
            (key, n), = held
            rank = np.empty(len(terms), np.int64)
            rank[pc.array_sort_indices(terms).to_numpy()] = np.arange(len(terms))
            a, b = key >> 32, key & 0xFFFFFFFF
            a, b = np.where(rank[a] <= rank[b], (a, b), (b, a))
            if not halves:
                apart = a != b
                a, b, n = np.append(a, b[apart]), np.append(b, a[apart]), np.append(n, n[apart])
            for at in range(0, len(n), STEP):
                part = slice(at, at + STEP)
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(a[part])), terms.take(pa.array(b[part])), pa.array(n[part], pa.int64())],
                                                 names=["term", "other", "n"])

        for batch in batches:
            lists = batch.column(0)
            texts = pc.list_parent_indices(lists)
            tokens = pc.list_flatten(lists)
            known = tokens.is_valid()
            texts = texts.filter(known).to_numpy(zero_copy_only=False)
            coded = tokens.filter(known).dictionary_encode()
            number = np.array([names.setdefault(t, len(names)) for t in coded.dictionary.to_pylist()], np.int64)
            codes = number[coded.indices.to_numpy(zero_copy_only=False)]
            for at in range(0, len(codes), STEP):
                keys = []
                for d in range(1, window + 1):
                    left = slice(at, min(at + STEP, len(codes) - d))
                    if left.stop <= left.start:
                        break
                    right = slice(left.start + d, left.stop + d)
                    same = texts[left] == texts[right]
                    a, b = codes[left][same], codes[right][same]
                    keys.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                if keys:
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    held.append((key, np.where(key >> 32 == key & 0xFFFFFFFF, 2 * n, n)))  # next to itself: twice
                    size += len(key)
                if size > HELD or size and len(names) > HELD:
                    add_up()
                    if size > HELD // 2 or len(names) > HELD:
                        yield from told()
                        held.clear()
                        size = 0
            if not held:  # else the sums held, or the rest of this batch, refer to them
                names.clear()
        if held:
            add_up()
            yield from told()
    return count


def half_cooccurrences(df: DataFrame, tokens: str = "tokens", window: int = 5) -> DataFrame:
    """The rows of :func:`cooccurrences` whose term is not after the other."""
    return (df.select(tokens).mapInArrow(pair_counter(window, halves=True), "term string, other string, n long")
            .groupBy("term", "other").agg(F.sum("n").alias("n")))


def mirrored(halves: DataFrame, value: str) -> DataFrame:
    """A symmetric table in both orders, from its rows in one."""
    one = F.struct("term", "other", value)
    two = F.struct(F.col("other").alias("term"), F.col("term").alias("other"), value)
    return halves.select(F.inline(F.when(F.col("term") == F.col("other"), F.array(one)).otherwise(F.array(one, two))))


def cooccurrences(df: DataFrame, tokens: str = "tokens", window: int = 5) -> DataFrame:
    """``(term, other, n)``: how often two terms stand at most ``window`` places apart in one row,
    in either order.  Symmetric; a term next to itself counts twice."""
    return mirrored(half_cooccurrences(df, tokens, window), "n")


def ppmi(pairs: DataFrame, halves: bool = False) -> DataFrame:
    """``(term, other, value)`` of the pairs that co-occur more often than chance has it.

    ``pairs`` is symmetric or, with ``halves``, its rows in one order, as the
    result then is.  It is read twice; write it before.  The terms' sums are
    broadcast while they are few.
    """
    rows = written((mirrored(pairs, "n") if halves else pairs).groupBy("term").agg(F.sum("n").alias("r")))
    total = rows.agg(F.sum("r").alias("t")).select("t").scalar()
    few = bounded_broadcast(rows, MAX_BROADCAST_SUMS)
    both = pairs.join(few, "term").join(few.select(F.col("term").alias("other"), F.col("r").alias("c")), "other")
    seen = F.col("n").cast("double") * total
    chance = F.col("r").cast("double") * F.col("c")
    return both.filter(seen > chance).select("term", "other", F.log(seen / chance).alias("value"))


def gram(block: DataFrame, left: str, right: str, dim: int) -> np.ndarray:
    """Sum over all rows of the outer products of two vector columns: ``dim * dim`` numbers."""
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dim, dim))
        for batch in batches:
            a, b = (np.asarray(c.flatten(), dtype=float).reshape(-1, dim) for c in batch.columns)
            out += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(out.ravel())], names=["at", "v"])
    sums = block.select(left, right).mapInArrow(outer, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(dim * dim)
    with settings(block.sparkSession):
        for r in sums.collect():
            out[r["at"]] = r["v"]
    return out.reshape(dim, dim)


def turn(block: DataFrame, vector: str, by: np.ndarray) -> DataFrame:
    """``(term, vector)``: every vector times the small matrix ``by``."""
    dim = by.shape[1]

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.asarray(batch.column(1).flatten(), dtype=float).reshape(-1, by.shape[0]) @ by
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["term", "vector"])
    return block.select("term", vector).mapInArrow(times, "term string, vector array<double>")


def summed(weight: Column, vector: str, dim: int) -> Column:
    """Array of the ``dim`` weighted sums of a vector column (an aggregate)."""
    return F.array(*[F.sum(weight * F.col(vector)[i]) for i in range(dim)])


def multiply(matrix: DataFrame, block: DataFrame, dim: int) -> DataFrame:
    """``(term, product)``: the matrix times the block."""
    right = block.select(F.col("term").alias("other"), "vector")
    return matrix.join(right, "other").groupBy("term").agg(summed(F.col("value"), "vector", dim).alias("product"))


def factorize(matrix: DataFrame, dim: int = 64, iterations: int = 6, seed: int = 42) -> DataFrame:
    """``(term, vector array<double>)``: the leading eigenvectors of a symmetric table
    ``(term, other, value)``, each scaled by the root of its eigenvalue's size, ordered by it.

    Starts from hashes of the terms, so a run is repeatable up to the order of sums.
    ``matrix`` is read once per iteration; write it before.  Directions
    beyond the matrix' rank are zeros.
    """
    unit = float(1 << 63)
    start = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64("term", i, F.lit(seed)) / F.lit(unit))
    block = written(matrix.select("term").distinct().withColumn("vector", start))
    for _ in range(iterations):
        image = written(multiply(matrix, orthonormal(block, "vector", dim), dim), instead_of=block)
        block = image.withColumnRenamed("product", "vector")
    basis = written(orthonormal(block, "vector", dim), instead_of=block)
    image = written(multiply(matrix, basis, dim))
    small = gram(basis.join(image, "term"), "vector", "product", dim)
    remove(image)
    sizes, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(sizes), kind="stable")
    return turn(basis, "vector", axes[:, order] * np.sqrt(np.abs(sizes[order])))


def orthonormal(block: DataFrame, vector: str, dim: int) -> DataFrame:
    """``(term, vector)``: an orthonormal basis of the block's columns, zeros for dependent ones."""
    sizes, axes = np.linalg.eigh(gram(block, vector, vector, dim))
    kept = sizes > LOST * max(sizes.max(), 0.0)
    scale = np.where(kept, 1.0 / np.sqrt(np.where(kept, sizes, 1.0)), 0.0)
    return turn(block, vector, axes * scale)


def fit_factors(df: DataFrame, tokens: str = "tokens", dim: int = 64, window: int = 5, iterations: int = 6) -> DataFrame:
    """Word vectors ``(term, vector)`` of all terms of the rows' token lists, ``dim`` numbers each."""
    pairs = written(half_cooccurrences(df, tokens, window))
    matrix = written(mirrored(ppmi(pairs, halves=True), "value"), instead_of=pairs)
    turned = factorize(matrix, dim, iterations)
    remove(matrix)
    return written(turned, instead_of=turned)


def embed_factors(df: DataFrame, vectors: DataFrame, dim: int, key: str = "doc_id", tokens: str = "tokens",
                  output: str = "embedding") -> DataFrame:
    """Mean of the vectors of a row's tokens that have one, per ``key``.

    A row's equal tokens are counted first, so a frequent term reaches the join once per row.
    """
    known = bounded_broadcast(vectors.select(F.col("term").alias("_t"), "vector"), MAX_BROADCAST_TERMS)
    counts = df.select(key, F.explode_outer(tokens).alias("_t")).groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_n"))
    found = F.sum(F.when(F.col("vector").isNotNull(), F.col("_n")))
    sums = counts.join(known, "_t", "left").groupBy(key).agg(
        summed(F.col("_n"), "vector", dim).alias("_sum"), found.alias("_found"))
    mean = F.transform("_sum", lambda x: F.coalesce(x / F.col("_found"), F.lit(0.0)).cast("float"))
    return sums.select(key, mean.alias(output))
