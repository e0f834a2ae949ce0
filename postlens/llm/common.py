"""Helpers shared by the operators: scratch tables, Arrow batches, word hashes.

Word conventions (all operators of this subpackage unless they say otherwise):
words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text; since
every separator is ASCII, working on bytes equals working on characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir, read_table

__all__ = ["read_table", "shared_table", "shuffles_removed", "settings", "free_name", "if_small", "slices", "WordBatch", "shingle_hashes", "mix64"]

#: Text bytes that one numpy step holds at a time (bounds a task's memory; a
#: longer text forms a step of its own).
STEP_BYTES = 4 << 20


#: Removes the shuffle files of a query when it ends; bounds the bytes of an Arrow batch.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the queries run inside."""
    names = {"cleanup": CLEANUP, "batch_bytes": BATCH_BYTES}
    before = {names[k]: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for name, v in before.items():
            spark.conf.unset(name) if v is None else spark.conf.set(name, v)


def shuffles_removed(spark: SparkSession):
    """Queries run inside leave no shuffle files behind: what they made is written, so nothing
    reads these files again, and long jobs do not pile them up on the executors' disks."""
    return settings(spark, cleanup="true")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with a table that survives the loss of any executor.  The
    folder is the one that ``spark.checkpoint.dir`` names.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken) -> str:
    """``name`` with as many underscores after it as keep it apart from the names ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Rows of keys that may be broadcast (8 MB of 64-bit keys).
MAX_BROADCAST_KEYS = 1 << 20


def if_small(keys: DataFrame, rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, marked for broadcast where it has at most
    ``rows`` rows; beyond, the planner joins by shuffle."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds at most ``max_bytes``
    bytes (at least one row each)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, done = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (fixed constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordBatch:
    """Words of a run of texts as flat arrays.

    ``ids`` number the distinct words of the run, ``hashes`` are 64-bit hashes
    of the words, ``starts``/``ends`` delimit each text's words.  A null text
    has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        kept = np.concatenate(([0], np.cumsum(full)))[offsets]
        self.words = flat.filter(pa.array(full)) if not full.all() else flat
        coded = self.words.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        self.starts, self.ends = kept[:-1], kept[1:]
        self.counts = self.ends - self.starts

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, hashed once per distinct word."""
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.distinct.cast(pa.binary()).to_pylist()),
                            dtype=np.uint64, count=len(self.distinct))
        return table[self.ids] if len(table) else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size``-word shingles of one text, by position.

    Fewer than ``size`` words make one shingle of the whole sequence; no words
    make none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(size, n)
    out = np.full(n - take + 1, np.uint64(take), np.uint64)
    for i in range(take):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i:n - take + 1 + i])
    return out
