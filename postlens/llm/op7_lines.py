"""Line dedup: sharded cuckoo filters backed by an exact reference-count table.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; keys are identified by their 128-bit hash.  The state is

* ``refs``: exact table (hi, lo, n_docs), how many documents hold the key;
* ``filters``: per shard of the key space one cuckoo filter of 32-bit
  fingerprints that holds exactly the *common* keys, those with at least
  ``min_docs`` documents.

``insert`` and ``delete`` add or subtract a batch of documents in ``refs`` and
insert or delete in the filters only the keys that crossed ``min_docs``, so a
deletion undoes its insertion.  ``strip`` drops the common lines of documents:
every line is looked up in the filters, which are broadcast because their size
is checked first.  A filter has rare false hits; since ``refs`` knows every key
of the corpus, the uncommon keys that hit a filter are found in one pass over
it and broadcast as exceptions, which makes the answer exact for every document
in the index.  Where filters or exceptions exceed ``MAX_BROADCAST_BYTES``, the
lines are joined with the common keys instead (salted by Spark's skew join) and
the drop lists are joined back to the documents.

Documents for ``strip`` and ``delete`` must be in the index.  Defined results:
a null or empty text is one empty line, which has no key and stays; a repeated
row counts as a document of its own; a document counts once for a key however
often it has the line; extra columns pass through ``strip`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, mix64, read_table, shared_table, slices

#: Keys of a filter at most (bounds the task that builds it), and the bytes that may be broadcast.
SHARD_KEYS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
SLOTS, LOAD, MAX_KICKS = 4, 0.85, 500


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; 0 marks a free slot."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint32).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        mark = (hi.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
        mark[mark == 0] = 1
        one = mix64(lo.astype(np.uint64)) & self.mask
        return mark, one, one ^ (mix64(mark.astype(np.uint64)) & self.mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hi, lo)
        return ((self.table[one.astype(np.int64)] == mark[:, None]).any(1)
                | (self.table[two.astype(np.int64)] == mark[:, None]).any(1))

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Add keys; False where one finds no room (rebuild with more buckets)."""
        mark, one, two = self.places(hi, lo)
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            if not self._put(m, a) and not self._put(m, b) and not self._kick(m, b):
                return False
        return True

    def _put(self, mark: int, bucket: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free) == 0:
            return False
        self.table[bucket, free[0]] = mark
        return True

    def _kick(self, mark: int, bucket: int) -> bool:
        for turn in range(MAX_KICKS):
            slot = turn % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= int(mix64(np.array([mark], np.uint64))[0] & self.mask)
            if self._put(mark, bucket):
                return True
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        for m, a, b in zip(*[x.tolist() for x in self.places(hi, lo)], strict=True):
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == m)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


def built(hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
    size = max(1, len(hi))
    while True:
        made = CuckooFilter.sized(size)
        if made.insert(hi, lo):
            return made
        size *= 2


class Lines:
    """Lines of a run of texts: ``ids`` number the distinct lines, ``hi``/``lo``
    hash their keys, ``keyed`` tells which have one."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary
        keys = pc.ascii_lower(pc.ascii_trim_whitespace(coded.dictionary)).cast(pa.binary())
        self.keyed = pc.greater(pc.binary_length(keys), 0).to_numpy(zero_copy_only=False)
        hashes = b"".join(xxhash.xxh3_128_digest(k) for k in keys.to_pylist())
        pairs = np.frombuffer(hashes, ">i8").astype(np.int64).reshape(-1, 2)
        self.hi, self.lo = pairs[:, 0], pairs[:, 1]
        self.starts, self.ends = offsets[:-1], offsets[1:]
        self.owner = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)


def doc_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) pairs: document, hi, lo."""
    own, at = lines.owner[lines.keyed[lines.ids]], lines.ids[lines.keyed[lines.ids]]
    # two spellings of a line may share a key: number the keys
    _, key = np.unique(np.stack([lines.hi, lines.lo]), axis=1, return_inverse=True) if len(lines.hi) else (None, np.zeros(0, np.int64))
    key = key.reshape(-1)
    both, first = np.unique(own * max(1, len(lines.hi)) + key[at], return_index=True)
    return both // max(1, len(lines.hi)), lines.hi[at[first]], lines.lo[at[first]]


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, n): in how many documents of each run a key occurs."""
    for batch in batches:
        for part in slices(batch, "text"):
            _, hi, lo = doc_keys(Lines(part.column("text")))
            keys, n = np.unique(np.stack([hi, lo]), axis=1, return_counts=True) if len(hi) else (np.zeros((2, 0), np.int64), hi)
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n)], names=["hi", "lo", "n"])


def key_counts(docs: DataFrame, text_col: str) -> DataFrame:
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count_keys, "hi long, lo long, n long")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def shard_column(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")


@dataclass
class LineIndex:
    """The state; every change gives a new index over new tables."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    text_col: str = "text"

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10, text_col: str = "text") -> LineIndex:
        refs = shared_table(key_counts(docs, text_col).withColumnRenamed("n", "n_docs"), "refs")
        return cls._from_refs(refs, min_docs, text_col)

    @classmethod
    def _from_refs(cls, refs: DataFrame, min_docs: int, text_col: str) -> LineIndex:
        common = refs.filter(F.col("n_docs") >= min_docs)
        shards = max(1, -(-common.count() // SHARD_KEYS))

        def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            made = built(pdf["hi"].to_numpy(), pdf["lo"].to_numpy())
            return pd.DataFrame({"shard": [key[0]], "keys": [len(pdf)], "data": [made.dump()]})

        placed = common.select("hi", "lo", shard_column(shards))
        filters = placed.groupBy("shard").applyInPandas(make, "shard int, keys long, data binary")
        return cls(refs, shared_table(filters, "filters"), shards, min_docs, text_col)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = key_counts(docs, self.text_col).select("hi", "lo", F.lit(0).cast("bigint").alias("n_docs"),
                                                       (F.col("n") * sign).alias("change"))
        both = self.refs.select("hi", "lo", "n_docs", F.lit(0).cast("bigint").alias("change")).unionByName(delta)
        merged = both.groupBy("hi", "lo").agg(F.sum("n_docs").alias("old"), F.sum("change").alias("change"))
        merged = shared_table(merged.withColumn("n_docs", F.col("old") + F.col("change")), "refs")
        refs = merged.filter("n_docs > 0").select("hi", "lo", "n_docs")
        was, now = F.col("old") >= self.min_docs, F.col("n_docs") >= self.min_docs
        crossed = merged.filter(was != now).select("hi", "lo", shard_column(self.shards), now.alias("add"))
        if merged.filter(now).count() > self.shards * SHARD_KEYS:
            return self._from_refs(refs, self.min_docs, self.text_col)

        def change(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            n = int(old["keys"].iloc[0]) if len(old) else 0
            held = CuckooFilter.load(old["data"].iloc[0]) if len(old) else CuckooFilter.sized(max(1, len(keys)))
            gone, new = keys[~keys["add"].astype(bool)], keys[keys["add"].astype(bool)]
            held.delete(gone["hi"].to_numpy(), gone["lo"].to_numpy())
            n += len(new) - len(gone)
            fits = n <= held.table.size * LOAD and held.insert(new["hi"].to_numpy(), new["lo"].to_numpy())
            return pd.DataFrame({"shard": [key[0]], "keys": [n], "data": [held.dump() if fits else None]})

        filters = shared_table(
            self.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
            .applyInPandas(change, "shard int, keys long, data binary"), "filters")
        if filters.filter("data is null").limit(1).count():  # a filter is full: build anew from the exact table
            return self._from_refs(refs, self.min_docs, self.text_col)
        return LineIndex(refs, filters, self.shards, self.min_docs, self.text_col)

    def lookup(self):
        """Broadcast (shards, filters, exceptions), or None where they would exceed the bound."""
        spark = self.refs.sparkSession
        size = self.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        if size > MAX_BROADCAST_BYTES:
            return None
        tables = {r["shard"]: r["data"] for r in self.filters.collect()}
        held = spark.sparkContext.broadcast((self.shards, tables, []))
        below = self.refs.filter(F.col("n_docs") < self.min_docs).select("hi", "lo")
        odd = below.mapInArrow(lambda it: false_hits(it, held), "hi long, lo long")
        found = odd.limit(MAX_BROADCAST_BYTES // 16 + 1).collect()
        if len(found) * 16 > MAX_BROADCAST_BYTES:
            return None
        return spark.sparkContext.broadcast((self.shards, tables, [(r["hi"], r["lo"]) for r in found]))

    def strip(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the common lines taken out of the text, plus two
        columns of line counts, named by :func:`count_columns`."""
        held, text_col, counts = self.lookup(), self.text_col, count_columns(docs)
        schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], *[f"{c} long" for c in counts]])
        if held is not None:
            return docs.mapInArrow(lambda it: strip_rows(it, text_col, held, counts), schema)
        # Too many common keys to broadcast: join the keys with the exact table.
        row, drop = free_name("__row", docs.columns), free_name("__drop", docs.columns)
        tagged = docs.withColumn(row, F.md5(F.coalesce(F.col(self.text_col), F.lit(""))))
        keys = tagged.select(F.col(row).alias("__row"), F.col(self.text_col).alias("text")).mapInArrow(
            row_keys, "__row string, hi long, lo long").distinct()
        common = self.refs.filter(F.col("n_docs") >= self.min_docs).select("hi", "lo")
        drops = keys.join(common, ["hi", "lo"]).groupBy(F.col("__row").alias(row)).agg(F.collect_list(F.struct("hi", "lo")).alias(drop))
        return tagged.join(drops, row, "left").drop(row).mapInArrow(
            lambda it: strip_rows(it, text_col, None, counts, drop), schema)


def hits(hi: np.ndarray, lo: np.ndarray, shards: int, filters: dict[int, CuckooFilter]) -> np.ndarray:
    out = np.zeros(len(hi), bool)
    shard = np.mod(hi, shards)
    for s, held in filters.items():
        mine = np.flatnonzero(shard == s)
        if len(mine):
            out[mine] = held.contains(hi[mine], lo[mine])
    return out


def false_hits(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """Uncommon keys that a filter takes for common."""
    shards, tables, _ = held.value
    filters = {s: CuckooFilter.load(t) for s, t in tables.items()}
    for batch in batches:
        hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
        yield batch.filter(pa.array(hits(hi, lo, shards, filters)))


def row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            doc, hi, lo = doc_keys(Lines(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("__row").take(pa.array(doc)), pa.array(hi), pa.array(lo)],
                                             names=["__row", "hi", "lo"])


def count_columns(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that :meth:`LineIndex.strip` adds (lines, dropped lines): none that ``docs`` has."""
    return free_name("__lines", docs.columns), free_name("__dropped", docs.columns)


def strip_rows(batches: Iterator[pa.RecordBatch], text_col: str, held, counts: tuple[str, str],
               listed: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows with their common lines dropped; a row's own drop list (column ``listed``) stands in for the filters."""
    if held is not None:
        shards, tables, odd = held.value
        filters = {s: CuckooFilter.load(t) for s, t in tables.items()}
        except_hi, exceptions = {h for h, _ in odd}, set(odd)
    for batch in batches:
        for part in slices(batch, text_col):
            texts = part.column(text_col)
            lines = Lines(texts)
            if held is not None:
                common = hits(lines.hi, lines.lo, shards, filters) & lines.keyed
                for i in np.flatnonzero(common & np.isin(lines.hi, list(except_hi))):
                    common[i] = (lines.hi[i], lines.lo[i]) not in exceptions
                drop = common[lines.ids]
            else:
                lists = [{(d["hi"], d["lo"]) for d in x or ()} for x in part.column(listed).to_pylist()]
                drop = np.fromiter(((int(lines.hi[i]), int(lines.lo[i])) in lists[o] and bool(lines.keyed[i])
                                    for i, o in zip(lines.ids, lines.owner, strict=True)), bool, len(lines.ids))
            dropped = np.bincount(lines.owner[drop], minlength=part.num_rows)
            kept = texts.to_pylist()
            for row in np.flatnonzero(dropped):
                own = slice(lines.starts[row], lines.ends[row])
                kept[row] = "\n".join(lines.distinct.take(pa.array(lines.ids[own][~drop[own]])).to_pylist())
            columns = [pa.array(kept, texts.type) if c == text_col else part.column(c)
                       for c in part.schema.names if c != listed]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines.ends - lines.starts), pa.array(dropped)],
                names=[*[c for c in part.schema.names if c != listed], *counts])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = LineIndex.build(docs).strip(docs)
    lines, dropped = count_columns(docs)
    return done.select("doc_id", F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH cut AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {"op7_line_dedup": SQL}
