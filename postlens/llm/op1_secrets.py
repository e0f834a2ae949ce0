"""Secret scans: strong patterns, and weak parts linked by an interval join.

Strong (base) spans stand on their own: ``assign``, ``access``, ``hex``.  Weak
parts are account identifiers (``id``), short or unlabelled secrets
(``secret``) and endpoints (``endpoint``); each alone is everyday text.  A weak
part is reported only when a complementary part lies in the same scope, however
far (``reach`` sets a bound in characters): a secret next to an identifier (or
access key) or an endpoint, an identifier or endpoint next to a secret (weak,
assign or hex).
Parts that overlap are next to each other; a weak secret wholly inside a strong
span is that span, and no part of its own.

A scope is a block of the text between blank lines.  The per-row helper only
finds intervals; the join is a Spark window over (document, scope) in start
order: the greatest end before and the smallest start after each part give the
nearest complement on either side, so no pairs are formed, and a document's
parts need one sort.

Offsets are code points, ends exclusive.  Defined results: a null or empty text
has no spans; equal rows (same key and text) each get their own, equal result
row; a null key is kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN, ACCESS, HEX, ID, SECRET, ENDPOINT = range(6)

# Fixed patterns (over UTF-8 bytes; keyword patterns over lower-cased ASCII).
ASSIGN_RE = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS_RE = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX_RE = re.compile(rb"[0-9a-f]{16,}")
ID_KEY_RE = re.compile(rb"(?:user_?name|user|login|account_?id|account|client_?id|access_?key_?id|e?mail)"
                       rb"[\"']?\x20*[:=]\x20*[\"']?([a-z0-9_.@+-]{3,})")
MAIL_RE = re.compile(rb"@[a-z0-9-]+(?:\.[a-z0-9-]+)+")
SECRET_KEY_RE = re.compile(rb"(?:passphrase|pass|pwd|pin|private_?key|key|auth|credential|signature)"
                           rb"[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]{4,})")
TOKEN_RE = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
HOST_KEY_RE = re.compile(rb"(?:hostname|host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9.-]{3,}(?::[0-9]+)?)")
LINK_RE = re.compile(rb"://[^\x00-\x20\"'<>]+")
IP_RE = re.compile(rb"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?")
BLANK_RE = re.compile(rb"\n[\x20\x09\x0B-\x0D]*\n")
MAIL_CHARS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME_CHARS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Least lengths of the base kinds, and how far left a mail name or scheme may reach.
LEAST_ASSIGN, MAX_MAIL_NAME, MAX_SCHEME = 12, 64, 16


def base_spans(data: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) byte spans of the strong kinds, by start, then kind."""
    out = []
    if b"=" in data or b":" in data:
        out += [(m.start(), ASSIGN, m.end()) for m in ASSIGN_RE.finditer(low) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    out += [(m.start(), ACCESS, m.end()) for m in ACCESS_RE.finditer(data)]
    out += [(m.start(), HEX, m.end()) for m in HEX_RE.finditer(data)]
    return sorted(out)


def _left(data: bytes, at: int, chars: frozenset, most: int) -> int:
    stop = max(0, at - most)
    while at > stop and data[at - 1] in chars:
        at -= 1
    return at


def weak_spans(data: bytes, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) byte spans of the weak parts; secrets wholly inside a base span are left out."""
    out = []
    keyed = b"=" in data or b":" in data
    if b"@" in data:
        for m in MAIL_RE.finditer(low):
            start = _left(low, m.start(), MAIL_CHARS, MAX_MAIL_NAME)
            if start < m.start():
                out.append((start, ID, m.end()))
    if b"://" in data:
        for m in LINK_RE.finditer(data):
            start = _left(low, m.start(), SCHEME_CHARS, MAX_SCHEME)
            if start < m.start():
                out.append((start, ENDPOINT, m.end()))
    for m in IP_RE.finditer(data):
        around = data[m.start() - 1:m.start()] + data[m.end():m.end() + 1]
        if not any(c in b"0123456789" for c in around):
            out.append((m.start(), ENDPOINT, m.end()))
    if keyed:
        out += [(m.start(), ID, m.end()) for m in ID_KEY_RE.finditer(low)]
        out += [(m.start(), ENDPOINT, m.end()) for m in HOST_KEY_RE.finditer(low)]
    if not out and not any(kind == ACCESS for _, kind, _ in base):
        return []  # no complement for a weak secret, hence none to report
    if keyed:
        out += [(m.start(), SECRET, m.end()) for m in SECRET_KEY_RE.finditer(low)]
        out += [(m.start(), SECRET, m.end()) for m in ASSIGN_RE.finditer(low) if 4 <= m.end(1) - m.start(1) < LEAST_ASSIGN]
    for m in TOKEN_RE.finditer(data):
        token = m[0]
        if any(48 <= c <= 57 for c in token) and token.lower() != token and token.upper() != token:
            out.append((m.start(), SECRET, m.end()))
    ends = [(s, e) for s, _, e in base]
    return sorted({(s, k, e) for s, k, e in out if k != SECRET or not any(a <= s and e <= b for a, b in ends)})


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, text_key) -> counts, base digest and all parts of each row."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())])
    for batch in batches:
        counts, digests, parts = [], [], []
        for text in batch.column("text"):
            data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
            low = data.lower()
            base = base_spans(data, low)
            found = base + weak_spans(data, low, base)
            if found:
                breaks = [m.start() for m in BLANK_RE.finditer(data)]
                at = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
                found = [(int(at[s]), k, int(at[e]), bisect_right(breaks, s)) for s, k, e in found]
            told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found[:len(base)])
            counts.append([sum(k == kind for _, k, _ in base) for kind in (ASSIGN, ACCESS, HEX)])
            digests.append(hashlib.sha256(told.encode()).hexdigest())
            parts.append([dict(zip(("start", "kind", "end", "scope"), x, strict=True)) for x in found])
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text_key"), *columns, pa.array(digests, pa.string()),
             pa.array(parts, pa.list_(span))],
            names=["id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "parts"])


def link_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """Base counts and digest plus ``parts``: all base spans and the linked weak
    spans as an array of (start, kind name, end), one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {id_type}, text_key string, n_assign long, n_access long, n_hex long, "
                                  "base_sha256 string, parts array<struct<start:long,kind:int,end:long,scope:long>>")
    base = ["n_assign", "n_access", "n_hex", "base_sha256"]
    apart = (found.select("id", "text_key", *base, F.posexplode_outer("parts").alias("pos", "p"))
             .select("id", "text_key", *base, "pos", "p.*").repartition("id", "text_key"))

    order = Window.partitionBy("id", "text_key", "scope").orderBy("start", "kind", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)

    def near(kinds: tuple[int, ...]) -> Column:
        """Whether a part of one of ``kinds`` is in the scope (within reach) on either side."""
        end = F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(before)
        start = F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(after)
        if reach is None:
            return end.isNotNull() | start.isNotNull()
        return F.coalesce(F.col("start") - end <= reach, F.lit(False)) | F.coalesce(start - F.col("end") <= reach, F.lit(False))

    marked = apart.select("*", near((ACCESS, ID, ENDPOINT)).alias("owner"), near((ASSIGN, HEX, SECRET)).alias("key"))
    kept = (F.when(F.col("kind") <= HEX, True).when(F.col("kind") == SECRET, F.col("owner"))
            .when(F.col("kind").isNotNull(), F.col("key")).otherwise(False))
    part = F.when(kept, F.struct("start", "kind", "end"))
    merged = marked.groupBy("id", "text_key").agg(
        *[F.first(c).alias(c) for c in base],
        F.array_sort(F.collect_set(part)).alias("parts"),
        F.sum(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1).otherwise(0)).alias("rows"))
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform("parts", lambda p: F.struct(
        p["start"].alias("start"), F.element_at(names, p["kind"] + 1).alias("kind"), p["end"].alias("end")))
    return (merged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
            .select(F.col("id").alias(id_col), *base, told.alias("parts")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",").alias("spans"),
        (F.size("parts") - F.col("n_assign") - F.col("n_access") - F.col("n_hex")).cast("bigint").alias("n_linked"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL: dict[str, str] = {}
