"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model,
counted in Spark, stored as sorted hash arrays, memory-mapped by the workers.

Tokens are the text's words, A-Z lower-cased, then one end; contexts that reach
before the text hold begin marks.  Of order n, P_k(w | h) = max(a(hw) - D(a), 0)
/ A(h) + g(h) P_{k-1}(w | h'), h' being h without its farthest word; a is the
count at k = n and below it the number of distinct words in front, A the sum
over w, D one of three discounts per k for a = 1, 2, 3 or more, g(h) what they
leave; an unseen h leaves all to h'.  Below k = 1 stands 1 / (V + 1): the
training words and one for all others.

Steps, all over all rows:

1. *Chunks.*  A task tokenizes its texts once and writes them as numbers into a
   chunk's own vocabulary (64-bit hashes of words), at most ``CHUNK_BYTES`` of text.
2. *Words.*  Training counts of every word; those above half a shard's share
   are hot (at most twice as many words as shards).
3. *Shards.*  Each chunk sends its distinct n-grams, with training counts, to
   the shard of the nearest context word.  All lower orders and contexts of an
   n-gram live in the same shard, so one exchange counts every order.  A hot
   word's n-grams are dealt over several shards by the predicted word: counts
   and words in front stay whole, context sums are added up by the asker.
   Shards are made in ``WAVES``, by the context word, so that only a part of the
   n-grams is in a shuffle at a time.  A
   shard turns its counts into sorted arrays of 64-bit hashes with their
   values, which are the stored model; it maps them from a file of its own for the
   time of the task and answers every chunk by binary search, in the order asked.
4. *Scores.*  Answers and the words' own numbers meet their chunk, a wave of chunks at
   a time, which puts them and the discounts together and adds up per document.

What a task holds is bounded by the chunk and by ``SHARD_TOKENS``; the driver
gets sums, discounts and the hot words.  A stored model scores other documents
through the same steps (:func:`score`).

Hashes: a word's count goes by 64 bits; n-grams know their words by ``WORD_BITS``,
and a shard its n-grams and contexts by ``GRAM_BITS`` (an unseen n-gram is taken
for a seen one with a chance of about a millionth).  Defined results: null
text is empty (one token, the end); a null key is held out; equal keys are
documents of their own; a table without training rows has N = V = 0 and every
probability 1; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import checkpoint_dir

from .common import WordBatch, default_parallelism, mix64, read_table, settings, shared_table, shuffles_removed, slices

#: Order of the model, text bytes of a chunk, tokens of a shard, and waves in which shards are made.
ORDER = 3
CHUNK_BYTES, SHARD_TOKENS, WAVES = 12 << 20, 1_000_000, 4
#: Text bytes that are split into words at once.
STEP_BYTES = 1 << 20
#: Contexts of a shard that are unpacked at once: a hot word's are asked of all its shards, so they grow with the corpus.
CONTEXTS = 1 << 21

#: Bytes of an Arrow batch of packed rows.
BATCH_BYTES = 8 << 20
#: Bits by which n-grams know their words, and by which a shard knows its n-grams and contexts.
WORD_BITS, GRAM_BITS = 48, 40
#: Hashes of the end and of the begin mark: of texts that are no words.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(t)) for t in (b"", b" "))
PHI = np.uint64(0x9E3779B97F4A7C15)
#: Discounts where the counts of counts do not tell them.
FALLBACK = (0.5, 1.0, 1.5)


# -- packed arrays -------------------------------------------------------------

CODEC = pa.Codec("zstd", compression_level=5)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<BQ", width, len(x)) + (CODEC.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", data)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(CODEC.decompress(data[9:], n * width), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def numbers(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


def pack_steps(x: np.ndarray, bits: int = 64) -> bytes:
    """Unsigned integers below 2^bits, rising in long stretches, by their differences modulo 2^bits."""
    x = x.astype(np.uint64)
    return pack(np.diff(x, prepend=np.uint64(0)) & np.uint64((1 << bits) - 1))


def unpack_steps(data: bytes, bits: int = 64) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) & np.uint64((1 << bits) - 1)


# -- chunks --------------------------------------------------------------------

def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, held) -> one row per chunk: keys, held, sizes (tokens of each text), tokens (packed
    numbers into words), words (hashes, frequent ones first) and counts (in training texts)."""
    made = 0
    held: list[tuple] = []
    done = 0

    def chunk() -> pa.RecordBatch:
        nonlocal made, done
        keys = pa.concat_arrays([h[0] for h in held])
        out = pa.concat_arrays([h[1] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        starts = np.cumsum([0] + [len(h[4]) for h in held])
        names, at = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
        tokens = np.concatenate([at[s + h[3]] for s, h in zip(starts, held, strict=False)])
        # By size of the count, then hash: frequent words get small numbers, and hashes rise in long stretches.
        often = np.frexp(np.bincount(tokens, minlength=len(names)).astype(float))[1]
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        tokens = place[tokens]
        train = np.repeat(~out.to_numpy(zero_copy_only=False), sizes)
        counts = np.bincount(tokens[train], minlength=len(names))
        row = [((TaskContext.get().partitionId() if TaskContext.get() else 0) << 24) + made]
        made, done = made + 1, 0
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(row), *[pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (keys, out, pa.array(sizes))],
             *[pa.array([x], pa.binary()) for x in (pack(tokens), pack_steps(names[order]), pack(counts))]],
            names=["chunk", "keys", "held", "sizes", "tokens", "words", "counts"])

    for batch in batches:
        for part in slices(batch, "text", STEP_BYTES):
            words = WordBatch(part.column("text"), lower=True)
            table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct.cast(pa.binary()).to_pylist()),
                                dtype=np.uint64, count=len(words.distinct))
            sizes = words.counts + 1
            last = np.cumsum(sizes) - 1
            ids = np.full(int(sizes.sum()), len(table), np.int64)
            inner = np.ones(len(ids), bool)
            inner[last] = False
            ids[inner] = words.ids
            held.append((part.column("id"), part.column("held"), sizes, ids, np.append(table, END)))
            done += part.nbytes
            if done >= CHUNK_BYTES:
                yield chunk()
    if held:
        yield chunk()


class Chunk:
    """Tokens of a chunk: their numbers, the texts' sizes and the words' hashes, the begin mark's last."""

    def __init__(self, tokens: bytes, sizes: np.ndarray, words: bytes):
        self.tokens, self.sizes = unpack(tokens).astype(np.int32), sizes
        self.words = np.append(unpack_steps(words), BEGIN)
        self.first = np.cumsum(sizes) - sizes
        self.waves = (mix64(self.words ^ PHI) % np.uint64(WAVES)).astype(np.int8)

    def before(self, j: int) -> np.ndarray:
        """The j-th word before every token."""
        out = np.concatenate([np.full(j, len(self.words) - 1, np.int32), self.tokens])[:len(self.tokens)]
        for i in range(j):
            out[(self.first + i)[self.sizes > i]] = len(self.words) - 1
        return out


class Grams:
    """Distinct n-grams of a chunk whose nearest context word is of one wave.

    ``at``: the tokens; ``contexts``: distinct contexts, nearest word first, in order; ``context``,
    ``word``: of every distinct n-gram, in order; ``gram``: the n-gram of every token of ``at``.
    """

    def __init__(self, chunk: Chunk, order: int, wave: int):
        size = len(chunk.words)
        near = chunk.before(1)
        self.at = np.flatnonzero(chunk.waves[near] == wave)
        key, columns = near[self.at].astype(np.int64), [np.arange(size)]
        for j in range(2, order):  # number the contexts one word longer each time; numbers keep the order
            key *= size
            key += chunk.before(j)[self.at]
            found, key = np.unique(key, return_inverse=True)
            columns = [x[found // size] for x in columns] + [found % size]
        if order == 2:
            found, key = np.unique(key, return_inverse=True)
            columns = [found]
        key *= size
        key += chunk.tokens[self.at]
        grams, gram = np.unique(key, return_inverse=True)
        self.contexts, self.context, self.word = np.column_stack(columns), grams // size, grams % size
        self.gram = gram.astype(np.int32)


def deal(chunk: Chunk, grams: Grams, shards: int, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
    """n-grams by shard of the wave: their numbers in the order sent, and the shards' borders in them; and the
    contexts of a shard, in order.

    A context goes to every shard that may hold its n-grams, so all shards' together are many more than the chunk has.
    """
    ways = np.ones(len(chunk.words), np.int64)
    if hot:
        names = np.array(sorted(hot), np.uint64)
        at = np.minimum(np.searchsorted(names, chunk.words), len(names) - 1)
        ways = np.where(names[at] == chunk.words, np.array([hot[int(n)] for n in names])[at], 1)
    base = (mix64(chunk.words * PHI) % np.uint64(shards)).astype(np.int64)
    salt = mix64(chunk.words + PHI)
    near = grams.contexts[:, 0]
    first = near[grams.context]
    gram_shard = (base[first] + (salt[grams.word] % ways[first].astype(np.uint64)).astype(np.int64)) % shards
    sent = np.argsort(gram_shard, kind="stable")
    many = ways[near]
    borders = np.arange(shards + 1)
    once = np.flatnonzero(many == 1)
    once = once[np.argsort(base[near[once]], kind="stable")]
    once_at = np.searchsorted(base[near[once]], borders)
    # the contexts of one nearest word stand together
    starts = np.flatnonzero(np.diff(near, prepend=-1))
    ends = np.append(starts[1:], len(near))
    dealt = many[starts] > 1
    starts, ends = starts[dealt], ends[dealt]
    from_, ways_of = base[near[starts]], many[starts]

    def contexts(shard: int) -> np.ndarray:
        here = np.flatnonzero((shard - from_) % shards < ways_of)
        own = once[once_at[shard]:once_at[shard + 1]]
        return np.sort(np.concatenate([own, *(np.arange(starts[i], ends[i]) for i in here)])) if len(here) else own

    return sent, np.searchsorted(gram_shard[sent], borders), contexts


def parts(batches: Iterator[pa.RecordBatch], order: int, shards: int, hot: dict[int, int], wave: int) -> Iterator[pa.RecordBatch]:
    """Chunks -> their n-grams of one wave by shard: shard, chunk, blobs (words, contexts, n-grams per
    context, words predicted, training counts)."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row["tokens"], np.array(row["sizes"]), row["words"])
            found = Grams(chunk, order, wave)
            train = np.repeat(~np.array(row["held"], bool), chunk.sizes)
            counts = np.bincount(found.gram[train[found.at]], minlength=len(found.word))
            grams, gram_at, contexts = deal(chunk, found, shards, hot)
            names, rows = [], []
            place, at_context = np.zeros(len(chunk.words), np.int64), np.zeros(len(found.contexts), np.int64)
            short = chunk.words >> np.uint64(64 - WORD_BITS)
            for s in range(shards):
                mine, asked = grams[gram_at[s]:gram_at[s + 1]], contexts(s)
                if not len(asked):
                    continue
                ctx, word = found.contexts[asked], found.word[mine]
                mark = np.zeros(len(place), bool)
                mark[ctx] = mark[word] = True
                own = np.flatnonzero(mark)
                place[own] = np.arange(len(own))
                at_context[asked] = np.arange(len(asked))
                at, word = at_context[found.context[mine]], place[word]
                step = np.diff(word, prepend=0)
                new = np.diff(at, prepend=-1) != 0
                step[new] = word[new]
                columns = place[ctx].T
                names.append(wave * shards + s)
                rows.append([pack_steps(short[own], WORD_BITS), pack(np.diff(columns[0], prepend=0)), *[pack(c) for c in columns[1:]],
                             pack(np.bincount(at, minlength=len(asked))), pack(step), pack(counts[mine])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([row["chunk"]] * len(names), pa.int64()), pa.array(rows, pa.list_(pa.binary()))],
                names=["shard", "chunk", "blobs"])


# -- shards --------------------------------------------------------------------

def columns_of(blobs: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The words of a part, and by their numbers its contexts, nearest word first."""
    return unpack_steps(blobs[0], WORD_BITS), [np.cumsum(numbers(blobs[1])), *map(numbers, blobs[2:order])]


def context_hashes(words: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, hashes of the contexts) for k = 2 ... n."""
    h = np.ones(len(columns[0]), np.uint64)
    for k, c in enumerate(columns, 2):
        h = mix64(h * PHI + words[c])
        yield k, h


class Part:
    """A chunk's n-grams in one shard, as hashes."""

    def __init__(self, blobs: list[bytes], order: int):
        words, columns = columns_of(blobs, order)
        many = numbers(blobs[order])
        context = np.repeat(np.arange(len(many)), many)
        step = numbers(blobs[order + 1])
        total = np.cumsum(step)
        full = many > 0
        first = (np.cumsum(many) - many)[full]
        self.word = words[total - np.repeat(total[first] - step[first], many[full])]
        self.count = numbers(blobs[order + 2])
        self.contexts, self.grams, self.held_in = {}, {}, {}  # by k = 2 ... n; the last: each n-gram's context
        for k, h in context_hashes(words, columns):
            self.contexts[k] = h >> np.uint64(64 - GRAM_BITS)
            self.held_in[k] = self.contexts[k][context]
            self.grams[k] = mix64((h[context] ^ PHI) * PHI + self.word) >> np.uint64(64 - GRAM_BITS)


class Asked:
    """The n-grams of all parts of a shard, end to end, and the parts' contexts."""

    def __init__(self, asked: list[tuple[int, list[bytes]]], order: int):
        self.order, self.kept, self.steps = order, [], [[]]
        held, size = [], 0
        for i, (_, blobs) in enumerate(asked):
            part = Part(blobs, order)
            size += len(part.contexts[2])
            if self.steps[-1] and size > CONTEXTS:
                self.steps.append([])
                size = len(part.contexts[2])
            self.steps[-1].append(i)
            if len(self.steps) == 1:
                self.kept.append(part.contexts)
            part.contexts = None
            held.append(part)
        if len(self.steps) > 1:
            self.kept = []
        self.chunks, self.blobs = [c for c, _ in asked], [b for _, b in asked] if len(self.steps) > 1 else []
        self.word, self.count = (np.concatenate([getattr(p, name) for p in held]) for name in ("word", "count"))
        self.grams, self.held_in = ({k: np.concatenate([getattr(p, name)[k] for p in held]) for k in range(2, order + 1)}
                                    for name in ("grams", "held_in"))
        self.gram_ends = np.cumsum([len(p.word) for p in held])

    def contexts(self, step: list[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """The contexts of the parts ``step``, end to end, and where each part's end."""
        each = [self.kept[i] if self.kept else {k: h >> np.uint64(64 - GRAM_BITS) for k, h in context_hashes(*columns_of(self.blobs[i], self.order))}
                for i in step]
        return {k: np.concatenate([c[k] for c in each]) for k in range(2, self.order + 1)}, np.cumsum([len(c[2]) for c in each])


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def build(asked: Asked, order: int) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """Arrays of a shard's model: for k = n ... 2 n-gram hashes and their counts, context hashes and
    their sums (A, and how many n-grams count 1, 2, 3 or more); the counts of counts; and the
    predicted words with their distinct words in front."""
    mine = np.flatnonzero(asked.count)
    arrays: list[np.ndarray] = []
    stats: list[int] = []
    for k in range(order, 1, -1):
        names, first, at = np.unique(asked.grams[k][mine], return_index=True, return_inverse=True)
        adjusted = np.bincount(at, weights=asked.count[mine] if k == order else None, minlength=len(names)).astype(np.int64)
        mine = mine[first]  # one row for every distinct n-gram
        held_in, at = np.unique(asked.held_in[k][mine], return_inverse=True)
        sums = [np.bincount(at, weights=w, minlength=len(held_in)).astype(np.int64)
                for w in (adjusted, adjusted == 1, adjusted == 2, adjusted > 2)]
        arrays += [names, narrow(adjusted), held_in, *map(narrow, sums)]
        stats += [int((adjusted == i).sum()) for i in (1, 2, 3, 4)]
    words, in_front = np.unique(asked.word[mine], return_counts=True)
    return arrays, stats, words, in_front


class Mapped:
    """Sorted hash arrays and their values in a file of the task, memory-mapped; gone when closed."""

    def __init__(self, arrays: list[np.ndarray]):
        self.folder = tempfile.TemporaryDirectory()
        path = os.path.join(self.folder.name, "shard")
        at = []
        with open(path, "wb") as out:
            for a in arrays:
                out.write(b"\0" * (-out.tell() % 8))
                at.append(out.tell())
                out.write(np.ascontiguousarray(a).data)
        self.arrays = [np.memmap(path, a.dtype, "r", start, a.shape) if len(a) else a for a, start in zip(arrays, at, strict=True)]

    def find(self, keys: int, asked: np.ndarray, values: list[int]) -> list[np.ndarray]:
        """The values stored with each of ``asked``, 0 where there is none; searched in order of the hashes."""
        names = self.arrays[keys]
        if not len(names):
            return [np.zeros(len(asked), np.int64) for _ in values]
        order = np.argsort(asked)
        sorted_ = asked[order]
        at = np.minimum(np.searchsorted(names, sorted_), len(names) - 1)
        hit = names[at] == sorted_
        out = []
        for v in values:
            found = np.empty(len(asked), self.arrays[v].dtype)
            found[order] = np.where(hit, self.arrays[v][at], 0)
            out.append(found)
        return out

    def close(self) -> None:
        self.arrays = []
        self.folder.cleanup()


#: Kinds of rows of a shard: its model, an answer to a chunk, its words.
MODEL, ANSWER, WORDS = 0, 1, 2
SHARD = "shard int, chunk long, blobs array<binary>, stats array<long>, kind int"


def _row(shard: int, chunk: int | None, blobs: list[bytes], stats: list[int] | None, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([blobs], pa.list_(pa.binary())),
         pa.array([stats], pa.list_(pa.int64())), pa.array([kind], pa.int32())], names=["shard", "chunk", "blobs", "stats", "kind"])


def serve(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its stored model first if there is one, then the chunks' parts -> the
    shard's model and words, unless they were stored, and an answer per chunk."""
    width = 7  # arrays of one k

    def shard_rows(shard: int, stored: list[bytes] | None, parts_of: list[tuple[int, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        if not parts_of:
            return  # a stored shard that no chunk asks
        asked = Asked(parts_of, order)
        parts_of.clear()
        if stored is None:
            arrays, stats, words, in_front = build(asked, order)
            packed = [pack_steps(a, GRAM_BITS) if i % width in (0, 2) else pack(a) for i, a in enumerate(arrays)]
            yield _row(shard, None, packed, stats, MODEL)
            yield _row(shard, None, [pack_steps(words, WORD_BITS), pack(in_front)], None, WORDS)
            del packed
        else:
            arrays = [unpack_steps(b, GRAM_BITS) if i % width in (0, 2) else narrow(unpack(b)) for i, b in enumerate(stored)]
        mapped = Mapped(arrays)
        del arrays
        try:
            for step in asked.steps:
                contexts, context_ends = asked.contexts(step)
                before = asked.gram_ends[step[0] - 1] if step[0] else 0
                grams, gram_ends = slice(before, asked.gram_ends[step[-1]]), asked.gram_ends[step] - before
                out: list[list[bytes]] = [[] for _ in step]

                def answer(keys: int, hashes: np.ndarray, values: list[int], ends: np.ndarray) -> None:
                    for found in mapped.find(keys, hashes, values):
                        for told, x in zip(out, np.split(found, ends[:-1]), strict=True):
                            told.append(pack(x))

                for i, k in enumerate(range(order, 1, -1)):
                    answer(width * i, asked.grams[k][grams], [width * i + 1], gram_ends)
                    answer(width * i + 2, contexts[k], [width * i + j for j in (3, 4, 5, 6)], context_ends)
                del contexts
                for i, told in zip(step, out, strict=True):
                    yield _row(shard, asked.chunks[i], told, None, ANSWER)
        finally:
            mapped.close()

    shard, stored, asked = None, None, []
    for batch in batches:
        names, kinds, chunks = (batch.column(c).to_pylist() for c in ("shard", "kind", "chunk"))
        for i, blobs in enumerate(batch.column("blobs")):
            if names[i] != shard:
                if shard is not None:
                    yield from shard_rows(shard, stored, asked)
                shard, stored, asked = names[i], None, []
            held = [b.as_buffer() for b in blobs.values]  # views of the batch, no copies
            if kinds[i] == MODEL:
                stored = held
            else:
                asked.append((chunks[i], held))
    if shard is not None:
        yield from shard_rows(shard, stored, asked)


# -- scores --------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D for counts of 1, 2, 3 or more, from the numbers of n-grams that count 1 ... 4."""
    if not (n1 and n2 and n3 and n4):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    told = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(told, 1))


@dataclass
class Model:
    """A fitted model: where its words (under ``path``) and its shards (``grams``) lie, and its sums.

    ``sums[k]``: discounts of order k; ``lowest``: A and the counts of counts
    1, 2, 3 or more at k = 1.
    """

    order: int
    path: str
    shards: int  # of one wave
    grams: str = ""
    hot: dict[int, int] = field(default_factory=dict)
    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    lowest: tuple[int, int, int, int] = (0, 0, 0, 0)
    tokens: int = 0
    words: int = 0

    def discounted(self, k: int, a: np.ndarray) -> np.ndarray:
        return a - np.array([0.0, *self.sums[k]])[np.minimum(a, 3)]

    def word_probability(self, in_front: np.ndarray) -> np.ndarray:
        total, *ones = self.lowest
        left = sum(d * n for d, n in zip(self.sums[1], ones, strict=True)) / total if total else 1.0
        return self.discounted(1, in_front) / max(total, 1) + left / (self.words + 1)


def scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: the chunk, its words' numbers, the shards' answers -> one row per document."""
    chunk = row = numbers_of = None
    answers: list[tuple[int, list[bytes]]] = []

    def probabilities(c: Chunk, found: Grams, single: np.ndarray, wave: int) -> np.ndarray:
        """Of the distinct n-grams."""
        grams, gram_at, contexts = deal(c, found, model.shards, model.hot)
        levels = range(model.order, 1, -1)
        adjusted = {k: np.zeros(len(found.word), np.int64) for k in levels}
        sums = {k: np.zeros((4, len(found.contexts)), np.int64) for k in levels}
        for shard, blobs in answers:
            if shard // model.shards != wave:
                continue
            s = shard % model.shards
            mine, asked = grams[gram_at[s]:gram_at[s + 1]], contexts(s)
            for i, k in enumerate(levels):
                adjusted[k][mine] = numbers(blobs[5 * i])
                for j in range(4):
                    sums[k][j][asked] += numbers(blobs[5 * i + 1 + j])
        p = single[found.word]
        for k in reversed(levels):
            total, *ones = sums[k]
            safe = np.maximum(total, 1)
            left = np.where(total > 0, sum(d * n for d, n in zip(model.sums[k], ones, strict=True)) / safe, 1.0)
            p = model.discounted(k, adjusted[k]) / safe[found.context] + left[found.context] * p
        return p

    def documents() -> pa.RecordBatch:
        sizes = np.array(row["sizes"])
        c = Chunk(row["tokens"], sizes, row["words"])
        count, in_front = np.zeros((2, len(c.words)), np.int64)
        if numbers_of is not None:
            count[numbers_of[0]], in_front[numbers_of[0]] = numbers_of[1], numbers_of[2]
        single = model.word_probability(in_front)
        logs = np.zeros(len(c.tokens))
        for wave in range(WAVES):
            found = Grams(c, model.order, wave)
            if len(found.at):
                logs[found.at] = np.log10(probabilities(c, found, single, wave))[found.gram]
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        first = c.first

        def total_of(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, first)

        return pa.RecordBatch.from_arrays(
            [row["keys"], row["held"], pa.array(sizes.astype(np.int64)), pa.array(total_of((count > 0)[c.tokens].astype(np.int64))),
             pa.array(np.full(len(sizes), model.tokens, np.int64)), pa.array(total_of(base[c.tokens])), pa.array(total_of(logs))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            one = {name: batch.column(name)[i] for name in batch.schema.names}
            if one["chunk"].as_py() != chunk:
                if chunk is not None:
                    yield documents()
                chunk, row, numbers_of, answers = one["chunk"].as_py(), None, None, []
            kind = one["kind"].as_py()
            if kind == 0:
                row = {c: one[c].values for c in ("keys", "held")} | {"sizes": one["sizes"].values.to_numpy()}
                row |= {c: one[c].as_py() for c in ("tokens", "words")}
            elif kind == 1:
                told = one["blobs"].as_py()
                numbers_of = [np.cumsum(numbers(told[0])), numbers(told[1]), numbers(told[2])]
            else:
                answers.append((one["shard"].as_py(), one["blobs"].as_py()))
    if chunk is not None:
        yield documents()


def chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> chunk, at (number in the chunk), word (hash), n (training count), one row per word."""
    for batch in batches:
        for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
            names = unpack_steps(words).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), chunk)), pa.array(np.arange(len(names), dtype=np.int32)),
                                              pa.array(names), pa.array(numbers(counts))], names=["chunk", "at", "word", "n"])


def pack_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, known: numbers of its words) -> chunk, blobs (places, training counts, words in front)."""
    for batch in batches:
        for chunk, known in zip(batch.column("chunk").to_pylist(), batch.column("known"), strict=True):
            at, n, front = (known.values.field(c).to_numpy() for c in ("at", "n", "front"))
            order = np.argsort(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([[pack(np.diff(at[order], prepend=0)), pack(n[order]), pack(front[order])]], pa.list_(pa.binary()))],
                names=["chunk", "blobs"])


def shard_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blobs in batch.column("blobs").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(unpack_steps(blobs[0], WORD_BITS).view("<i8")), pa.array(numbers(blobs[1]))],
                                             names=["short", "front"])


def _chunks(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, held) as a written table of chunks."""
    key = docs.schema["id"].dataType.simpleString()
    return shared_table(docs.mapInArrow(encode, f"chunk long, keys array<{key}>, held array<boolean>, sizes array<long>, "
                                                "tokens binary, words binary, counts binary"), "chunks")


def _served(chunks: DataFrame, model: Model, stored: DataFrame | None) -> str:
    """The shards' rows for the chunks, written by kind; their folder."""
    spark = chunks.sparkSession
    order, shards, hot = model.order, model.shards, model.hot
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/shards"
    for wave in range(WAVES):
        asked = _wave(chunks, order, shards, hot, wave).withColumn("kind", F.lit(ANSWER))
        if stored is not None:
            mine = stored.filter(F.expr(f"shard div {shards} = {wave}"))
            asked = asked.unionByName(mine.select("shard", F.lit(None).cast("long").alias("chunk"), "blobs", F.lit(MODEL).alias("kind")))
        dealt = asked.repartition(default_parallelism(spark), "shard").sortWithinPartitions("shard", "kind", "chunk")
        with shuffles_removed(spark), settings(spark, batch_bytes=str(BATCH_BYTES)):
            dealt.mapInArrow(lambda it: serve(it, order), SHARD).write.mode("append").partitionBy("kind").parquet(path)
    return path


def _wave(chunks: DataFrame, order: int, shards: int, hot: dict[int, int], wave: int) -> DataFrame:
    return chunks.select("chunk", "held", "sizes", "tokens", "words").mapInArrow(
        lambda it: parts(it, order, shards, hot, wave), "shard int, chunk long, blobs array<binary>")


def _shard_rows(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path).filter(F.col("kind") == kind)


def _known(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, blobs): the numbers of each chunk's words under the model."""
    return shared_table(
        chunks.select("chunk", "words", "counts").mapInArrow(chunk_words, "chunk long, at int, word long, n long")
        .select("chunk", "at", "word").join(words, "word")
        .groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "front")).alias("known"))
        .mapInArrow(pack_known, "chunk long, blobs array<binary>"), "known")


def _documents(chunks: DataFrame, model: Model, answers: str) -> DataFrame:
    """Scores of the chunks' documents, from the answers under ``answers``."""
    spark = chunks.sparkSession
    words = spark.read.parquet(f"{model.path}/words")
    key = chunks.schema["keys"].dataType.elementType.simpleString()
    schema = f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/scores"
    told = _shard_rows(spark, answers, ANSWER).select("chunk", F.lit(2).alias("kind"), "shard", "blobs")
    for wave in range(WAVES):  # of chunks: only a part of them, and of their words, is in a shuffle at a time
        mine = F.pmod(F.xxhash64("chunk"), F.lit(WAVES)) == wave
        some = chunks.filter(mine)
        known = _known(some, words)
        rows = (some.select("chunk", F.lit(0).alias("kind"), "keys", "held", "sizes", "tokens", "words")
                .unionByName(known.withColumn("kind", F.lit(1)), allowMissingColumns=True)
                .unionByName(told.filter(mine), allowMissingColumns=True))
        dealt = rows.repartition(default_parallelism(spark), "chunk").sortWithinPartitions("chunk", "kind", "shard")
        with shuffles_removed(spark), settings(spark, batch_bytes=str(BATCH_BYTES)):  # a row holds a whole chunk
            dealt.mapInArrow(lambda it: scores(it, model), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def train_and_score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
                    held_col: str = "held") -> tuple[Model, DataFrame]:
    """The model of the rows of ``docs`` that are not held out, and the scores of all rows."""
    if order < 2:
        raise ValueError("the order is at least 2")
    spark = docs.sparkSession
    chunks = _chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(held_col).alias("held")))
    counted = shared_table(chunks.select("chunk", "words", "counts").mapInArrow(chunk_words, "chunk long, at int, word long, n long")
                           .filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    facts = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    sizes = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).head()["n"] or 0
    texts = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).head()["n"] or 0

    shards = max(min(default_parallelism(spark), 8), -(-sizes // (SHARD_TOKENS * WAVES)))
    share = facts["n"] / (2 * shards * WAVES)
    often = [(r["word"], r["n"]) for r in counted.filter(F.col("n") > share).collect()] if facts["n"] else []  # fewer than 2 * shards * WAVES
    often += [(int(BEGIN.view(np.int64)), texts)] if texts > share else []
    hot = {w % (1 << 64): min(shards, -(-int(n) // max(1, int(share)))) for w, n in often}
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/model"
    model = Model(order, path, shards, hot=hot, tokens=facts["n"], words=facts["v"])
    model.grams = served = _served(chunks, model, None)

    front = _shard_rows(spark, served, WORDS).select("blobs").mapInArrow(shard_words, "short long, front long") \
        .groupBy("short").agg(F.sum("front").alias("front"))
    short = F.shiftrightunsigned("word", 64 - WORD_BITS).alias("short")
    with shuffles_removed(spark):
        counted.select("word", "n", short).join(front, "short").select("word", "n", "front").write.parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    low = words.agg(F.coalesce(F.sum("front"), F.lit(0)).alias("total"), *[F.count_if(F.col("front") == i).alias(f"n{i}") for i in (1, 2, 3, 4)],
                    F.count_if(F.col("front") > 2).alias("more")).head()
    model.lowest = (low["total"], low["n1"], low["n2"], low["more"])
    model.sums[1] = discounts(*[low[f"n{i}"] for i in (1, 2, 3, 4)])
    told = _shard_rows(spark, served, MODEL).agg(*[
        F.coalesce(F.sum(F.element_at("stats", i + 1)), F.lit(0)).alias(f"s{i}") for i in range(4 * (order - 1))]).head()
    for i, k in enumerate(range(order, 1, -1)):
        model.sums[k] = discounts(*told[4 * i:4 * i + 4])
    return model, _documents(chunks, model, served)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of other documents under a stored model."""
    chunks = _chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("held")))
    stored = _shard_rows(docs.sparkSession, model.grams, MODEL)
    return _documents(chunks, model, _served(chunks, model, stored))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return train_and_score(docs.select("doc_id", "text", held.alias("held")))[1]


QUERIES = {"op13_lm_scores": op13_lm_scores}
ORACLE_SQL: dict[str, str] = {}
