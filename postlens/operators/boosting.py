"""Gradient-boosted trees over the stored entries of sparse vectors.

The algorithm is that of MLlib's ``GBTClassifier`` for two classes (log loss on
-1/+1, the first tree fitted on the labels with weight 1, each later one on the
loss's negative gradient with the step size as weight; regression trees split
where the variance falls most, level by level, at thresholds between at most
``max_bins`` bins per feature).  MLlib keeps and sums up every feature of every
row; TF-IDF rows hold one or two of a hundred.  Here a task adds up the stored
entries only, and a feature's bin with the zero is the node's total less its other bins.

Rows of up to ``TASK_ENTRIES`` stored entries are binned by all tasks and boosted by one, which holds
them as one block: a level then takes milliseconds, where a Spark job would take most of a second.
Beyond, one Spark job per level: rows in blocks (cached, numpy arrays) -> sums per
(node, bin) that occur -> shuffle by range of features -> best split per node
and range -> the driver, which sees one split per open node and range.  Either way, of
two siblings the one with more rows gets its sums as its parent's less the other's.  A tree
holds at most ``2 ** (max_depth + 1)`` nodes; thresholds are at most
``max_bins - 1`` numbers per feature.  The fitted trees become a
``GBTClassificationModel``, which scores, saves and loads as any other.
"""

from __future__ import annotations

import json
import pickle
import time
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from .vocab import sparse_entries

#: Rows per cached block (the step of a task's numpy work) and per task of a small input.
BLOCK_ROWS = 4096
TASK_ROWS = 1000
#: Trees after which the rows' margins are written into the blocks anew.
MARGIN_EVERY = 10
#: Sums that a task holds before it adds equal keys up.
MERGE_ROWS = 1 << 21
#: Stored entries that one task boosts by itself (8 bytes each, 16 while they are put together).
TASK_ENTRIES = 1 << 25
#: A gain below this share of a node's sum of squares is rounding.
NOISE = 1e-12
#: Least share of its parent's sum of squares with which a node's sums are worked out as a difference.
DIFFERENCE = 1e-3


class Bins(NamedTuple):
    """The bins of all features, numbered one after the other."""

    cuts: np.ndarray  # thresholds; those of feature f are cuts[offset[f] - f:offset[f + 1] - f - 1]
    offset: np.ndarray  # first bin of each feature, then the number of bins
    feature: np.ndarray  # feature of each bin
    zero: np.ndarray  # the bin of each feature that holds 0


class Block(NamedTuple):
    """Rows of a task: labels (-1/+1), margins so far, and the entries outside their feature's zero bin by bin."""

    label: np.ndarray
    margin: np.ndarray
    bins: np.ndarray
    rows: np.ndarray
    starts: np.ndarray | None = None  # where each bin's entries begin, where that is known

    def bin_starts(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.bins, prepend=-1)) if self.starts is None else self.starts

    def summed(self, at: np.ndarray, moments: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the rows' ``moments`` by node and bin, for rows whose node ``at`` is not -1."""
        nodes = int(at.max()) + 1
        if nodes == 1 and at.min() == 0:  # all rows are in one node
            starts = self.bin_starts()
            return self.bins[starts].astype(np.int64), np.stack([np.add.reduceat(moments[:, j].take(self.rows), starts) for j in range(3)], axis=1)
        of = at.astype(np.int8 if nodes < 128 else np.int64).take(self.rows)
        used = np.flatnonzero(of >= 0)
        if not len(used):
            return np.zeros(0, dtype=np.int64), np.zeros((0, 3))
        of, rows, bins = of.take(used).astype(np.int64), self.rows.take(used), self.bins.take(used)
        step = np.cumsum(np.diff(bins, prepend=bins[:1]) != 0)  # the bins that occur, numbered
        n = int(step[-1]) + 1 if len(bins) else 0
        if nodes * n > 4 * len(bins):
            return summed(of * n_bins + bins, [moments[:, j].take(rows) for j in range(3)])
        local = of * n + step
        there = np.flatnonzero(np.bincount(local, minlength=nodes * n))
        stats = np.stack([np.bincount(local, weights=moments[:, j].take(rows), minlength=nodes * n)[there] for j in range(3)], axis=1)
        return there // n * n_bins + bins[np.flatnonzero(np.diff(bins, prepend=-1))][there % n], stats


class Tree(NamedTuple):
    """Nodes in the order of their levels: the last bin that goes left (-1: leaf), the left child (the right one is next), the mean."""

    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray


# -- bins ----------------------------------------------------------------------------

def feature_cuts(values: Iterable[tuple[float, int]], rows: int, max_bins: int) -> list[float]:
    """Thresholds of one feature from its values in ascending order with their counts, zeros included: all
    middles between neighbours where these are fewer than ``max_bins``, else those next to even strides."""
    middles, cuts = [], []
    target = stride = rows / max_bins
    seen, before = 0, None
    for value, n in values:
        if before is not None:
            middle = (before + value) / 2
            if len(middles) < max_bins:
                middles.append(middle)
            if abs(seen - target) < abs(seen + n - target):
                cuts.append(middle)
                target += stride
        seen, before = seen + n, value
    return middles if len(middles) < max_bins else cuts


def _cuts(batches: Iterator[pa.RecordBatch], rows: int, max_bins: int) -> Iterator[pa.RecordBatch]:
    each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for idx, group in groupby(each, itemgetter(0)):
        cuts = feature_cuts(((v, n) for _, v, n in group), rows, max_bins)
        yield pa.record_batch([pa.array([idx], pa.int32()), pa.array([cuts], pa.list_(pa.float64()))], ["idx", "cuts"])


def fit_cuts(data: DataFrame, rows: int, max_bins: int) -> DataFrame:
    """``(idx, cuts)`` of every feature with a stored entry, from all rows (``entries``: their stored entries).
    A task reads a feature's values in order, whatever their number."""
    each = data.select(F.explode("entries").alias("e")).filter("e.weight <> 0")
    counts = each.groupBy(F.col("e.idx").alias("idx"), F.col("e.weight").alias("value")).agg(F.count("*").alias("n"))
    zeros = counts.groupBy("idx").agg((F.lit(rows) - F.sum("n")).alias("n")).filter("n > 0").select("idx", F.lit(0.0).alias("value"), "n")
    ordered = counts.unionByName(zeros).repartition("idx").sortWithinPartitions("idx", "value")
    return ordered.mapInArrow(lambda batches: _cuts(batches, rows, max_bins), "idx int, cuts array<double>")


def number_bins(cuts: dict[int, list[float]], width: int) -> Bins:
    each = [np.array(cuts.get(f, ())) for f in range(width)]
    offset = np.concatenate([[0], np.cumsum([len(c) + 1 for c in each])])
    zero = offset[:-1] + np.array([np.searchsorted(c, 0.0) for c in each], dtype=np.int64)
    return Bins(np.concatenate(each), offset, np.repeat(np.arange(width), np.diff(offset)), zero)


def bin_entries(idx: np.ndarray, values: np.ndarray, bins: Bins) -> np.ndarray:
    """The bin of each entry (a value on a threshold goes left of it)."""
    order = np.argsort(idx, kind="stable")
    found, first = np.unique(idx[order], return_index=True)
    out = np.empty(len(idx), dtype=np.int64)
    for f, part in zip(found, np.split(order, first[1:])):
        lo, hi = bins.offset[f], bins.offset[f + 1]
        out[part] = lo + np.searchsorted(bins.cuts[lo - f:hi - f - 1], values[part])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
            label = batch.column("label").to_numpy(zero_copy_only=False) * 2 - 1
            lists = batch.column("entries")
            entries = lists.flatten()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(label), dtype=np.int32), lengths)
            idx = entries.field("idx").to_numpy(zero_copy_only=False)
            flat = bin_entries(idx, entries.field("weight").to_numpy(zero_copy_only=False), bins)
            kept = np.flatnonzero(flat != bins.zero[idx])
            kept = kept[np.argsort(flat[kept], kind="stable")]
            block = Block(label, np.zeros(len(label)), flat[kept].astype(np.int32), rows[kept])
            yield pa.record_batch([pa.array([packed(block)], pa.binary())], ["block"])


def packed(block: Block) -> bytes:
    """A block as bytes, its bins as runs."""
    starts = np.flatnonzero(np.diff(block.bins, prepend=-1)).astype(np.int32)
    runs = np.diff(starts, append=len(block.bins)).astype(np.int32)
    rows = block.rows.astype(np.uint16) if len(block.label) < 1 << 16 else block.rows
    return pickle.dumps((block.label.astype(np.int8), block.margin if block.margin.any() else None, block.bins[starts], runs, rows), protocol=5)


def unpacked(data: bytes) -> Block:
    label, margin, bins, runs, rows = pickle.loads(data)
    return Block(label.astype(float), np.zeros(len(label)) if margin is None else margin, np.repeat(bins, runs), rows)


def joined(blocks: list[Block], n_bins: int) -> Block:
    """The blocks' rows, one after the other, as one block.  ``blocks`` is emptied on the way."""
    counts = np.zeros(n_bins, dtype=np.int64)
    for b in blocks:
        counts += np.bincount(b.bins, minlength=n_bins)
    free = np.cumsum(counts) - counts  # where the next entry of each bin goes
    label, margin = (np.concatenate([x[i] for x in blocks]) for i in (0, 1))
    rows, before = np.empty(int(counts.sum()), dtype=np.int32), 0
    blocks.reverse()
    while blocks:
        b = blocks.pop()
        starts = np.flatnonzero(np.diff(b.bins, prepend=-1))
        runs = np.diff(starts, append=len(b.bins))
        found = b.bins[starts]
        rows[np.arange(len(b.bins)) + np.repeat(free[found] - starts, runs)] = b.rows.astype(np.int32) + before
        free[found] += runs
        before += len(b.label)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    return Block(label, margin, np.repeat(np.arange(n_bins, dtype=np.int32), counts), rows, starts)


# -- one level -----------------------------------------------------------------------

def place(block: Block, tree: Tree, bins: Bins) -> np.ndarray:
    """The node of each row."""
    at = np.zeros(len(block.label), dtype=np.int64)
    for node in np.flatnonzero(tree.cut >= 0):
        cut = tree.cut[node]
        f = bins.feature[cut]
        here = at == node
        goes = np.full(len(at), bins.zero[f] <= cut)
        lo, hi = np.searchsorted(block.bins, bins.offset[f:f + 2].astype(block.bins.dtype))
        goes[block.rows[lo:hi]] = block.bins[lo:hi] <= cut
        at[here] = np.where(goes[here], tree.left[node], tree.left[node] + 1)
    return at


def margins(block: Block, trees: list[tuple[float, Tree]], bins: Bins) -> np.ndarray:
    out = block.margin.copy()
    for weight, tree in trees:
        out += weight * tree.value[place(block, tree, bins)]
    return out


def summed(keys: np.ndarray, stats) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their rows of ``stats`` (an array, or its columns)."""
    columns = stats.T if isinstance(stats, np.ndarray) else stats
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, weights=c, minlength=len(found)) for c in columns], axis=1)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), x, x * x]).T  # each moment in one piece


def _level_sums(task: int, blocks: Iterator[Block], trees: list, first: bool, tree: Tree, nodes: np.ndarray, bins: Bins, parts: int,
                larger: Iterable[int] = ()):
    """For each range of features: the rows, sums and sums of squares of every open node, and of every (node, bin) that occurs,
    those of the nodes at the places ``larger`` left out."""
    slot = np.full(len(tree.cut), -1)
    slot[nodes] = np.arange(len(nodes))
    asked = np.arange(len(nodes) + 1)
    asked[[*larger, -1]] = -1  # the last for rows of no node
    n_bins, width = len(bins.feature), len(bins.zero)
    totals = np.zeros((len(nodes), 3))
    keys, stats = np.zeros(0, dtype=np.int64), np.zeros((0, 3))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        return summed(np.concatenate([keys, *(k for k, _ in held)]), np.concatenate([stats, *(s for _, s in held)]))

    for block in blocks:
        at = slot[place(block, tree, bins)]
        target = block.label if first else 4 * block.label / (1 + np.exp(2 * block.label * margins(block, trees, bins)))
        inside = at >= 0
        moments = _moments(target)
        for j in range(3):
            totals[:, j] += np.bincount(at[inside], weights=moments[inside, j], minlength=len(nodes))
        at = asked[at]
        if len(block.bins) and (at >= 0).any():
            held.append(block.summed(at, moments, n_bins))
        if sum(len(k) for k, _ in held) > MERGE_ROWS:
            (keys, stats), held = merged(), []
    keys, stats = held[0] if len(held) == 1 and not len(keys) else merged()
    if parts == 1:
        yield 0, (task, totals, keys, stats)
        return
    part = bins.feature[keys % n_bins] * parts // width
    for p in range(parts):
        yield p, (task, totals, keys[part == p], stats[part == p])


def best_splits(totals: np.ndarray, keys: np.ndarray, stats: np.ndarray, bins: Bins) -> list[tuple]:
    """``(node, gain * rows, last bin to the left, moments to the left)`` of the best split of each node, by its
    moments in ``totals`` and those of its bins other than the zero bins.  Of equal gains the first feature and bin counts."""
    n_bins, out = len(bins.feature), []
    cuts = np.searchsorted(keys, np.arange(len(totals) + 1) * n_bins)
    for node, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if lo < hi:
            out += _best_split(node, totals[node], keys[lo:hi] - node * n_bins, stats[lo:hi], bins)
    return out


def _best_split(node: int, total: np.ndarray, found: np.ndarray, stats: np.ndarray, bins: Bins) -> list[tuple]:
    feature = bins.feature.take(found)
    starts = np.flatnonzero(np.diff(feature, prepend=-1))
    zero = total - np.add.reduceat(stats, starts)
    there = np.flatnonzero(zero[:, 0] > 0)
    zero, zeros = zero[there], bins.zero.take(feature[starts[there]])
    # the zero bins are put in at their places
    at = np.searchsorted(found, zeros) + np.arange(len(zeros))
    others = np.ones(len(found) + len(zeros), dtype=bool)
    others[at] = False

    def filled(some, rest):
        values = np.empty(len(others), dtype=rest.dtype)
        values[others], values[at] = rest, some
        return values

    found = filled(zeros, found)
    starts = np.flatnonzero(np.diff(bins.feature.take(found), prepend=-1))
    lengths = np.diff(starts, append=len(found))
    longest = int(lengths.max())
    cell = np.arange(len(found)) + np.repeat(np.arange(len(starts)) * longest - starts, lengths)  # of a table, a feature a line

    def running(j):
        table = np.zeros(len(starts) * longest)
        table[cell] = filled(zero[:, j], stats[:, j])
        return np.cumsum(table.reshape(-1, longest), axis=1).ravel().take(cell)

    n, x = running(0), running(1)
    more = total[0] - n
    gain = x * x / n + (total[1] - x) ** 2 / np.where(more > 0, more, 1) - total[1] ** 2 / total[0]
    gain[more <= 0] = -np.inf
    top = gain.max()
    if not top > 0:
        return []
    i = int(np.flatnonzero(gain >= top - NOISE * total[2])[0])
    first = starts[np.searchsorted(starts, i, side="right") - 1]
    squares = np.cumsum(filled(zero[:, 2], stats[:, 2])[first:i + 1])[-1]
    return [(node, float(gain[i]), int(found[i]), [float(n[i]), float(x[i]), float(squares)])]


def _added(pairs: Iterator) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The tasks' sums of one range of features: by node, and the keys and sums by (node, bin)."""
    # in the order of the tasks, so that equal inputs give equal sums
    got = sorted((value for _, value in pairs), key=itemgetter(0))
    if len(got) == 1:
        return got[0][1:]
    return got and (sum(g[1] for g in got), *summed(np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got]))) or None


def with_larger(found: tuple, before: tuple, larger: dict[int, tuple[int, int]], n_bins: int) -> tuple:
    """``found`` plus the sums of the nodes in ``larger`` (place -> the parent's place in ``before``, the sibling's in
    ``found``): the parent's less the sibling's."""
    if not larger:
        return found

    def of(table, node):
        lo, hi = np.searchsorted(table[1], (node * n_bins, (node + 1) * n_bins))
        return table[1][lo:hi] - node * n_bins, table[2][lo:hi]

    each = []
    for node in range(len(found[0])):
        if node not in larger:
            keys, stats = of(found, node)
        else:
            parent, sibling = larger[node]
            (keys, stats), (less, sums) = of(before, parent), of(found, sibling)
            stats = stats.copy()
            stats[np.searchsorted(keys, less)] -= sums
            there = stats[:, 0] > 0
            if not there.all():
                keys, stats = keys[there], stats[there]
        each.append((keys + node * n_bins, stats))
    return found[0], np.concatenate([k for k, _ in each]), np.concatenate([x for _, x in each])


def _best(pairs: Iterator, bins: Bins):
    found = _added(pairs)
    if found:
        yield found[0], best_splits(*found, bins)


# -- the fit -------------------------------------------------------------------------

class _Growing:
    """A tree as its levels are fitted."""

    def __init__(self):
        self.cut, self.left, self.gain, self.moments = [-1], [-1], [-1.0], [None]

    def tree(self) -> Tree:
        mean = [0.0 if m is None else m[1] / m[0] for m in self.moments]
        return Tree(np.array(self.cut), np.array(self.left), np.array(mean))

    def split(self, node: int, gain: float, cut: int, left: np.ndarray) -> tuple[int, int]:
        child = len(self.cut)
        self.cut[node], self.left[node], self.gain[node] = cut, child, gain / self.moments[node][0]
        self.cut += [-1, -1]
        self.left += [-1, -1]
        self.gain += [-1.0, -1.0]
        self.moments += [left, self.moments[node] - left]
        return child, child + 1


def _spread_out(moments) -> bool:
    n, s, q = moments
    return n > 1 and q - s * s / n > NOISE * q


def _grow(level, max_depth: int) -> _Growing:
    """A tree.  ``level(tree, nodes, larger)`` gives, for each range of features, the moments and the best splits of
    ``nodes``; in ``larger`` (see :func:`with_larger`) are those that are left over from their parents."""
    out, nodes, larger, closed = _Growing(), [0], {}, set()
    for _ in range(max_depth):
        if len(closed) == len(nodes):
            break
        found = level(out.tree(), np.array(nodes), larger)
        for node, moments in zip(nodes, found[0][0]):
            out.moments[node] = moments
        best: dict[int, tuple] = {}
        for slot, gain, cut, left in sorted((b for _, each in found for b in each), key=itemgetter(2)):
            if slot not in best or gain > best[slot][0] + NOISE * found[0][0][slot][2]:
                best[slot] = gain, cut, left
        below, larger_below, closed_below = [], {}, set()
        for slot, (gain, cut, left) in sorted(best.items()):
            whole = out.moments[nodes[slot]]
            if slot in closed or not (gain > NOISE * whole[2] and _spread_out(whole)):
                continue
            few, many = sorted(out.split(nodes[slot], gain, cut, np.array(left)), key=lambda c: out.moments[c][0])
            goes_on = {c for c in (few, many) if _spread_out(out.moments[c])}
            differs = many in goes_on and out.moments[many][2] >= DIFFERENCE * whole[2]
            if differs:  # the sums of the smaller one are needed in any case
                larger_below[many] = slot, few
            for c in sorted(goes_on | ({few} if differs else set())):
                if c not in goes_on:
                    closed_below.add(len(below))
                below.append(c)
        place_of = {c: i for i, c in enumerate(below)}
        nodes, closed = below, closed_below
        larger = {place_of[c]: (parent, place_of[few]) for c, (parent, few) in larger_below.items()}
    return out


def _boost(grow, max_iter: int, step_size: float, grown: list[_Growing], moved) -> None:
    """Adds the trees of ``grow(first)`` to ``grown``; ``moved(step)`` gets each with its weight."""
    for i in range(max_iter):
        grown.append(grow(i == 0))
        moved((step_size if i else 1.0, grown[-1].tree()))


def boost_block(block: Block, bins: Bins, max_iter: int, max_depth: int, step_size: float) -> list[_Growing]:
    """The trees of rows that are one block."""
    grown: list[_Growing] = []
    held = block

    def grow(first: bool) -> _Growing:
        before = None

        def level(tree, nodes, larger):
            nonlocal before
            found = _added(_level_sums(0, iter([held]), [], first, tree, nodes, bins, 1, larger))
            before = with_larger(found, before, larger, len(bins.feature))
            return [(before[0], best_splits(*before, bins))]
        return _grow(level, max_depth)

    def moved(step):
        nonlocal held
        held = held._replace(margin=margins(held, [step], bins))

    _boost(grow, max_iter, step_size, grown, moved)
    return grown


def _boost_in_a_task(packed_blocks: DataFrame, bins, read, *settings) -> list[_Growing]:
    """The trees, fitted by one task that reads all blocks in order; then calls ``read``."""
    def fit(it):
        blocks = [unpacked(r["block"]) for r in it]
        yield pickle.dumps(boost_block(joined(blocks, len(bins.value.feature)), bins.value, *settings))

    ordered = packed_blocks.select("block", F.monotonically_increasing_id().alias("at")).repartition(1).sortWithinPartitions("at").select("block")
    grown = ordered.rdd.mapPartitions(fit).collect()
    read()
    return pickle.loads(grown[0])


def _boost_by_jobs(packed_blocks: DataFrame, bins, read, max_iter: int, max_depth: int, step_size: float) -> list[_Growing]:
    """The trees, a Spark job for every level.  Calls ``read`` when the blocks are made."""
    rows = packed_blocks.rdd.map(lambda r: bytes(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    read()
    parts = rows.getNumPartitions()
    current, grown, trees, recent = rows, [], [], []

    def grow(first: bool) -> _Growing:
        levels = []
        trees_since, blocks = list(recent), current

        def level(tree, nodes, larger):
            def sums(task, it):
                return _level_sums(task, map(unpacked, it), trees_since, first, tree, nodes, bins.value, parts, larger)

            sent = (blocks.mapPartitionsWithIndex(sums).partitionBy(parts, lambda p: p)
                    .mapPartitions(lambda it: [_added(it)]))
            if larger:
                sent = sent.zip(levels[-1]).map(lambda both: with_larger(*both, larger, len(bins.value.feature)))
            levels.append(sent.persist(StorageLevel.MEMORY_AND_DISK))
            return sent.map(lambda found: (found[0], best_splits(*found, bins.value))).collect()
        try:
            return _grow(level, max_depth)
        finally:
            for sent in levels:
                sent.unpersist()
                sent._jrdd.rdd().cleanShuffleDependencies(False)  # a tree's shuffle files are not read again

    def moved(step):
        nonlocal current
        trees.append(step)
        recent.append(step)
        if len(recent) == MARGIN_EVERY and len(trees) < max_iter:
            # from the blocks as cut, so that no chain of cached blocks is needed to make them again
            so_far = list(trees)

            def newer(data):
                block = unpacked(data)
                return packed(block._replace(margin=margins(block, so_far, bins.value)))
            next_ = rows.map(newer).persist(StorageLevel.MEMORY_AND_DISK)
            next_.count()
            if current is not rows:
                current.unpersist()
            current = next_
            recent.clear()

    try:
        _boost(grow, max_iter, step_size, grown, moved)
        return grown
    finally:
        for cached in {current, rows}:
            cached.unpersist()


def fit_entries(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100, max_depth: int = 6,
                step_size: float = 0.3, max_bins: int = 32, seed: int = 42):
    """A ``GBTClassificationModel`` of two classes (``label`` 0 or 1) on sparse vectors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    y = F.col(label).cast("double")
    valid = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.concat(F.lit("labels must be 0 or 1, found "), F.coalesce(y.cast("string"), F.lit("null")))))
    data = df.select(sparse_entries(features).alias("entries"), valid.cast("double").alias("label"), _width(features).alias("width")).persist()
    bins = None
    try:
        n, stored = data.agg(F.count("*"), F.sum(F.size("entries"))).head()
        if not n:
            raise ValueError("no rows to fit on")
        width = int(data.select("width").head()[0])
        bins = sc.broadcast(number_bins({r["idx"]: r["cuts"] for r in fit_cuts(data, n, min(max_bins, n)).collect()}, width))
        parts = max(min(-(-n // TASK_ROWS), sc.defaultParallelism), -(-n // (50 * TASK_ROWS)))
        blocks = data.select("label", "entries").coalesce(parts).mapInArrow(lambda b: _blocks(b, bins.value), "block binary")
        boost = _boost_in_a_task if stored <= TASK_ENTRIES else _boost_by_jobs
        grown = boost(blocks, bins, data.unpersist, max_iter, max_depth, step_size)
        settings = {"maxDepth": max_depth, "maxIter": max_iter, "maxBins": max_bins, "stepSize": step_size, "seed": seed,
                    "featuresCol": features, "labelCol": label}
        return _as_model(spark, grown, bins.value, width, settings)
    finally:
        data.unpersist()
        if bins:
            bins.unpersist()


def _width(features: str):
    v = F.unwrap_udt(features)
    return F.when(v["type"] == 0, v["size"]).otherwise(F.size(v["values"]))


def _as_model(spark, grown: list[_Growing], bins: Bins, width: int, settings: dict):
    """The trees as MLlib's model, written in its saved form (nodes, trees, metadata) and loaded."""
    from pyspark.ml.classification import GBTClassificationModel

    def metadata(kind, name, params, defaults, **more):
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                           "uid": f"{name}_{uuid.uuid4().hex[:12]}", "paramMap": params, "defaultParamMap": defaults, **more})

    nodes = []
    for t, g in enumerate(grown):
        for i, (cut, left, gain, m) in enumerate(zip(g.cut, g.left, g.gain, g.moments)):
            rows, total, squares = map(float, m)
            f = -1 if cut < 0 else int(bins.feature[cut])
            at = [] if cut < 0 else [float(bins.cuts[cut - f])]
            mean = total / rows
            nodes.append((t, (i, mean, squares / rows - mean * mean, [rows, total, squares], int(rows), float(gain), left,
                              -1 if cut < 0 else left + 1, (f, at, -1))))
    shared = {"cacheNodeIds": False, "checkpointInterval": 10, "featuresCol": "features", "impurity": "variance", "labelCol": "label",
              "leafCol": "", "maxBins": 32, "maxDepth": 5, "maxMemoryInMB": 256, "minInfoGain": 0.0, "minInstancesPerNode": 1,
              "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "seed": settings["seed"]}
    whole = {**shared, "featureSubsetStrategy": "all", "lossType": "logistic", "maxIter": 20, "probabilityCol": "probability",
             "rawPredictionCol": "rawPrediction", "stepSize": 0.1, "subsamplingRate": 1.0, "validationTol": 0.01}
    tree_settings = {k: v for k, v in settings.items() if k in shared}
    told = [(t, metadata("regression.DecisionTreeRegressionModel", "dtr", tree_settings, shared), settings["stepSize"] if t else 1.0)
            for t in range(len(grown))]
    path = scratch_path(spark, "boosted-trees")
    spark.createDataFrame(nodes, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:long,"
                          "gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,"
                          "numCategories:int>>").coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(told, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    about = metadata("classification.GBTClassificationModel", "GBTClassifier", settings, whole, numFeatures=width, numTrees=len(grown))
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTClassificationModel.load(path)
