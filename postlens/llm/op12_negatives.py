"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Vectors are lifted to one sphere: x becomes (x, sqrt(M^2 - |x|^2)) with M the
largest norm, a query q becomes (q, 0).  Inner products stay as they are, and a
larger one is a smaller angle, so that "the highest scores" and "the scores of
a window" are balls and annuli of a metric, the angle.

*Tree.*  A node has up to ``ARITY`` split points, far from one another; a
vector goes to the nearest one's subtree (the hyperplanes between the split
points).  Every split point i stores, for every sibling subtree j, the range of
its angles to the vectors in j.  The split points come from a bounded sample
(the ``SAMPLE`` rows with the smallest hash of the key, ties by row); ranges and
leaves cover all rows.  A leaf is cut into blocks of about equal size by a hash
of the row, so that many copies of one vector are spread over tasks.

*Search.*  The angle from q to any vector of subtree j is at least
max(D_i - hi_ij, lo_ij - D_i) and at most min(D_i + hi_ij, 2 pi - D_i - lo_ij)
for every split point i at angle D_i from q.  A subtree whose interval misses
the annulus is eliminated; leaves are exact.  First the positives: the ball is
that of the k-th best score among the split points of the anchor's label.  Then
the negatives: the annuli of all windows of an anchor, in one pass.

No row is left out by the tree, so the result is exact whatever the sample.
How many subtrees are eliminated depends on the data: clusters are, vectors
spread evenly over 64 dimensions hardly (README has figures).  Blocks and
anchors meet by a shuffle on (leaf, block): a task holds one block of at most
some ``MAX_LEAF`` rows and ``ANCHORS`` anchors at a time.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as padded with zeros; every row
is a row of its own, so a repeated key is another row, and each is an anchor;
null keys are no anchors and come last among ties; rows with equal scores and
keys are in the order of the written table; a window above a negative score
is empty; an empty table gives an empty result; extra columns are not read.
Scores beyond 64 bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_parallelism, read_table, shared_table

#: Split points of a node, rows that the tree is fitted on, least and most rows of a leaf, anchors of one product.
ARITY, SAMPLE, MIN_LEAF, MAX_LEAF, ANCHORS = 8, 4096, 512, 32_768, 64
#: Tolerance of the pruning in radians (rounding of arc cosines).
EPS = 1e-6
#: Score windows: 80 * positive <= 100 * negative <= 100 * positive (fixed values of the contract).
LOW, HIGH = 80, 100


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows of int64, padded with zeros."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


class Tree:
    """Split points, ranges and leaves; small, and the same at every size of the table beyond the sample."""

    def __init__(self, dims: int, norm2: float, wide: bool):
        self.dims, self.norm2, self.wide = dims, max(norm2, 1.0), wide
        self.splits: list[np.ndarray] = []  # by node: unit vectors
        self.children: list[list[int]] = []  # by node and split point: a node, or -1 - leaf
        self.low: list[np.ndarray] = []  # by node: angles from split point i to subtree j
        self.high: list[np.ndarray] = []
        self.leaves = 0
        self.blocks: np.ndarray | None = None
        self.points = np.zeros((0, dims), np.int64)  # the split points as rows, their labels and row numbers
        self.labels = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """Operand of an exact product: doubles where they hold every sum, else integers."""
        return x if self.wide else x.astype(np.float64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))
        return np.column_stack([x, rest]) / np.sqrt(self.norm2)

    def fit(self, x: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        """Split the sample until a node has at most ``leaf`` of its rows or one distinct vector."""
        unit = self.lift(x)
        used: list[int] = []
        queue = [(None, 0, np.arange(len(x)))]  # parent node, position there, rows
        while queue:
            parent, at, mine = queue.pop()
            chosen = _spread_points(unit[mine], ARITY) if len(mine) > leaf else []
            if len(chosen) < 2:
                name = -1 - self.leaves
                self.leaves += 1
            else:
                name = len(self.splits)
                split = unit[mine[chosen]]
                used += mine[chosen].tolist()
                self.splits.append(split)
                self.children.append([0] * len(chosen))
                self.low.append(np.full((len(chosen),) * 2, np.inf))
                self.high.append(np.full((len(chosen),) * 2, -np.inf))
                nearest = np.argmax(unit[mine] @ split.T, axis=1)
                queue += [(name, j, mine[nearest == j]) for j in range(len(chosen))]
            if parent is not None:
                self.children[parent][at] = name
        self.points, self.labels, self.rows = x[used], labels[used], rows[used]

    def assign(self, x: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
        """The leaf of every row; widens the ranges ``low`` and ``high`` by the rows' angles."""
        out = np.zeros(len(x), np.int64)
        unit = self.lift(x)
        stack = [(0, np.arange(len(x)))] if self.splits else []
        while stack:
            node, mine = stack.pop()
            if not len(mine):
                continue
            near = unit[mine] @ self.splits[node].T
            angles, nearest = np.arccos(np.clip(near, -1, 1)), np.argmax(near, axis=1)
            for j, child in enumerate(self.children[node]):
                here = nearest == j
                if not here.any():
                    continue
                low[node][:, j] = np.minimum(low[node][:, j], angles[here].min(0))
                high[node][:, j] = np.maximum(high[node][:, j], angles[here].max(0))
                if child < 0:
                    out[mine[here]] = -1 - child
                else:
                    stack.append((child, mine[here]))
        return out

    def annulus(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries as unit vectors, and the angles of the scores ``most`` (nearest) and ``least``."""
        q = q.astype(np.float64)
        size = np.sqrt((q * q).sum(1))
        safe = np.where(size > 0, size, 1.0)
        scale = safe * np.sqrt(self.norm2)
        near = np.where(np.isposinf(most), 0.0, np.arccos(np.clip(np.where(np.isposinf(most), 1.0, most / scale), -1, 1)))
        far = np.where(np.isneginf(least), np.pi, np.arccos(np.clip(np.where(np.isneginf(least), -1.0, least / scale), -1, 1)))
        near, far = np.where(size > 0, near, -np.inf), np.where(size > 0, far, np.inf)  # a zero vector tells nothing apart
        return np.column_stack([q / safe[:, None], np.zeros(len(q))]), near, far

    def visited(self, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a leaf may hold a vector whose score with q lies in [least, most]: queries x leaves."""
        out = np.zeros((len(q), self.leaves), bool)
        if not self.splits:
            out[:] = True
            return out
        unit, near, far = self.annulus(q, least, most)
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, mine = stack.pop()
            d = np.arccos(np.clip(unit[mine] @ self.splits[node].T, -1, 1))
            for j, child in enumerate(self.children[node]):
                low, high = self.low[node][:, j], self.high[node][:, j]
                if not np.isfinite(high[0]):
                    continue  # no row
                at_least = np.maximum(d - high, low - d).max(1)
                at_most = np.minimum(d + high, 2 * np.pi - d - low).min(1)
                kept = mine[(at_least <= far[mine] + EPS) & (at_most >= near[mine] - EPS)]
                if child < 0:
                    out[kept, -1 - child] = True
                elif len(kept):
                    stack.append((child, kept))
        return out


def _spread_points(unit: np.ndarray, k: int) -> list[int]:
    """Up to k rows far from one another: the first, then always the one farthest from those taken."""
    taken = [0]
    near = unit @ unit[0]
    while len(taken) < k:
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-12:
            break
        taken.append(far)
        near = np.maximum(near, unit @ unit[far])
    return taken


def integer_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, embedding) that take part, as row, vec_id, label, v: components floor(256 x)."""
    good = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("label").cast("long").alias("label"),
                       F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def fit_tree(rows: DataFrame) -> tuple[Tree, DataFrame] | None:
    """The tree over ``rows`` (written, of :func:`integer_rows`) and the rows with their leaf and block; None without rows."""
    spark = rows.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(squares).alias("norm2")).head()
    if not facts["n"]:
        return None
    if facts["norm2"] >= 2.0 ** 63:  # bounds every inner product
        raise ValueError("inner products beyond 64 bits")
    tree = Tree(facts["dims"], facts["norm2"], wide=facts["norm2"] >= 2.0 ** 52)
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).toArrow()
    target = min(MAX_LEAF, max(MIN_LEAF, facts["n"] // (2 * default_parallelism(spark))))
    x = matrix(sample.column("v").combine_chunks(), tree.dims)
    tree.fit(x, sample.column("label").to_numpy(), sample.column("row").to_numpy(), max(1, SAMPLE * target // max(SAMPLE, facts["n"])))

    names = ["row", "vec_id", "label", "v", "leaf", "node", "i", "j", "low", "high"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [a.copy() for a in tree.low], [a.copy() for a in tree.high]
        for batch in batches:
            if batch.num_rows:
                leaf = pa.array(tree.assign(matrix(batch.column("v"), tree.dims), low, high))
                none = pa.nulls(batch.num_rows, pa.float64())
                at = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "label", "v")], leaf, at, at, at, none, none],
                                                 names=names)
        told = [(n, i, j, low[n][i, j], high[n][i, j]) for n in range(len(low)) for i in range(len(low[n]))
                for j in range(len(low[n])) if np.isfinite(high[n][i, j])]
        if told:
            nothing = [pa.nulls(len(told), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, *map(pa.array, zip(*told, strict=True))], names=names)

    told = shared_table(rows.mapInArrow(assign, "row long, vec_id long, label long, v array<long>, leaf long, "
                                                "node long, i long, j long, low double, high double"), "leaves")
    # One row per pair of split points of a node, and one per leaf: bounded by the sample.
    for r in told.filter("node is not null").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
    placed = told.filter("row is not null").select("row", "vec_id", "label", "v", "leaf")
    tree.blocks = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        tree.blocks[r["leaf"]] = -(-r["count"] // target)
    blocks = F.element_at(F.lit(tree.blocks.tolist() or [1]), (F.col("leaf") + 1).cast("int"))
    return tree, placed.withColumn("block", F.pmod(F.xxhash64("row"), blocks))


ASK = "leaf long, block long, row long, label long, v array<long>, tops array<long>"


def _asked(batch: pa.RecordBatch, tree: Tree, seen: np.ndarray) -> pa.RecordBatch:
    """A row for every block of every leaf that an anchor visits."""
    at, leaf = np.nonzero(seen & (tree.blocks > 0))
    times = tree.blocks[leaf]
    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, leaf = np.repeat(at, times), np.repeat(leaf, times)
    took = pa.array(at)
    return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), *[batch.column(c).take(took) for c in ("row", "label", "v", "tops")]],
                                      names=["leaf", "block", "row", "label", "v", "tops"])


def ask_positives(batches: Iterator[pa.RecordBatch], tree: Tree, k: int) -> Iterator[pa.RecordBatch]:
    """Anchors -> the leaves within the ball of their k-th best score among the split points of
    their label; ``tops`` holds that score, if there is one."""
    for batch in (b.slice(i, ANCHORS) for b in batches for i in range(0, b.num_rows, ANCHORS)):
        q = matrix(batch.column("v"), tree.dims)
        scores = (tree.exact(q) @ tree.exact(tree.points).T).astype(np.int64)
        label, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "row"))
        mine = (tree.labels == label[:, None]) & (tree.rows != row[:, None])
        found = [np.sort(s[m])[::-1][:k] for s, m in zip(scores, mine, strict=True)]
        tops = [[int(s[-1])] if len(s) == k else [] for s in found]
        least = np.array([t[0] if t else -np.inf for t in tops], float)
        told = batch.set_column(batch.schema.get_field_index("tops"), "tops", pa.array(tops, pa.list_(pa.int64())))
        yield _asked(told, tree, tree.visited(q, least, np.full(len(q), np.inf)))


def windows(tops: list[int]) -> list[tuple[int, int]]:
    """The least and greatest negative score of every positive score."""
    return [(-(-LOW * p // 100), HIGH * p // 100) for p in tops]


def ask_negatives(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Anchors with the scores of their positives -> the leaves that meet the annulus of a window."""
    for batch in (b.slice(i, ANCHORS) for b in batches for i in range(0, b.num_rows, ANCHORS)):
        told = [[w for w in windows(t) if w[0] <= w[1]] for t in batch.column("tops").to_pylist()]
        at = np.repeat(np.arange(batch.num_rows), [len(t) for t in told])
        bounds = np.array([w for t in told for w in t], float).reshape(-1, 2)
        alive = tree.visited(matrix(batch.column("v"), tree.dims)[at], bounds[:, 0], bounds[:, 1])
        seen = np.zeros((batch.num_rows, tree.leaves), bool)
        np.logical_or.at(seen, at, alive)
        yield _asked(batch, tree, seen)


FOUND = "anchor long, at long, score long, vec_id long, row long"


def search(batches: Iterator[pa.RecordBatch], tree: Tree, k: int, negatives: bool) -> Iterator[pa.RecordBatch]:
    """Blocks and the anchors that visit them, sorted by (leaf, block), rows first -> the best k of
    the block for every anchor (``at`` 0), or for every window of it (``at`` its number).

    Order of a block's rows: by key, null keys last, then row; a stable sort by score keeps it for ties.
    """
    key, held, x, asked = None, [], None, []

    def block() -> tuple:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = table.column("vec_id")
        order = np.lexsort((table.column("row").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False),
                            ids.is_null().to_numpy(zero_copy_only=False)))
        table = table.take(pa.array(order))
        return (tree.exact(matrix(table.column("v"), tree.dims)), table.column("label").to_numpy(),
                table.column("row").to_numpy(), table.column("vec_id"))

    def answer(asking: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors, labels, rows, ids = x
        scores = (tree.exact(matrix(asking.column("v"), tree.dims)) @ vectors.T).astype(np.int64)
        anchor, label = (asking.column(c).to_numpy() for c in ("row", "label"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i, tops in enumerate(asking.column("tops").to_pylist()):
            s = scores[i]
            if negatives:
                spans = windows(tops)
                ok = (labels != label[i]) & (s >= min(w[0] for w in spans)) & (s <= max(w[1] for w in spans))
            else:
                spans = [(tops[0] if tops else np.iinfo(np.int64).min, np.iinfo(np.int64).max)]
                ok = (labels == label[i]) & (rows != anchor[i]) & (s >= spans[0][0])
            mine = np.flatnonzero(ok)
            if not len(mine):
                continue
            if not negatives and len(mine) > k:
                mine = mine[s[mine] >= np.partition(s[mine], len(mine) - k)[len(mine) - k]]
            mine = mine[np.argsort(-s[mine], kind="stable")]
            falling = -s[mine]
            for at, (least, most) in enumerate(spans):
                first = np.searchsorted(falling, -most, side="left") if negatives else 0
                stop = np.searchsorted(falling, -least, side="right") if negatives else len(mine)
                best = mine[first:min(stop, first + k)]
                for column, part in zip(out, (np.full(len(best), anchor[i]), np.full(len(best), at), s[best], best), strict=True):
                    column.append(part)
        if out[0]:
            who, at, score, best = (np.concatenate(c).astype(np.int64) for c in out)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(at), pa.array(score), ids.take(pa.array(best)), pa.array(rows[best])],
                                             names=["anchor", "at", "score", "vec_id", "row"])

    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("leaf", "block", "kind")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else ():
            part, here = batch.slice(a, b - a), tuple(keys[a][:2])
            if here != key:
                key, held, x = here, [], None
            if keys[a][2] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if x is None:
                x = block()
            for i in range(0, part.num_rows, ANCHORS):
                yield from answer(part.slice(i, ANCHORS))


def _searched(placed: DataFrame, asked: DataFrame, tree: Tree, k: int, negatives: bool) -> DataFrame:
    """anchor, at, score, vec_id, row, rank: the best k of all blocks."""
    rows = placed.select("leaf", "block", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("tops"))
    asks = asked.select("leaf", "block", F.lit(1).alias("kind"), "row", F.lit(None).cast("long").alias("vec_id"), "label", "v", "tops")
    parts = default_parallelism(placed.sparkSession)
    dealt = rows.unionByName(asks).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    found = dealt.mapInArrow(lambda it: search(it, tree, k, negatives), FOUND)
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, embedding), those whose key ``every`` divides.

    An anchor's positives are its ``positives`` best other rows of its label by
    integer inner product; for each, the ``negatives`` best rows of other labels
    whose score lies in the window under the positive's.
    """
    written = shared_table(integer_rows(rows), "rows")
    fitted = fit_tree(written)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    tree, placed = fitted
    anchors = written.filter(F.col("vec_id") % every == 0)
    asked = anchors.select("row", "label", "v", F.array().cast("array<long>").alias("tops")).mapInArrow(
        lambda it: ask_positives(it, tree, positives), ASK)
    best = shared_table(_searched(placed, asked, tree, positives, False).select(
        "anchor", (F.col("rank") - 1).cast("long").alias("at"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    tops = best.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "positive_score"))),
                                                                      lambda p: p["positive_score"]).alias("tops"))
    asked = anchors.join(tops, "row").select("row", "label", "v", "tops").mapInArrow(lambda it: ask_negatives(it, tree), ASK)
    found = _searched(placed, asked, tree, negatives, True).select(
        "anchor", "at", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(best, ["anchor", "at"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.select("vec_id", moved.alias("label"), "embedding"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL = {"op12_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a JOIN r b ON a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""}
