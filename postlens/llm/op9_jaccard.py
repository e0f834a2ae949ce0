"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct n-word shingles.  Two documents whose Jaccard
similarity is at least ``percent``/100 = s differ little: with the shingles in
any one global order, the first |x| - ceil(s|x|) + m of x (its *m-prefix*)
share at least m shingles with the same of y.  That bound drives three steps,
none of which loses a link:

1. *Screen.*  Order: shingle hash.  Every distinct set emits its m-prefix with
   m about a tenth of its size (and one shingle more, since m steps with the
   size); a set of which fewer than m prefix shingles occur in another set's
   prefix cannot be linked and is done.  Nearly all
   documents end here; a prefix shingle is one row, whatever its frequency.
2. *Prefixes.*  The survivors' shingles are counted exactly and ordered rarest
   first.  Each set lengthens its prefix (m = 1, 2, 4, ... ``MAX_MATCH``) while
   that lowers its estimated candidate cost: rows to join, plus verifications,
   of which m shared shingles can make at most rows / m.  Sets meet in the
   groups of their prefix shingles; a pair is verified only when it shares
   min(m_x, m_y) shingles of the min-level prefixes.  A shingle that no other
   survivor has can match nothing, so the sets are compared on the others.
3. *Hubs.*  A group's members are not paired with one another but measured
   against its hub h, the most central member: overlap o_x and difference
   D_x = x - h.  Links to hubs give first components.
4. *Rest.*  Two members x, y that no component joins overlap in at most
   min(o_x, o_y) + |D_x & D_y|.  Let x be the smaller one: it needs 2s|x|/(1+s) of
   its shingles and must meet r_x = 2s|x|/(1+s) - o_x of them in y's difference, so
   it probes the differences of its hub's members with a prefix of its own,
   rarest first.  Where r_x <= 0, it is y, which needs s|y|, that probes.  Members with s|x| <= o_x lie in the
   hub by s of their size, and those not linked to it miss that for their size
   alone: they get a hub among themselves, and steps 3 and 4 are repeated with
   it.  Where few are left (``DIRECT`` pairs per member) they are paired.  All
   pairs found are verified exactly, hence no link between components is lost,
   and within one none is needed.

Equal sets are one node, known by a 128-bit hash of the set, and are never paired.
Shingles are 64-bit hashes.  A document with fewer words than n has
its word sequence as its only shingle; one without words has none and is
linked with nothing.  Defined results: null text is empty; a row with a null key
is no document of a class and keeps a null component; equal keys with unlike
texts are documents of their own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordBatch, if_small, read_table, shared_table, shingle_hashes, slices
from .linking import components, with_components

#: Longest prefix extension, and the cost of one verification in joined rows.
MAX_MATCH, VERIFY_COST = 16, 20
#: Pairs per member of a hub that are compared directly.
DIRECT = 512


def shingle_sets(words: WordBatch, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = words.hashes()
    return [np.unique(shingle_hashes(h[a:b], size)) for a, b in zip(words.starts, words.ends, strict=True)]


def slack(n: int, percent: int) -> int:
    """n - ceil(s n): the shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def screen_match(n: int, percent: int) -> int:
    """m of the screen: about a tenth of the set, at least one."""
    return max(1, min(n - slack(n, percent), n // 10 + 1))


def sets_digest(one: np.ndarray) -> bytes:
    """128-bit digest of a sorted set."""
    return xxhash.xxh3_128_digest(one.tobytes())


def sketch(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, n, digest of the set (null for an empty one), screen prefix."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(WordBatch(part.column("text"), lower=True), size)
            digests = [sets_digest(s) if len(s) else None for s in sets]
            prefix = [s[:slack(len(s), percent) + screen_match(len(s), percent) + 1].view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests, pa.binary()),
                 pa.array([screen_match(len(s), percent) for s in sets], pa.int64()),
                 pa.array(prefix, pa.list_(pa.int64()))],
                names=["id", "n", "node", "m", "prefix"])


def full_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, node, grams: the set's digest (null for an empty one) and the set."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(WordBatch(part.column("text"), lower=True), size)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([sets_digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "node", "grams"])


def choose_prefix(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(node, n, grams: array of (df, gram) that others have, rarest first) -> node, n, weight, m,
    common (these shingles) and the lengths that ``levels`` counts: how many of
    them lie in the prefix of level 1, 2, ...

    ``weight``: how central the set is, the sum of its shingles' frequencies.
    """
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("weight", "m", "common", "levels")}
        grams = batch.column("grams")
        flat, offsets = grams.flatten(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
        dfs, ids = flat.field("df").to_numpy(), flat.field("gram").to_numpy()
        for a, b, n in zip(offsets[:-1], offsets[1:], batch.column("n").to_pylist(), strict=True):
            alone = n - int(b - a)  # rarest first: the shingles that no other has come first
            df = np.concatenate((np.ones(alone, dfs.dtype), dfs[a:b]))
            base = slack(n, percent) + 1
            cost = np.cumsum(df[:base + MAX_MATCH - 1] - 1)  # other sets met by the first i shingles
            best, m = None, 1
            for level in (1, 2, 4, 8, MAX_MATCH):
                if base + level - 1 > n:
                    break
                rows = float(cost[base + level - 2])
                told = rows + VERIFY_COST * rows / level
                if best is None or told < best:
                    best, m = told, level
            out["weight"].append(int(df.sum()))
            out["m"].append(m)
            out["common"].append(ids[a:b])
            out["levels"].append([max(0, base + i - alone) for i in range(m)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("n"), *[pa.array(out[k], pa.int64()) for k in ("weight", "m")],
             *[pa.array(out[k], pa.list_(pa.int64())) for k in ("common", "levels")]],
            names=["node", "n", "weight", "m", "common", "levels"])


def alike(shared: Column, n: Column, other: Column, percent: int) -> Column:
    """Jaccard similarity of at least percent/100 for an overlap and two sizes."""
    return 100 * shared >= percent * (n + other - shared)


def survivors(sets: DataFrame) -> DataFrame:
    """Rows of ``sets`` (row, m, prefix) that pass the screen; ``row`` numbers them.

    A shingle has one row per set at most, of some hundred rows that a set has,
    so that no shingle holds more than a few hundredths of the rows.
    """
    rows = sets.select("row", "m", F.explode("prefix").alias("gram"))
    met = rows.withColumn("sets", F.count("*").over(Window.partitionBy("gram"))).filter("sets > 1")
    return met.groupBy("row", "m").count().filter("count >= m").select("row")


def enough_matches(left: str, right: str) -> Column:
    """Whether two nodes' prefixes of the lower of their levels share that many shingles."""
    m = F.least(F.col(f"{left}.m"), F.col(f"{right}.m")).cast("int")
    x, y = (F.slice(F.col(f"{s}.common"), F.lit(1), F.element_at(F.col(f"{s}.levels"), m).cast("int")) for s in (left, right))
    return F.size(F.array_intersect(x, y)) >= m


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose sets are alike; sets overlap in their common shingles only.
    Where the pairs are few, only their sets are moved."""
    pairs = shared_table(pairs, "pairs")
    x = nodes.alias("x")
    y = nodes.join(if_small(pairs.select(F.col("b").alias("node"))), "node", "left_semi").alias("y")
    both = x.join(if_small(pairs), F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(enough_matches("x", "y"))
    shared = F.size(F.array_intersect("x.common", "y.common"))
    return both.filter(alike(shared, F.col("x.n"), F.col("y.n"), percent)).select("a", "b")


def measured(stars: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``stars`` (hub, node) plus n, in_hub (overlap), rest (the difference,
    rarest first), short and short_up (shingles that a link must find outside the
    hub: any link, and one to a set at least as large) and linked."""
    stars = shared_table(stars, "to_measure")
    hubs = nodes.join(if_small(stars.select(F.col("hub").alias("node"))), "node", "left_semi") \
        .select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("common").alias("hub_common"))
    both = nodes.select("node", "n", "common").join(if_small(stars), "node").join(hubs, "hub")
    both = both.select("hub", "hub_n", "node", "n", F.size(F.array_intersect("common", "hub_common")).cast("long").alias("in_hub"),
                       F.array_except("common", "hub_common").alias("rest"))
    def least(of: int, by: int) -> Column:
        return (F.col("n") * of + (by - 1)) / by  # rounded up below

    short = F.floor(least(percent, 100)).cast("long") - F.col("in_hub")
    short_up = F.floor(least(2 * percent, 100 + percent)).cast("long") - F.col("in_hub")
    return both.select("hub", "node", "n", "in_hub", "rest", short.alias("short"), short_up.alias("short_up"),
                       alike(F.col("in_hub"), F.col("n"), F.col("hub_n"), percent).alias("linked"))


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether two measured members of one hub can be linked across components."""
    most = F.least(F.col(f"{x}.in_hub"), F.col(f"{y}.in_hub")) + F.least(F.size(f"{x}.rest"), F.size(f"{y}.rest"))
    return (F.col(f"{x}.comp") != F.col(f"{y}.comp")) & alike(most, F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _ordered(x: str, y: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def probes(stars: DataFrame) -> DataFrame:
    """Shingles outside the hub of the measured members: hub, gram, node, comp, n, in_hub, size;
    whether the member asks larger ones with it (up), or smaller ones that lie in the hub (down), or
    only holds it; and whether it lies in the hub as the smaller one (inside)."""
    slim = stars.filter(F.size("rest") >= F.col("short")).select(
        "hub", "node", "comp", "n", "in_hub", "short", "short_up", F.size("rest").alias("size"), F.posexplode("rest").alias("at", "gram"))
    return slim.select("hub", "gram", "node", "comp", "n", "in_hub", "size",
                       ((F.col("short_up") > 0) & (F.col("at") <= F.col("size") - F.col("short_up"))).alias("up"),
                       ((F.col("short") > 0) & (F.col("at") <= F.col("size") - F.col("short"))).alias("down"),
                       (F.col("short_up") <= 0).alias("inside"))


def probed_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one hub that meet in their differences from it."""
    rows = probes(stars)
    x, y = rows.filter("up or down").alias("x"), rows.alias("y")
    asked = (F.col("x.up") & (F.col("y.n") >= F.col("x.n"))) | (F.col("x.down") & F.col("y.inside") & (F.col("y.n") <= F.col("x.n")))
    most = F.least("x.in_hub", "y.in_hub") + F.least("x.size", "y.size")
    met = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.gram") == F.col("y.gram"))
                 & (F.col("x.comp") != F.col("y.comp")) & asked & alike(most, F.col("x.n"), F.col("y.n"), percent))
    return _ordered("x.node", "y.node", met)


def rest_links(stars: DataFrame, links: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``links`` (a, b) plus those across the components that the hubs of ``stars`` (measured) leave open."""
    while True:
        marked = shared_table(with_components(stars, components(links)), "marked")
        found = shared_table(verified(probed_pairs(marked, percent), known, percent), "probed")
        links = links.unionByName(found)
        # Members that lie in their hub; those that are not linked to it are open.
        inside = marked.filter("short <= 0")
        hub_comp = inside.filter("linked").groupBy("hub").agg(F.max("comp").alias("hub_comp"))
        apart = inside.join(hub_comp, "hub", "left").filter("not linked and (hub_comp is null or comp != hub_comp)").drop("hub_comp")
        apart = shared_table(apart, "open")
        sizes = inside.groupBy("hub").agg(F.count("*").alias("members")).join(
            apart.groupBy("hub").agg(F.count("*").alias("open"), F.max(F.struct("in_hub", "node")).alias("next")), "hub")
        sizes = shared_table(sizes.select("hub", "members", "open", F.col("next.node").alias("next")), "sizes")
        few = sizes.filter(F.col("open") <= DIRECT).select("hub")
        u, v = apart.join(few, "hub").alias("u"), inside.alias("v")
        direct = u.join(v, (F.col("u.hub") == F.col("v.hub")) & may_link("u", "v", percent))
        links = links.unionByName(shared_table(verified(_ordered("u.node", "v.node", direct), known, percent), "direct"))
        many = sizes.filter(F.col("open") > DIRECT).select("hub", "next")
        if not many.limit(1).count():
            return links
        again = inside.select("hub", "node").join(many, "hub").filter("node != next").select(F.col("next").alias("hub"), "node").distinct()
        stars = shared_table(measured(again, known, percent), "stars")
        links = links.unionByName(stars.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))


def link_classes(nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, comp) of the linked nodes among the distinct sets ``nodes`` (row, node,
    id, n, m, prefix); ``texts`` (id, text) has the text of each set under its id.

    Shingles travel with the number of a set's row, which is a third of a digest's bytes.
    """
    alive = nodes.select("row", "node", "id", "n").join(survivors(nodes), "row", "left_semi")
    kept = shared_table(alive.groupBy("node", "id").agg(
        F.min("row").alias("number"), F.max("n").alias("n"), F.count("*").alias("rows")), "survivors")

    id_type = texts.schema["id"].dataType.simpleString()

    def sets_of(keys: DataFrame) -> DataFrame:
        own = texts.join(if_small(keys.select("id")), "id", "left_semi").select("id", "text")
        sets = own.mapInArrow(lambda it: full_sets(it, size), f"id {id_type}, node binary, grams array<long>")
        return sets.join(if_small(keys.select("id", "node", "number", "n")), ["id", "node"]) \
            .select(F.col("number").alias("node"), "n", "grams")

    # Only a set whose key and text are repeated comes out more than once.
    sets = sets_of(kept.filter("rows = 1")).unionByName(sets_of(kept.filter("rows > 1")).dropDuplicates(["node"]))

    # Exact frequencies among the survivors; rarest first.
    rows = sets.select("node", "n", F.explode("grams").alias("gram"))
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).filter("df > 1")
    ordered = counted.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(
        F.col("df").alias("df"), F.col("gram").alias("gram")))).alias("grams"))
    known = shared_table(ordered.mapInArrow(
        lambda it: choose_prefix(it, percent),
        "node long, n long, weight long, m long, common array<long>, levels array<long>"), "known")
    known = known.filter(alike(F.size("common"), F.col("n"), F.size("common"), percent))

    # Hubs: the most central member of each prefix shingle's group.
    entries = known.select("node", "weight", F.explode(F.slice(
        "common", F.lit(1), F.element_at("levels", F.col("m").cast("int")).cast("int"))).alias("gram"))
    entries = shared_table(entries, "prefixes")
    hubs = entries.groupBy("gram").agg(F.max(F.struct("weight", "node")).alias("hub"), F.count("*").alias("size")) \
        .filter("size > 1").select("gram", F.col("hub.node").alias("hub"))
    star = entries.select("gram", "node").join(hubs, "gram").filter("node != hub").select("hub", "node").distinct()
    stars = shared_table(measured(star, known, percent), "stars")
    links = stars.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    found = components(rest_links(stars, links, known, percent))
    named = kept.select(F.col("number").alias("comp"), F.col("node").alias("first"))
    return found.join(kept.select(F.col("number"), F.col("node").alias("digest")), F.col("node") == F.col("number")) \
        .join(named, "comp").select(F.col("digest").alias("node"), F.col("first").alias("comp"))


def jaccard_classes(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id of every row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = shared_table(texts.mapInArrow(
        lambda it: sketch(it, size, percent),
        f"id {texts.schema['id'].dataType.simpleString()}, n long, node binary, m long, prefix array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sketch")
    # One node per distinct set; its text is found under the smallest key.
    full = sketched.filter("node is not null and id is not null")
    least = shared_table(full.groupBy("node").agg(F.min("id").alias("id")), "nodes")
    copies = full.select("node", "id").join(least.withColumnRenamed("id", "first"), "node") \
        .filter("id != first").select("node", "id").distinct()
    nodes = full.select("row", "node", "id", "n", "m", "prefix").join(
        if_small(shared_table(copies, "copies")), ["node", "id"], "left_anti")  # a repeated row may stand twice
    labels = link_classes(nodes, texts, size, percent)
    marked = with_components(least, labels)
    first = marked.groupBy("comp").agg(F.min("id").alias("component_id"))
    classes = marked.join(first, "comp").select("node", "component_id")
    out = sketched.join(classes, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
