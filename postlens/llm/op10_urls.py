"""URL filters: sort-merge range join of urls with nested host/path rules.

A host is keyed by its reversed labels, each closed by a dot (``a.example.org``
-> ``org.example.a.``), so that a rule's host is a *prefix* of the keys of that
host and of all its subdomains: an interval of the sorted key order.  Urls and
rules are dealt to range cells, sorted together by key, and swept once; the
sweep keeps the stack of rules whose interval is open at the current key.

* Cells: every ``rules_per_cell``-th rule key starts a cell, so a cell's rules
  are bounded.  A rule whose interval runs on into later cells is repeated in
  each of them (that is the stack with which the cell opens).
* Hot hosts: a cell's urls are dealt over as many lanes as its share of the
  urls asks for, whatever their hosts; each lane gets the cell's rules.
* Memory of a task: Arrow batches plus the open stack.

Defined results: a null url and one without ``://`` have an empty host and
path and get ``malformed`` as verdict; a url that no rule fits gets
``default``.  Among fitting rules the longest (host and path characters) wins,
then the longer host, then ``block``.  Repeated rows are judged one by one;
extra columns are not read.  Empty tables give empty results; null rules and
rules with null host, path or verdict are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_parallelism, read_table

#: The filter list (host, path, verdict): fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: A url's host is from the first "://" up to one of these, its path up to one of the last two.
HOST_ENDS = "/?#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module docstring defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(batches: Iterator[pa.RecordBatch], default: str, malformed: str) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (cell, lane, key, rules first)."""
    stack: list[tuple[str, dict[str, str], list[int]]] = []  # (host key, path -> verdict, path lengths)
    at = None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("cell", "lane", "key", "is_url", "host", "path", "verdict")}
        ids = batch.column("id")
        kept, rules, verdicts = [], [], []
        for i, key in enumerate(cols["key"]):
            if at != (cols["cell"][i], cols["lane"][i]):
                at, stack = (cols["cell"][i], cols["lane"][i]), []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            path = cols["path"][i]
            if not cols["is_url"][i]:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                paths = stack[-1][1]
                if paths.get(path) != "block":
                    paths[path] = cols["verdict"][i]
                stack[-1][2][:] = sorted({len(p) for p in paths}, reverse=True)
                continue
            best = None
            for open_key, paths, lengths in stack:
                for n in lengths:
                    if n <= len(path) and path[:n] in paths:
                        labels = open_key[:-1].split(".")
                        found = (len(open_key) - 1 + n, len(open_key), ".".join(reversed(labels)) + path[:n],
                                 paths[path[:n]])
                        best = found if best is None or found[:2] > best[:2] else best
                        break
            kept.append(i)
            rules.append(best[2] if best else None)
            verdicts.append(best[3] if best else default if cols["host"][i] else malformed)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(kept, pa.int64())), pa.array([cols["host"][i] for i in kept], pa.string()),
             pa.array([cols["path"][i] for i in kept], pa.string()), pa.array(rules, pa.string()),
             pa.array(verdicts, pa.string())],
            names=["id", "host", "path", "rule", "verdict"])


def cell_starts(rules: DataFrame, rules_per_cell: int) -> list[str]:
    """Keys that open a cell: about every ``rules_per_cell``-th distinct rule key.

    Returns (distinct keys / rules_per_cell) strings.  The keys are cut by range
    partitions, so that no task sorts them all.
    """
    keys = rules.select("key").distinct()
    cells = keys.count() // rules_per_cell
    if cells < 1:
        return []
    first = (keys.repartitionByRange(cells + 1, "key").withColumn("part", F.spark_partition_id())
             .groupBy("part").agg(F.min("key").alias("key")))
    return sorted(r["key"] for r in first.collect())[1:]


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", malformed: str = "block", rules_per_cell: int = 100_000,
               urls_per_lane: int = 200_000) -> DataFrame:
    """Verdict of every url of ``urls`` under ``rules`` (host, path, verdict).

    Returns ``id_col``, host, path, rule (host and path of the winning rule, or
    null), verdict.
    """
    spark = urls.sparkSession
    rules = (rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
             .withColumn("key", host_key(F.col("host"))).distinct())
    starts = cell_starts(rules, rules_per_cell)
    borders = F.array(*[F.lit(s) for s in starts]) if starts else F.expr("array()").cast("array<string>")

    def cell_of(key: Column) -> Column:
        return F.size(F.filter(borders, lambda b: b <= key)) if starts else F.lit(0)

    host, path = split_url(F.col(url_col))
    keyed = (urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
             .withColumn("key", host_key(F.col("host"))).withColumn("cell", cell_of(F.col("key"))))
    # Lanes by cell: the counts are one row per cell.
    counts = {r["cell"]: r["count"] for r in keyed.groupBy("cell").count().collect()}
    total, tasks = max(1, sum(counts.values())), default_parallelism(spark)
    lanes = {c: max(1, -(-n // urls_per_lane), -(-n * tasks // total)) for c, n in counts.items()}
    lane_of = F.lit(1)
    if len(set(lanes.values())) > 1:
        lane_of = F.element_at(F.create_map(*[F.lit(x) for kv in lanes.items() for x in kv]), F.col("cell"))
    elif lanes:
        lane_of = F.lit(next(iter(lanes.values())))
    # The lane is dealt by the url's place in its scan task, so that repeated rows part, too.
    dealt = keyed.withColumn("lane", F.pmod(F.monotonically_increasing_id(), lane_of).cast("int"))

    # A rule goes to its own cell and to those that begin inside its interval.
    inside = (F.filter(F.sequence(F.lit(1), F.lit(len(starts))),
                       lambda i: F.startswith(F.element_at(borders, i.cast("int")), F.col("key")))
              if starts else F.expr("array()").cast("array<int>"))
    placed = rules.withColumn("cell", F.explode(F.array_distinct(F.concat(F.array(cell_of(F.col("key"))), inside))))
    placed = placed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.coalesce(lane_of, F.lit(1)).cast("int") - 1)))

    cols = ["id", "host", "path", "key", "cell", "lane", "verdict", "is_url"]
    rows = dealt.select("id", "host", "path", "key", F.col("cell").cast("int").alias("cell"), "lane",
                        F.lit(None).cast("string").alias("verdict"), F.lit(True).alias("is_url"))
    rows = rows.unionByName(placed.select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "host", "path", "key",
        F.col("cell").cast("int").alias("cell"), "lane", "verdict", F.lit(False).alias("is_url"))).select(cols)
    rows = rows.repartition(default_parallelism(spark), "cell", "lane").sortWithinPartitions("cell", "lane", "key", "is_url")
    id_type = rows.schema["id"].dataType.simpleString()
    judged = rows.mapInArrow(lambda it: sweep(it, default, malformed),
                             f"id {id_type}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_col)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

SQL = f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (
  SELECT page_id, max_by(struct_pack(rule := r_host || r_path, verdict := r_verdict),
                         length(r_host || r_path)) AS best
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT p.page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""

QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE_SQL = {"op10_url_filter": SQL}
