"""Components of links and the pairs that groups ask to compare.

Groups (rows ``gid``, ``node``) say which nodes may be linked.  Comparing all
pairs of a group grows with the square of its size, so work goes in rounds:

1. *stars*: every node of a group is compared with the group's hub, its most
   central node; true links merge components.
2. *rest*: what is left to compare are nodes of one group in different
   components (copies of one text have met in their hub by then).

Since only nodes of one component are never compared, every link between
components is found: the components are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, comp): the smallest node reachable.

    Label propagation with pointer jumping: a node takes the smallest label
    among its neighbours' and its label's label, until nothing changes.  Each
    round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = shared_table(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp"))
    labels = shared_table(labels, "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = shared_table(step.join(jump, "next").select(
            "node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")), "labels")
        labels = moved.select("node", "comp")
        if not moved.filter("moved").limit(1).count():
            return labels


def with_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (node, ...) plus comp; a node without links is its own component."""
    return nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
