"""Ways up and down in forests of narrow (group, node, parent) rows, by doubling.

Round k joins with links that are 2 ** k steps long and doubles them, so a chain of
any length takes a logarithmic number of rounds and nothing is cut off.  Each round is
checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.session import checkpointed


def _doubled(links: DataFrame, group: str) -> DataFrame:
    """Links of twice the length."""
    far = links.select(F.col(group).alias("__g"), F.col("node").alias("__n"), F.col("parent").alias("__p"))
    return links.join(far, (F.col(group) == F.col("__g")) & (F.col("parent") == F.col("__n"))).select(group, "node", F.col("__p").alias("parent")).distinct()


def above(edges: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """``group, node, depth``: the starts that are nodes (depth 0) and all nodes above them, with every number of steps that leads there.

    ``edges``: ``group, node, parent`` (null at a root).  A parent that is no
    node ends the way.  On a way that runs into a cycle depths go on until they
    reach the number of nodes.
    """
    nodes = checkpointed(edges.select(group, "node", "parent").distinct())
    largest = nodes.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    known = nodes.select(group, "node").distinct()
    links = checkpointed(nodes.where("parent is not null").join(known.select(group, F.col("node").alias("parent")), [group, "parent"], "left_semi").select(group, "node", "parent"))
    seen = checkpointed(starts.select(group, "node").distinct().join(known, [group, "node"], "left_semi").withColumn("depth", F.lit(0).cast("long")))
    step = 1
    while step <= largest and links.take(1):
        way = links.select(F.col(group).alias("__g"), F.col("node").alias("__n"), "parent")
        up = seen.join(way, (F.col(group) == F.col("__g")) & (F.col("node") == F.col("__n"))).select(group, F.col("parent").alias("node"), (F.col("depth") + step).alias("depth"))
        seen = checkpointed(seen.unionByName(up).distinct())
        step *= 2
        if step <= largest:
            links = checkpointed(_doubled(links, group))
    return seen


def ends(links: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    """``group, node, end``: where each start comes to when it follows ``links`` (``group, node, parent``; one a node) as far as they go.

    A start on a way into a cycle comes to some node of the cycle.
    """
    at = checkpointed(starts.select(group, "node", F.col("node").alias("end")).distinct())
    links = checkpointed(links.select(group, "node", "parent"))
    largest = links.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step < 2 * largest:
        # the longest links first would need them all at once; a link is followed whenever one of its length is there
        way = links.select(F.col(group).alias("__g"), F.col("node").alias("__n"), "parent")
        at = checkpointed(at.join(way, (F.col(group) == F.col("__g")) & (F.col("end") == F.col("__n")), "left").select(group, "node", F.coalesce("parent", "end").alias("end")))
        far = links.select(F.col(group).alias("__g"), F.col("node").alias("__n"), F.col("parent").alias("__p"))
        # a link that can't be doubled stays as long as it is: the way ends there
        links = checkpointed(links.join(far, (F.col(group) == F.col("__g")) & (F.col("parent") == F.col("__n")), "left").select(group, "node", F.coalesce("__p", "parent").alias("parent")))
        step *= 2
    return at
