"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import emptied, written


#: A round's tasks: one for so many rows, and so many at least. Small tables don't leave files of a few rows in every
#: shuffle partition.
ROWS, TASKS = 200_000, 16


def _are_stars(links: DataFrame, tasks: int) -> bool:
    """Whether every a has one b, and no b is an a: the links then name each node's component."""
    a, b = (links.select(F.col(c).alias("node"), F.lit(int(c == "a")).alias("up"), F.lit(c == "b").alias("root")) for c in ("a", "b"))
    seen = a.unionByName(b).groupBy("node").agg(F.sum("up").alias("up"), F.bool_or("root").alias("root"))
    return seen.where("up > 1 or up = 1 and root").coalesce(tasks).count() == 0


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), itself included.

    Each round hangs every node's larger neighbours on its smallest one and then its smaller neighbours likewise
    (large star, small star); the number of rounds grows with the logarithm of a component's size. Rounds end when
    the edges are stars around the smallest nodes; edges that are so from the start take none. Every round is written
    to the shared folder. Nodes must be longs. A hub's neighbours are aggregated to their minimum, never listed.
    """
    links = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tasks = max(TASKS, 2 * links.count() // ROWS)  # later rounds have no more than twice the edges
    while not _are_stars(links, tasks):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
        old, links = links, written(hung.coalesce(tasks).distinct().coalesce(tasks))
        emptied(old, large)
    root = links.select("a", F.col("b").alias("root"))
    return nodes.join(root, nodes.node == root.a, "left").select("node", F.coalesce("root", "node").alias("component"))


def merged(component: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after further edges (a, b) between the nodes: only the components are connected anew."""
    ends = edges
    for c in ("a", "b"):
        ends = ends.join(component.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c)
    labels = component.select(F.col("component").alias("node")).distinct()
    wide = components(labels, ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return component.join(wide.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component").select("node", F.col("whole").alias("component"))
