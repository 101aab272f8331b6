"""Iterative operators on node and edge tables. Every round is written to the shared folder, which cuts the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (where unset: a new local one, for one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, without loops, each once."""
    e = edges.select("a", "b").where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b).

    Labels spread as minima over the edges and are then shortened through the label's own label, so the number of
    rounds grows slowly with a component's width.
    """
    links = written(both_ways(edges))
    labels = written(nodes.select("node", F.col("node").alias("component")))
    while True:
        least = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(least, labels.node == least.a, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("top"))
        nxt = written(spread.join(up, "component", "left").select("node", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        labels = nxt.select("node", "component")
        if nxt.where("component <> was").isEmpty():
            return labels


def first_independent_set(nodes: DataFrame, edges: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """The nodes kept by walking the list in order (node, rank) and dropping each kept node's neighbours.

    keep: nodes that come before all others. In a round every node is kept all of whose earlier neighbours are
    dropped; the result equals the sequential walk.
    """
    ranked = nodes.select("node", F.struct(F.lit(1).alias("late"), "rank", "node").alias("rank"))
    if keep is not None:
        first = keep.select("node", F.lit(True).alias("first")).distinct()
        ranked = nodes.join(first, "node", "left").select("node", F.struct(F.when(F.col("first"), 0).otherwise(1).alias("late"), "rank", "node").alias("rank"))
    ranked = written(ranked)
    rank_a, rank_b = ranked.select(F.col("node").alias("a"), F.col("rank").alias("rank_a")), ranked.select(F.col("node").alias("b"), F.col("rank").alias("rank_b"))
    open_edges = written(both_ways(edges).join(rank_a, "a").join(rank_b, "b").where("rank_a < rank_b").select("a", "b"))  # from earlier to later
    undecided, kept = ranked.select("node"), None
    while True:
        now = written(undecided.join(open_edges.select(F.col("b").alias("node")), "node", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        dropped = open_edges.join(now, open_edges.a == now.node, "left_semi").select(F.col("b").alias("node")).distinct()
        undecided = written(undecided.join(now, "node", "left_anti").join(dropped, "node", "left_anti"))
        if undecided.isEmpty():
            return kept
        alive = undecided.select(F.col("node").alias("x"))
        open_edges = written(open_edges.join(alive, open_edges.a == alive.x, "left_semi").join(alive, open_edges.b == alive.x, "left_semi"))


def independent_sets(nodes: DataFrame, edges: DataFrame, thresholds: list[float], strict: bool = False) -> DataFrame:
    """(threshold, node): first_independent_set for each threshold, over the edges (a, b, score) of at least (strict: over)
    that score. All thresholds go through the same rounds, and the edges, which should be a written table, are read once;
    each is there once for every threshold that it reaches."""
    at = F.array(*map(F.lit, thresholds))
    reached = F.filter(at, lambda x: F.col("score") > x if strict else F.col("score") >= x)
    each = edges.select("a", "b", F.explode(reached).alias("t")).select(F.struct("t", F.col("a").alias("n")).alias("a"), F.struct("t", F.col("b").alias("n")).alias("b"))
    every = nodes.select("node", "rank", F.explode(at).alias("t")).select(F.struct("t", F.col("node").alias("n")).alias("node"), "rank")
    return first_independent_set(every, each).select(F.col("node.t").alias("threshold"), F.col("node.n").alias("node"))


def greedy_cover(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(rep, member): again and again the node with most neighbours left (itself counted; of equal ones the least)
    becomes a representative and leaves with its neighbours, while that count is at least `least`.

    In a round every node is picked that is first among all within two steps; such picks don't affect each other, so
    the result equals one pick at a time.
    """
    links = written(both_ways(edges))
    left, out = nodes.select("node"), None
    while True:
        degree = left.join(links.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")), "node", "left")
        order = written(degree.select("node", F.struct((-(F.coalesce("d", F.lit(0)) + 1)).alias("d"), F.col("node").alias("id")).alias("o")).where(f"-o.d >= {least}"))
        if order.isEmpty():
            return out if out is not None else nodes.select(F.col("node").alias("rep"), F.col("node").alias("member")).limit(0)

        def nearest(of: DataFrame) -> DataFrame:
            near = links.join(of, links.b == of.node).groupBy(F.col("a").alias("node")).agg(F.min("o").alias("near"))
            return of.join(near, "node", "full").select("node", F.least("o", "near").alias("o"))

        first = nearest(nearest(order)).withColumnRenamed("o", "best")
        picks = written(order.join(first, "node").where("o = best").select(F.col("node").alias("rep")))
        taken = picks.join(links, picks.rep == links.a).select("rep", F.col("b").alias("member")).unionByName(picks.select("rep", F.col("rep").alias("member")))
        taken = written(taken)
        out = taken if out is None else out.unionByName(taken)
        gone = taken.select(F.col("member").alias("x")).distinct()
        left = written(left.join(gone, left.node == gone.x, "left_anti"))
        links = written(links.join(gone, links.a == gone.x, "left_anti").join(gone, links.b == gone.x, "left_anti"))
