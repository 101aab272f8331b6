"""Merging of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, tables


def merge_list(edges: DataFrame) -> DataFrame:
    """(component, step, a, b, total, average) from (a, b, score), a <> b: within each connected component the two groups with
    the greatest total score merge, of equal totals those of the smallest names, again and again; the merged group keeps
    the smaller name a. average is the total over the product of both sizes. Repeated edges and both directions add up.

    Rounds of contraction. In each, every component merges its best pair, and with it all pairs whose total is greater than
    the sum of all other totals at either end: whatever merges elsewhere, no sum can overtake these, so they merge at just
    this total. Totals are then added up again. Steps are numbered at the end. A round merges every such pair of a
    component, at least one; where one group keeps growing, as in dense graphs, there are as many rounds as merges.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").cast("double").alias("total"))
    e = graph.written(e.groupBy("a", "b").agg(F.sum("total").alias("total")))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    one = F.lit(1).cast("long")
    left = graph.written(e.join(graph.components(nodes, e), F.col("a") == F.col("node")).select("component", "a", "b", "total", one.alias("na"), one.alias("nb")))
    merges = []
    while not left.isEmpty():
        chosen = graph.written(_certain(left))
        merges.append(chosen)
        left = graph.written(_contracted(left, chosen))
    if not merges:
        return left.select("component", one.alias("step"), "a", "b", "total", F.lit(0.0).alias("average"))
    return _numbered(graph.written(tables.merge(*merges)))


def _certain(edges: DataFrame) -> DataFrame:
    """The best edge of each component, and those that outweigh all others at both ends together; no two share an end."""
    ends = edges.select(F.col("a").alias("x"), "total").unionByName(edges.select(F.col("b").alias("x"), "total"))
    weight = ends.groupBy("x").agg(F.sum("total").alias("w"))
    a, b = weight.select(F.col("x").alias("a"), F.col("w").alias("_wa")), weight.select(F.col("x").alias("b"), F.col("w").alias("_wb"))
    best = edges.groupBy("component").agg(F.min(F.struct((-F.col("total")).alias("t"), "a", "b")).alias("_m")).select("component", F.col("_m.a").alias("_ma"), F.col("_m.b").alias("_mb"))
    alone = (2 * F.col("total") > F.col("_wa")) & (2 * F.col("total") > F.col("_wb"))
    first = (F.col("a") == F.col("_ma")) & (F.col("b") == F.col("_mb"))
    return edges.join(a, "a").join(b, "b").join(best, "component").where(alone | first).select(*edges.columns)


def _contracted(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """edges between the groups after the merges, equal ones added up."""
    grown = chosen.select("a", "b", (F.col("na") + F.col("nb")).alias("n"))
    ends = grown.select(F.col("a").alias("old"), F.col("a").alias("new"), "n").unionByName(grown.select(F.col("b").alias("old"), F.col("a").alias("new"), "n"))
    out = edges.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        out = out.join(ends.select(F.col("old").alias(side), F.col("new").alias(f"_{side}"), F.col("n").alias(f"_n{side}")), side, "left")
        out = out.withColumns({side: F.coalesce(f"_{side}", side), f"n{side}": F.coalesce(f"_n{side}", f"n{side}")}).drop(f"_{side}", f"_n{side}")
    turned = F.col("a") > F.col("b")
    flat = out.select("component", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
    return flat.groupBy("component", "a", "b").agg(F.sum("total").alias("total"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def _numbered(merges: DataFrame) -> DataFrame:
    """merges with steps. A merge waits for those that formed its two groups, so it comes when the latest of all merges below
    it has come, and then at once; merges that wait for the same one come by size, the inner before the outer. The latest
    below is spread upwards by doubling: the rounds grow with the logarithm of the deepest nesting. b names a merge."""
    w = W.partitionBy("component", "a").orderBy("na")
    key = F.struct((-F.col("total")).alias("t"), F.col("a").alias("a"), F.col("b").alias("b"))
    nodes = merges.withColumns({"_next": F.lead("b").over(w), "_key": key})
    ended = nodes.where("_next is null").select("component", "b", "a")
    taken = nodes.select("component", F.col("b").alias("_absorbed"))
    up = ended.join(taken, (ended.component == taken.component) & (ended.a == taken._absorbed)).select(ended.component, ended.b, F.col("_absorbed").alias("_into"))
    state = graph.written(nodes.join(up, ["component", "b"], "left").select("component", "b", F.coalesce("_next", "_into").alias("up"), F.col("_key").alias("late")))
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy("component", F.col("up").alias("b")).agg(F.max("late").alias("_below"))
        above = state.select("component", F.col("b").alias("up"), F.col("up").alias("_up"))
        state = graph.written(state.join(below, ["component", "b"], "left").join(above, ["component", "up"], "left").select("component", "b", F.col("_up").alias("up"), F.greatest("late", F.coalesce("_below", "late")).alias("late")))
    placed = merges.join(state.select("component", "b", "late"), ["component", "b"]).withColumn("_size", F.col("na") + F.col("nb"))
    order = [F.col("late"), F.col("_size")]
    steps = tables.running(placed, ["component"], order, {"_before": F.lit(1)})
    return steps.select("component", (F.col("_before") + 1).cast("long").alias("step"), "a", "b", "total", (F.col("total") / (F.col("na") * F.col("nb"))).alias("average"))
