"""Intervals and features on contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as sq
from . import graph, tables


def standardize(df: DataFrame, left: str, right: str) -> DataFrame:
    """left <= right; strand is - where they were reversed."""
    return df.withColumns({left: F.least(left, right), right: F.greatest(left, right), "strand": F.when(F.col(left) > F.col(right), "-").otherwise("+")})


def parse_intervals(col: Column) -> dict[str, Column]:
    """id, left and right of id:left-right, id_left_right, id:left..right or id left right, where left may be larger."""
    pattern = r"^(.*?)(?::|_|\s)\s*(\d+)(?:-|_|\.\.|\s)\s*(\d+)$"
    a, b = (F.regexp_extract(col, pattern, i).try_cast("long") for i in (2, 3))
    name = F.regexp_extract(col, pattern, 1)
    return {"id": F.when(name != "", name), "left": F.least(a, b), "right": F.greatest(a, b)}


def merge(df: DataFrame, contig: str, left: str, right: str, gap: int = 0) -> DataFrame:
    """The union of each contig's intervals; those that touch (or lie within the gap) become one."""
    w = W.partitionBy(contig).orderBy(left, right)
    far = F.max(right).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col(left) > far + 1 + gap), 1).otherwise(0)
    grouped = df.select(contig, left, right, new.alias("_new")).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(contig, "_g").agg(F.min(left).alias(left), F.max(right).alias(right)).drop("_g")


def merge_hits(df: DataFrame, keys: list[str], left: str, right: str, length: Column, gap: int = 600, least: float = 0.5) -> DataFrame:
    """Hits of one key (contig and strand) closer than the gap become one; kept if they cover enough of the query."""
    key = F.struct(*keys)
    merged = merge(df.withColumn("_k", key), "_k", left, right, gap).select("_k.*", left, right)
    return merged.where(F.col(right) - F.col(left) + 1 >= least * length)


def adjacent(df: DataFrame, contig: str, order: list[str], value: str, steps: int = 1) -> DataFrame:
    """df with next1, next2, ...: the values of the following rows of the contig."""
    w = W.partitionBy(contig).orderBy(*order)
    return df.withColumns({f"next{i}": F.lead(value, i).over(w) for i in range(1, steps + 1)})


def role_triples(df: DataFrame, contig: str, order: list[str], roles: str) -> DataFrame:
    """(triple, n): the sorted roles of every three neighbouring features; a feature of several roles gives several."""
    near = adjacent(df, contig, order, roles, 2).where("next2 is not null")
    one = near.select(F.explode(roles).alias("a"), "next1", "next2").select("a", F.explode("next1").alias("b"), "next2").select("a", "b", F.explode("next2").alias("c"))
    return one.groupBy(F.array_sort(F.array("a", "b", "c")).alias("triple")).agg(F.count("*").alias("n"))


def clusters(df: DataFrame, contig: str, feature: str, middle: str, subsystems: str, gap: int) -> DataFrame:
    """(subsystem, feature, cluster): neighbours on a contig with a common subsystem and middles within the gap are
    linked; the clusters of a subsystem are what its links connect. Features must be longs."""
    w = W.partitionBy(contig).orderBy(middle, feature)
    near = df.select(feature, F.lead(feature).over(w).alias("_next"), (F.lead(middle).over(w) - F.col(middle)).alias("_d"), F.array_intersect(subsystems, F.lead(subsystems).over(w)).alias("_s")).where(F.col("_d") <= gap)
    links = near.select(F.explode("_s").alias("subsystem"), F.col(feature).alias("_a"), F.col("_next").alias("_b"))
    code = lambda c: F.xxhash64("subsystem", c)
    nodes = links.select("subsystem", F.col("_a").alias("f")).unionByName(links.select("subsystem", F.col("_b").alias("f"))).distinct().withColumn("node", code("f"))
    found = graph.components(nodes.select("node").distinct(), links.select(code("_a").alias("a"), code("_b").alias("b")))
    named = nodes.join(found, "node")
    first = named.groupBy("subsystem", "component").agg(F.min("f").alias("cluster"))
    return named.join(first, ["subsystem", "component"]).select("subsystem", F.col("f").alias(feature), "cluster")


def covered(points: DataFrame, intervals: DataFrame, contig: str, at: str, left: str, right: str, width: int) -> DataFrame:
    """Points with every interval that holds them: an equality join on buckets of the given width, then the test."""
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(left) / width), F.floor(F.col(right) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(spread, [contig, "_b"]).where(F.col(at).between(F.col(left), F.col(right))).drop("_b")


def label_points(points: DataFrame, intervals: DataFrame, contig: str, at: str, left: str, right: str, width: int, id_col: str) -> DataFrame:
    """points with inside: whether an interval of the contig holds the point. Intervals are merged first."""
    union = merge(intervals, contig, left, right)
    hit = covered(points, union, contig, at, left, right, width).select(id_col, F.lit(True).alias("_in")).distinct()
    return points.join(hit, id_col, "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


def locate(coords: DataFrame, segments: DataFrame, key: str, at: str, segment: str, length: str) -> DataFrame:
    """coords with the segment that holds the position, counting along the key's segments in order; the last position
    of a segment belongs to it. Null beyond the end and at 0. Segments of no length hold nothing.

    Ends are running sums, and each position takes the last segment that begins before it, both over ranges of sorted rows
    (tables.running and carried): a key with all rows is dealt out, and so are equal positions."""
    ends = tables.running(segments.where(F.col(length) > 0), [key], [F.col(segment)], {"_from": F.col(length)})
    starts = ends.select(F.col(key), F.col("_from").alias("_pos"), F.lit(1).alias("_q"), F.struct(F.col(segment).alias("s"), (F.col("_from") + F.col(length)).alias("to")).alias("_s"))
    both = coords.select("*", F.col(at).alias("_pos"), F.lit(0).alias("_q"), F.xxhash64(*coords.columns).alias("_h")).unionByName(starts, allowMissingColumns=True)
    hit = tables.carried(both, [key], [F.col("_pos"), F.col("_q"), F.col("_h")], "_s")
    return hit.where("_q = 0").select(*coords.columns, F.when(F.col("_s.to") >= F.col(at), F.col("_s.s")).alias(segment))


def extract(seqs: DataFrame, locations: DataFrame, contig: str, seq: str, begin: str, strand: str, length: str) -> DataFrame:
    """locations with the bases they name, cut to the contig, as read from the strand (on - begin is the rightmost)."""
    n = F.length(seq)
    low = F.when(F.col(strand) == "-", F.col(begin) - F.col(length) + 1).otherwise(F.col(begin))
    left, right = F.greatest(low, F.lit(1)), F.least(low + F.col(length) - 1, n)
    piece = F.when(right >= left, F.substring(F.col(seq), left.cast("int"), (right - left + 1).cast("int"))).otherwise("")
    both = locations.join(seqs.select(contig, seq), contig)
    return both.select(*locations.columns, F.when(F.col(strand) == "-", sq.revcomp(piece)).otherwise(piece).alias("piece"))


def table(df: DataFrame, genome: str, feature: str, location: str, families: str, db: str) -> DataFrame:
    """(genome, feature, location text, family id) of one family database; without a family null."""
    text = F.array_join(F.transform(location, lambda r: F.concat(r["contig"], F.lit("_"), r["begin"].cast("string"), r["strand"], r["len"].cast("string"))), ",")
    return df.select(genome, feature, text.alias("location"), F.try_element_at(F.filter(families, lambda f: f["db"] == db), F.lit(1))["id"].alias("family"))


def compare_calls(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two annotations (contig, strand, stop, function, length) by their stop: what became of each call."""
    a = old.select(*keys, F.col("function").alias("_fa"), F.col("length").alias("_la"))
    b = new.select(*keys, F.col("function").alias("_fb"), F.col("length").alias("_lb"))
    far = F.abs(F.col("_la") - F.col("_lb")) > 0.1 * F.greatest("_la", "_lb")
    size = F.when(F.col("_la").isNull(), "new").when(F.col("_lb").isNull(), "uncalled").when(~far, "same").when(F.col("_lb") > F.col("_la"), "longer").otherwise("shorter")
    return a.join(b, keys, "full").select(*keys, size.alias("length_change"), F.coalesce(F.col("_fa") == F.col("_fb"), F.lit(False)).alias("same_function"))


def role_sequences(df: DataFrame, genome: str, role: str, seq: str, wanted: str) -> DataFrame:
    """(genome, seq, copies) of one role: the longest sequence (of equal ones the first by letters) and how many."""
    hit = df.where(F.col(role) == wanted)
    return hit.groupBy(genome).agg(F.min(F.struct((-F.length(seq)).alias("l"), F.col(seq).alias("s"))).alias("b"), F.count("*").alias("copies")).select(genome, F.col("b.s").alias(seq), "copies")
