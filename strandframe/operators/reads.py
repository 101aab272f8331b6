"""Reads: merging of mates, dereplication, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as sq
from . import tables


def merge_pairs(df: DataFrame, left: str, right: str, probe: int = 25, strict: bool = False) -> DataFrame:
    """df with merged and overlap: the right mate, reverse-complemented, begins where its first `probe` bases stand in
    the left one; both must agree up to the left one's end (strict), else the probe is enough. If it isn't found, the
    left one's last `probe` bases are looked for in the right mate. Null where there is no overlap."""
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731  computes c once for all its uses in f
    n, m = (lambda p: F.length(p["l"])), (lambda p: F.length(p["r"]))

    def probes(p: Column) -> Column:
        long_enough = (n(p) >= probe) & (m(p) >= probe)
        at = F.position(F.substring(p["r"], F.lit(1), F.lit(probe)), p["l"])
        back = F.position(F.substring(p["l"], n(p) - (probe - 1), F.lit(probe)), p["r"])
        return F.struct(p["l"].alias("l"), p["r"].alias("r"), F.when(long_enough, at).alias("at"), F.when(long_enough, back).alias("back"))

    def sized(p: Column) -> Column:
        first, second = n(p) - p["at"] + 1, p["back"] + probe - 1
        size = F.when((p["at"] > 0) & (first <= m(p)), first).when((p["at"] == 0) & (p["back"] > 0) & (second <= n(p)), second)
        return F.struct(p["l"].alias("l"), p["r"].alias("r"), size.alias("size"))

    def joined(p: Column) -> Column:
        merged = F.concat(p["l"], F.substring(p["r"], p["size"] + 1, m(p)))
        same = F.substring(p["l"], n(p) - p["size"] + 1, p["size"]) == F.substring(p["r"], F.lit(1), p["size"])
        return F.when(same if strict else p["size"].isNotNull(), F.struct(p["size"].alias("size"), merged.alias("merged")))

    pair = F.struct(F.col(left).alias("l"), sq.revcomp(F.col(right)).alias("r"))
    found = bound(bound(bound(pair, probes), sized), joined)
    return df.withColumn("_merged", found).select(*df.columns, F.col("_merged.size").alias("overlap"), F.col("_merged.merged").alias("merged"))


def dereplicate(df: DataFrame, seq: str, least: int, frequency: float = 5e-5) -> DataFrame:
    """(number, seq, n): distinct sequences by descending count, of at least `least` copies and that share of all; numbers
    count over the whole result."""
    n = df.groupBy(seq).agg(F.count("*").alias("n"))
    kept = n.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).where((F.col("n") >= least) & (F.col("n") >= frequency * F.col("_all"))).drop("_all")
    return tables.numbered(kept, [F.desc("n"), F.col(seq)], "number").select("number", seq, "n")


def amplicon_profile(merged: DataFrame, hits: DataFrame, sample: str, seq: str, target: str, least: int = 2) -> DataFrame:
    """(sample, target, reads): each sample's distinct merged reads of enough copies, by their best hit."""
    counts = merged.where(F.col(seq).isNotNull()).groupBy(sample, seq).agg(F.count("*").alias("reads")).where(F.col("reads") >= least)
    best = tables.best_per_key(hits, [seq], F.desc("score"), F.col(target))
    return counts.join(best.select(seq, target), seq).groupBy(sample, target).agg(F.sum("reads").alias("reads"))
