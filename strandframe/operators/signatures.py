"""Signatures: k-mers that occur in one group only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph
from . import kmers as km


def build(kmers: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """(kmer, group) of the k-mers of exactly one group.

    groups: all groups; with them the k-mers are aggregated by a 64-bit hash of the group's name, which fits a hash
    aggregate where the name would need a sort, and the names are joined at the end; names of one hash raise an error."""
    if groups is None:
        return kmers.groupBy("kmer").agg(F.min(group).alias(group), F.max(group).alias("_m")).where(F.col(group) == F.col("_m")).select("kmer", group)
    coded = kmers.where(F.col(group).isNotNull()).select("kmer", F.xxhash64(group).alias("_g"))
    own = coded.groupBy("kmer").agg(F.min("_g").alias("_g"), F.max("_g").alias("_m")).where("_g = _m").select("kmer", "_g")
    return own.join(_names(groups, group), "_g").select("kmer", group)


def of_letters(df: DataFrame, group: str, seq: str, k: int) -> DataFrame:
    """build() of the k-mers of sequences (group, seq) of the letters a-z, with the k-mers' codes (kmers.coded), which
    follow the order of the k-mers; the groups' names are read from df. Few names are broadcast, never the k-mers."""
    names = graph.written(_names(df, group))
    hashed = df.where(F.col(group).isNotNull()).select(F.xxhash64(group).alias("_g"), seq)
    own = km.of_one_group(hashed, "_g", seq, k)
    return own.join(F.broadcast(names) if names.count() <= 100_000 else names.hint("merge"), "_g").select("kmer", group)


def _names(groups: DataFrame, group: str) -> DataFrame:
    names = groups.where(F.col(group).isNotNull()).select(group).distinct().groupBy(F.xxhash64(group).alias("_g")).agg(F.min(group).alias(group), F.max(group).alias("_m"))
    return names.withColumn(group, F.when(F.col(group) == F.col("_m"), F.col(group)).otherwise(F.raise_error(F.lit("two groups of one hash")))).drop("_m")


def summary(signatures: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Signatures of each known group, zeros kept; of unknown groups none."""
    return groups.select(group).distinct().join(signatures.groupBy(group).agg(F.count("*").alias("n")), group, "left").na.fill(0, ["n"])


def evidence(reads: DataFrame, signatures: DataFrame, sample: str, group: str) -> DataFrame:
    """(sample, group, seen, total, percent): how many of a group's signatures a sample's reads show. Spark takes k-mers for
    as small as the sequences they are from, so they are never broadcast."""
    signatures = graph.written(signatures)
    total = signatures.groupBy(group).agg(F.count("*").alias("total"))
    seen = reads.select(sample, "kmer").distinct().hint("merge").join(signatures, "kmer").groupBy(sample, group).agg(F.count("*").alias("seen"))
    return seen.join(total, group).withColumn("percent", 100 * F.col("seen") / F.col("total"))


def raw(hits: Column, total: Column) -> Column:
    return hits


def scaled(hits: Column, total: Column) -> Column:
    """Hits for each thousand signatures of the group."""
    return hits * 1000 / total


def assign(reads: DataFrame, signatures: DataFrame, read_id: str, group: str, least: float = 1, scorer: Callable[[Column, Column], Column] = raw) -> DataFrame:
    """(read, group, score): the groups of the best score, all of them if tied, where it is at least `least`. The
    signatures are written once, for the totals and the hits. The reads' k-mers, which Spark takes for as small as the
    reads, are never broadcast."""
    signatures = graph.written(signatures)
    total = signatures.groupBy(group).agg(F.count("*").alias("_t"))
    hits = reads.hint("merge").join(signatures, "kmer").groupBy(read_id, group).agg(km.occurrences(reads).alias("_h"))
    scores = hits.join(total, group).select(read_id, group, scorer(F.col("_h"), F.col("_t")).alias("score")).where(F.col("score") >= least)
    return scores.withColumn("_r", F.rank().over(W.partitionBy(read_id).orderBy(F.desc("score")))).where("_r = 1").drop("_r")
