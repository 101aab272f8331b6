"""Genome against genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def fragments(seqs: DataFrame, id_col: str, seq: str, size: int = 1020, least: int = 100) -> DataFrame:
    """(id, fragment, start, piece): a sequence cut into pieces of `size`, those shorter than `least` left out."""
    n = F.ceil(F.length(seq) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("fragment"), (i * size + 1).alias("start"), F.substring(F.col(seq), i * size + 1, F.lit(size)).alias("piece")))
    return seqs.where(F.length(seq) > 0).select(id_col, F.inline(cut)).where(F.length("piece") >= least)


def ani(hits: DataFrame, keys: list[str], fragment: str, order: list[Column], least_length: float = 100, identity: float = 30, coverage: float = 70) -> DataFrame:
    """(keys, fragments, ani): of each fragment the first hit of enough length; if that one is also alike and covered
    enough, it counts in the mean identity."""
    first = tables.best_per_key(hits.where(F.col("length") >= least_length), [*keys, fragment], *order)
    return first.where((F.col("identity") > identity) & (F.col("coverage") >= coverage)).groupBy(*keys).agg(F.count("*").alias("fragments"), F.avg("identity").alias("ani"))
