"""Functions, roles and what genomes have of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roles_of(function: Column) -> Column:
    """The roles that a function text lists: parts between ' / ', ' @ ' and '; ', without a trailing comment."""
    return F.filter(F.transform(F.split(F.regexp_replace(function, r"\s*[#!].*$", ""), r"\s+[/@]\s+|;\s+"), F.trim), lambda r: r != "")


def checksum(role: Column) -> Column:
    """A checksum of the role text in lower case, without EC numbers and repeated white space."""
    return F.md5(F.trim(F.regexp_replace(F.regexp_replace(F.lower(role), r"\(ec [0-9.-]+\)", ""), r"\s+", " ")))


def map_roles(features: DataFrame, dictionary: DataFrame, function: str) -> tuple[DataFrame, DataFrame]:
    """Features with role_id (a row for each role), and roles that the dictionary (role_id, checksum) doesn't know."""
    long = features.withColumn("role", F.explode(roles_of(F.col(function)))).withColumn("checksum", checksum(F.col("role")))
    known = dictionary.select("role_id", "checksum")
    return long.join(known, "checksum"), long.join(known, "checksum", "left_anti").select("role").distinct()


def flags(dictionary: DataFrame, in_subsystem: DataFrame, experimental: DataFrame, strict: bool = False) -> DataFrame:
    """dictionary with subsystem and experimental; strict: only experimental roles count as in a subsystem."""
    out = dictionary.join(in_subsystem.select("role_id", F.lit(True).alias("_s")).distinct(), "role_id", "left").join(experimental.select("role_id", F.lit(True).alias("_e")).distinct(), "role_id", "left")
    s, e = F.coalesce("_s", F.lit(False)), F.coalesce("_e", F.lit(False))
    return out.withColumns({"subsystem": s & e if strict else s, "experimental": e}).drop("_s", "_e")


def unify(dictionary: DataFrame, aliases: DataFrame) -> DataFrame:
    """dictionary (role_id, ord) with the first role of each alias pair (a, b) in its order; a single pass."""
    at = dictionary.select("role_id", "ord")
    pairs = aliases.join(at.select(F.col("role_id").alias("a"), F.col("ord").alias("_oa")), "a").join(at.select(F.col("role_id").alias("b"), F.col("ord").alias("_ob")), "b")
    later = F.when(F.col("_oa") <= F.col("_ob"), F.struct(F.col("b").alias("role_id"), F.col("_oa").alias("o"), F.col("a").alias("to"))).otherwise(F.struct(F.col("a").alias("role_id"), F.col("_ob").alias("o"), F.col("b").alias("to")))
    best = pairs.select(later.alias("x")).groupBy("x.role_id").agg(F.min(F.struct("x.o", "x.to")).alias("m")).select("role_id", F.col("m.to").alias("_to"))
    return dictionary.join(best, "role_id", "left").withColumn("unified", F.coalesce("_to", "role_id")).drop("_to")


def common(df: DataFrame, group: str, genome: str, role: str, percent: float = 97, size: int = 100, least: int = 80) -> DataFrame:
    """(group, role, n, members): roles that at least percent of a group's members have, for groups of at least `size`
    members and `least` such roles."""
    sizes = df.groupBy(group).agg(F.count_distinct(genome).alias("members")).where(F.col("members") >= size)
    out = df.select(group, genome, role).distinct().groupBy(group, role).agg(F.count("*").alias("n")).join(sizes, group).where(F.col("n") * 100 >= F.col("members") * percent)
    return out.withColumn("_k", F.count("*").over(W.partitionBy(group))).where(F.col("_k") >= least).drop("_k")
