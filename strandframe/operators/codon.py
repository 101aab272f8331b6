"""Codon usage: counts (gene, aa, codon, n), frequencies and distances. Codons are upper-case DNA."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq


def table(spark, amino_acids: int = 20) -> DataFrame:
    """(aa, codon) of the genetic code without stops; 18: without the amino acids of one codon."""
    code = [(a, c) for c, a in seq.genetic_code().items() if a != "*" and (amino_acids == 20 or a not in "MW")]
    return spark.createDataFrame(code, "aa string, codon string")


def counts(genes: DataFrame, gene: str, dna: str) -> DataFrame:
    """(gene, codon, n): whole codons but the first, without ambiguous ones and a final stop; U counts as T."""
    codons = seq.places(genes, [gene], seq.normalize(F.col(dna), "dna"), 3, 3).where("place > 0").withColumnRenamed("piece", "codon")
    final_stop = F.col("last") & F.col("codon").isin("TAA", "TAG", "TGA")
    return codons.where(~final_stop & F.col("codon").rlike("^[ACGT]{3}$")).groupBy(gene, "codon").agg(F.count("*").alias("n"))


def package(codon_counts: DataFrame, gene: str, amino_acids: int = 20) -> DataFrame:
    """(gene, aa, codon, n): every codon of every amino acid for each gene, zeros filled."""
    code = F.broadcast(table(codon_counts.sparkSession, amino_acids))  # 61 rows at most
    every = codon_counts.select(gene).distinct().crossJoin(code)
    return every.join(codon_counts, [gene, "codon"], "left").select(gene, "aa", "codon", F.coalesce("n", F.lit(0)).alias("n"))


def total(packaged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts summed over genes (keys: what to keep)."""
    return packaged.groupBy(*keys, "aa", "codon").agg(F.sum("n").alias("n"))


def freqs(packaged: DataFrame, keys: list[str], pseudo: float = 0) -> DataFrame:
    """Frequencies inside each amino acid, a pseudocount shared by its codons; an amino acid that doesn't occur and
    has no pseudocount gets equal shares."""
    w = W.partitionBy(*keys, "aa")
    n, k = F.sum("n").over(w), F.count("*").over(w)
    return packaged.select(*keys, "aa", "codon", F.when(n + pseudo > 0, (F.col("n") + pseudo / k) / (n + pseudo)).otherwise(1 / k).alias("freq"))


def average_freqs(f: DataFrame) -> DataFrame:
    return f.groupBy("aa", "codon").agg(F.avg("freq").alias("freq"))


def chi_square(packaged: DataFrame, gene: str, f: DataFrame, cap: int | None = None) -> DataFrame:
    """(gene, chi_square, df, p) against a set of frequencies, summed over amino acids; cap: genes with more codons
    count as if they had that many. Codons of frequency 0 are left out."""
    n = F.sum("n").over(W.partitionBy(gene, "aa"))
    rows = packaged.join(F.broadcast(f), ["aa", "codon"]).where("freq > 0").select(gene, "aa", "n", (F.col("freq") * n).alias("_e"), n.alias("_t")).where("_t > 0")
    per = rows.groupBy(gene).agg(F.sum((F.col("n") - F.col("_e")) ** 2 / F.col("_e")).alias("_x"), (F.count("*") - F.count_distinct("aa")).alias("df"), F.sum("n").alias("_n"))
    x = F.col("_x") if cap is None else F.col("_x") * F.least(F.lit(1.0), cap / F.col("_n"))
    return per.select(gene, x.alias("chi_square"), "df", upper_chi_square(x, F.col("df")).alias("p"))


def chi_square_pairs(a: DataFrame, b: DataFrame, pair: str) -> DataFrame:
    """(pair, chi_square, df) of two genes' packaged counts with a pair id: the sum over amino acids of the
    contingency table of its codons."""
    both = a.select(pair, "aa", "codon", F.col("n").alias("_x")).join(b.select(pair, "aa", "codon", F.col("n").alias("_y")), [pair, "aa", "codon"]).where("_x + _y > 0")
    w = W.partitionBy(pair, "aa")
    rows = both.withColumns({"_sx": F.sum("_x").over(w), "_sy": F.sum("_y").over(w), "_k": F.count("*").over(w)}).where("_sx > 0 and _sy > 0")
    t = F.col("_sx") + F.col("_sy")
    ex, ey = (F.col("_x") + F.col("_y")) * F.col("_sx") / t, (F.col("_x") + F.col("_y")) * F.col("_sy") / t
    return rows.groupBy(pair).agg(F.sum((F.col("_x") - ex) ** 2 / ex + (F.col("_y") - ey) ** 2 / ey).alias("chi_square"), (F.count("*") - F.count_distinct("aa")).alias("df"))


#: Terms of the series and levels of the continued fraction, more than double precision needs for a up to 100.
TERMS = 200


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function for whole or half a above 0: below a + 1 one less the power series,
    summed from its last term, and above it the continued fraction, from its last level."""
    down = F.sequence(F.lit(TERMS), F.lit(1))
    start = F.when(F.floor(a) == a, 0.0).otherwise(0.5 * math.log(math.pi))
    steps = F.ceil(a).cast("int") - 1
    factors = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    log_gamma = F.aggregate(factors, start, lambda s, i: s + F.log(a - i))
    front = F.exp(a * F.log(x) - x - log_gamma)
    series = F.aggregate(down, F.lit(1.0), lambda t, n: 1 + x / (a + n) * t)
    fraction = F.aggregate(down, x + (2 * TERMS + 1) - a, lambda t, i: x + (2 * i - 1) - a - i * (i - a) / t)
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series / a)).otherwise(front / fraction)


def upper_chi_square(x: Column, df: Column) -> Column:
    """P of a chi-square of at least x; null without degrees of freedom."""
    return F.when(df > 0, upper_gamma(df / 2, x / 2))


def freq_score(packaged: DataFrame, gene: str, sets: DataFrame, set_id: str, power: float = 0.3, p: float = 0.05, least: float = 1e-6) -> DataFrame:
    """For each set of frequencies: the sum over genes of P**power, how many genes have P >= p, and the log likelihood of all
    codons (frequencies below `least` count as that)."""
    n = F.sum("n").over(W.partitionBy(set_id, gene, "aa"))
    both = packaged.join(sets, ["aa", "codon"]).select(set_id, gene, "aa", "n", "freq", n.alias("_t"))
    e = F.col("freq") * F.col("_t")
    shown = (F.col("freq") > 0) & (F.col("_t") > 0)
    per = both.groupBy(set_id, gene).agg(
        F.sum(F.when(shown, (F.col("n") - e) ** 2 / e)).alias("_x"), (F.count_if(shown) - F.count_distinct(F.when(shown, F.col("aa")))).alias("_d"),
        F.sum(F.col("n") * F.log(F.greatest(F.col("freq"), F.lit(least)))).alias("_l"),
    )
    scored = per.withColumn("_p", upper_chi_square(F.col("_x"), F.col("_d")))
    return scored.groupBy(set_id).agg(F.sum(F.pow("_p", F.lit(power))).alias("score"), F.count_if(F.col("_p") >= p).alias("genes"), F.sum("_l").alias("log_likelihood"))


def distance(sets: DataFrame, set_id: str, kind: int = 2) -> DataFrame:
    """(a, b, distance), a < b: 1 Euclidean over codons; 2 the root of the sum over amino acids of squared half sums
    of differences; 3 the sum of differences."""
    a, b = (sets.select(F.col(set_id).alias(x), "aa", "codon", F.col("freq").alias(f"_{x}")) for x in "ab")
    d = a.join(b, ["aa", "codon"]).where("a < b").select("a", "b", "aa", F.abs(F.col("_a") - F.col("_b")).alias("_d"))
    if kind == 1:
        return d.groupBy("a", "b").agg(F.sqrt(F.sum(F.col("_d") ** 2)).alias("distance"))
    if kind == 3:
        return d.groupBy("a", "b").agg(F.sum("_d").alias("distance"))
    return d.groupBy("a", "b", "aa").agg((F.sum("_d") / 2).alias("_h")).groupBy("a", "b").agg(F.sqrt(F.sum(F.col("_h") ** 2)).alias("distance"))


def codon_column(codon: Column) -> Column:
    """The amino acid of a codon column, * for a stop, null for what is no codon."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in seq.genetic_code().items() for x in kv)), codon)
