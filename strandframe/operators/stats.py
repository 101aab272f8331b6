"""Aggregate statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def mean_sd(df: DataFrame, keys: Iterable[str], value: str, population: bool = False) -> DataFrame:
    """n, mean and deviation; the sample deviation of fewer than two values is null."""
    sd = F.stddev_pop(value) if population else F.when(F.count(value) > 1, F.stddev_samp(value))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("sd"))


def correlation(df: DataFrame, keys: Iterable[str], x: str, y: str, z: bool = False) -> DataFrame:
    """Pearson's r, null for two pairs or fewer or without spread; z: Fisher's transform beside it."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.when((F.count("*") > 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), r.alias("r"))
    return out.withColumn("z", F.when(F.abs("r") < 1, 0.5 * F.log((1 + F.col("r")) / (1 - F.col("r"))))) if z else out


def _at_positions(df: DataFrame, keys: list[str], value: str, at: dict[str, object]) -> DataFrame:
    """For each name of at, the keys' value at a position from 0 on, which at[name] gives as a column of the keys' number of
    values _n; between two positions it is interpolated. Equal values are counted first, and the counts run over ranges
    (tables.running), so no key is sorted in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranked = tables.running(counts, keys, [F.col("_v")], {"_from": F.col("_c")}).withColumnRenamed("_from_all", "_n")
    holds = lambda i: ((F.col("_from") <= i) & (i < F.col("_from") + F.col("_c"))).cast("double")
    out = []
    for name, place in at.items():
        p = F.greatest(F.lit(0.0), F.least(place(F.col("_n").cast("double")), F.col("_n") - 1.0))
        share = holds(F.floor(p)) * (1 - (p - F.floor(p))) + holds(F.floor(p) + 1) * (p - F.floor(p))
        out.append(F.sum(F.when(share > 0, share * F.col("_v"))).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def quantile(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Quantiles that interpolate at n * f - 1/2 (the first and last value beyond); one column q<percent> each."""
    return _at_positions(df, keys, value, {f"q{round(100 * f)}": (lambda n, f=f: n * f - 0.5) for f in fractions})


def summary5(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, quartiles, maximum (linear percentiles), trimean and interquartile range."""
    q = _at_positions(df, keys, value, {f"q{i}": (lambda n, i=i: (n - 1) * (i / 4)) for i in range(5)})
    return q.withColumns({"trimean": (F.col("q1") + 2 * F.col("q2") + F.col("q3")) / 4, "iqr": F.col("q3") - F.col("q1")})


def chi_square(df: DataFrame, keys: list[str], expected: str, observed: str) -> DataFrame:
    """Sum of (observed - scaled expected)^2 / scaled expected, the expected values scaled to the observed total."""
    totals = df.groupBy(*keys).agg((F.sum(observed) / F.sum(expected)).alias("_scale"))
    e = F.col(expected) * F.col("_scale")
    both = df.join(totals, keys) if keys else df.crossJoin(totals)
    return both.where(e > 0).groupBy(*keys).agg(F.sum((F.col(observed) - e) ** 2 / e).alias("chi_square"), (F.count("*") - 1).alias("df"))


def contingency(df: DataFrame, keys: list[str], row: str, col: str, n: str) -> DataFrame:
    """Chi-square of a table of counts in long form; empty rows and columns, leading ones too, are dropped."""
    cells = df.groupBy(*keys, row, col).agg(F.sum(n).alias("_n"))
    rows, cols = cells.groupBy(*keys, row).agg(F.sum("_n").alias("_r")).where("_r > 0"), cells.groupBy(*keys, col).agg(F.sum("_n").alias("_c")).where("_c > 0")
    grand = rows.groupBy(*keys).agg(F.sum("_r").alias("_t"), F.count("*").alias("_nr"))
    shape = cols.groupBy(*keys).agg(F.count("*").alias("_nc"))
    on = [*keys] or None

    def attach(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        return a.join(b, by) if by else a.crossJoin(b)  # without keys: one row

    filled = attach(attach(cells.join(rows, [*keys, row]).join(cols, [*keys, col]), grand, on or []), shape, on or [])
    e = F.col("_r") * F.col("_c") / F.col("_t")
    # cells that hold nothing add their expected value: all expected values sum to the total
    per = filled.groupBy(*keys).agg(F.sum((F.col("_n") - e) ** 2 / e - e).alias("_s"), F.first("_t").alias("_t"), F.first("_nr").alias("_nr"), F.first("_nc").alias("_nc"))
    return per.select(*keys, (F.col("_s") + F.col("_t")).alias("chi_square"), ((F.col("_nr") - 1) * (F.col("_nc") - 1)).alias("df"))


def bucket(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(width)) * F.lit(width)


def ratio_means(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Mean over rows of a's value over b's, for columns a < b, where both are positive."""
    v = df.where(F.col(value) > 0).select(row, F.col(col).alias("a"), F.col(value).alias("_a"))
    w = v.select(row, F.col("a").alias("b"), F.col("_a").alias("_b"))
    return v.join(w, row).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("_a") / F.col("_b")).alias("ratio"))


def nx(df: DataFrame, keys: list[str], length: str, percents: list[int]) -> DataFrame:
    """N<p> and L<p>: the length at which the longest first cover p percent, and how many that takes. Equal lengths are
    counted first, and sums run over ranges (tables.running), so no key is sorted in one task."""
    counts = df.where(F.col(length) > 0).groupBy(*keys, F.col(length).alias("_len")).agg(F.count("*").alias("_c"))
    run = tables.running(counts, keys, [F.desc("_len")], {"_sum": F.col("_len") * F.col("_c"), "_rows": F.col("_c")})
    out = []
    for p in percents:
        reached = (F.col("_sum") + F.col("_len") * F.col("_c")) * 100 >= F.col("_sum_all") * p
        more = F.greatest(F.lit(1), F.ceil((F.col("_sum_all") * p - F.col("_sum") * 100) / (F.col("_len") * 100)))
        out += [F.max(F.when(reached, F.col("_len"))).alias(f"n{p}"), F.min(F.when(reached, F.col("_rows") + more)).cast("long").alias(f"l{p}")]
    return run.groupBy(*keys).agg(*out)
