"""Dose-response groups: pairs of drugs on cell lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["drug1", "drug2", "line"]


def score(df: DataFrame, criterion: str) -> DataFrame:
    """(drug1, drug2, line, score) from rows with growth and expected: synergy is the largest expected - growth,
    antagony the largest growth - expected; with 2 rows of negative growth don't count; minergy is the difference at
    the lowest growth; deltaDiff the largest relative change between neighbouring doses (c1, c2) either way."""
    if criterion == "deltaDiff":
        def change(by: str, along: str) -> DataFrame:
            before = F.lag("growth").over(W.partitionBy(*GROUP, by).orderBy(along))
            base = F.greatest(F.abs("growth"), F.abs(before))
            return df.select(*GROUP, F.when(base > 0, 100 * F.abs(F.col("growth") - before) / base).alias("_d"))

        return change("c2", "c1").unionByName(change("c1", "c2")).groupBy(*GROUP).agg(F.max("_d").alias("score")).where("score is not null")
    d = F.col("expected") - F.col("growth")
    ok = F.col("growth") >= 0 if criterion.endswith("2") else F.lit(True)
    agg = {"synergy": F.max(F.when(ok, d)), "antagony": F.max(F.when(ok, -d)), "minergy": F.min_by(d, F.struct("growth", "expected"))}[criterion.rstrip("2")]
    return df.where("expected is not null").groupBy(*GROUP).agg(agg.alias("score")).where("score is not null")


def select(scores: DataFrame, least: float | None = None, top: int | None = None) -> DataFrame:
    """Groups of two drugs with at least the score, or the best ones."""
    pairs = scores.where("drug1 <> drug2")
    if least is not None:
        pairs = pairs.where(F.col("score") >= least)
    return pairs if top is None else pairs.orderBy(F.desc("score"), *GROUP).limit(top)


def sorted_pair() -> tuple[Column, Column]:
    return F.least("drug1", "drug2").alias("a"), F.greatest("drug1", "drug2").alias("b")


def pairs(scores: DataFrame, significant: float) -> DataFrame:
    """(a, b, n, mean, significant, significant_mean) of each pair of drugs over its lines."""
    s = F.when(F.col("score") >= significant, F.col("score"))
    return scores.groupBy(*sorted_pair()).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count(s).alias("significant"), F.avg(s).alias("significant_mean"))


def summary(pair_table: DataFrame, drugs: list[str]) -> DataFrame:
    """Drug by drug counts of significant scores, both ways, and each drug's total."""
    half = pair_table.select("a", "b", "significant")
    both = half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "significant"))
    wide = both.groupBy(F.col("a").alias("drug")).pivot("b", drugs).agg(F.sum("significant")).na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{d}`") for d in drugs), F.lit(0)))


def triples(pair_table: DataFrame, least: int = 7) -> DataFrame:
    """(a, b, c): three drugs of which each pair has enough significant scores; the direction of a pair doesn't matter."""
    e = pair_table.where((F.col("significant") >= least) & (F.col("a") < F.col("b"))).select("a", "b")
    ab, bc, ac = e, e.select(F.col("a").alias("b"), F.col("b").alias("c")), e.select("a", F.col("b").alias("c"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def participation(df: DataFrame, by: str) -> DataFrame:
    """(by, drug, n): in how many groups of a line or panel each drug takes part."""
    return df.select(by, F.explode(F.array_distinct(F.array("drug1", "drug2"))).alias("drug")).groupBy(by, "drug").agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two studies on the same pair and line, with the ranks of both scores."""
    x = a.select(*sorted_pair(), "line", F.col("score").alias("score_a"))
    y = b.select(*sorted_pair(), "line", F.col("score").alias("score_b"))
    both = x.join(y, ["a", "b", "line"])
    w = W.partitionBy("a", "b")
    return both.withColumns({"rank_a": F.row_number().over(w.orderBy(F.desc("score_a"), "line")), "rank_b": F.row_number().over(w.orderBy(F.desc("score_b"), "line"))})


def predictions(a: DataFrame, b: DataFrame, key: list[str], drugs: list[str]) -> DataFrame:
    """Two tables with a column a drug, side by side: (key, drug, first, second)."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.inline(F.array(*(F.struct(F.lit(d).alias("drug"), F.col(f"`{d}`").cast("double").alias(name)) for d in drugs))))

    return long(a, "first").join(long(b, "second"), [*key, "drug"], "left")


def harmonize_ic50(df: DataFrame, drug: str, value: str, natural_log: bool, prefix: str) -> DataFrame:
    """IC50 as -log10, from -ln or -log10, and the drug's name with its source's prefix."""
    v = F.col(value) / F.log(F.lit(10.0)) if natural_log else F.col(value)
    return df.withColumns({value: v, drug: F.concat(F.lit(prefix + "."), drug)})


def name_map(lines: DataFrame, line: str, order: str) -> DataFrame:
    """(number, name) from lines such as "123: Name", the first name of each number."""
    found = lines.select(F.regexp_extract(line, r"^\s*(\d+)\s*[:\t ]\s*(\S.*?)\s*$", 1).alias("number"), F.regexp_extract(line, r"^\s*(\d+)\s*[:\t ]\s*(\S.*?)\s*$", 2).alias("name"), F.col(order).alias("_o")).where("number <> '' and name <> ''")
    return found.groupBy("number").agg(F.min(F.struct("_o", "name")).alias("m")).select("number", F.col("m.name").alias("name"))
