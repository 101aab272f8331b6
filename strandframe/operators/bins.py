"""Scores of contigs against references, their comparison, and reports on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score(hits: DataFrame, contig: str, ref: str, method: str, identity: str = "identity", begin: str = "b2", end: str = "e2") -> DataFrame:
    """(contig, ref, score): the best identity (vector), identity times length / 100 added up (signal), or its mean."""
    signal = F.col(identity) * F.abs(F.col(end) - F.col(begin)) / 100
    agg = {"vector": F.max(identity), "signal": F.sum(signal), "signalavg": F.avg(signal)}[method]
    return hits.groupBy(contig, ref).agg(agg.alias("score"))


def screen(scores: DataFrame, contig: str, low: float = 30, high: float = 10_000) -> DataFrame:
    """Contigs whose scores add up to something between."""
    ok = scores.groupBy(contig).agg(F.sum("score").alias("_s")).where((F.col("_s") > low) & (F.col("_s") < high))
    return scores.join(ok, contig, "left_semi")


def best_coordinate(scores: DataFrame, contig: str, ref: str, normalize: bool = False) -> DataFrame:
    """(contig, best, score) of contigs with a score; equal ones go to the first reference; normalize: of unit vectors."""
    some = scores.where("score > 0")
    best = some.groupBy(contig).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(ref).alias("r"))).alias("b"), F.sqrt(F.sum(F.col("score") ** 2)).alias("_n"))
    return best.select(contig, F.col("b.r").alias("best"), (-F.col("b.s") / (F.col("_n") if normalize else F.lit(1.0))).alias("score"))


def dot_products(scores: DataFrame, contig: str, ref: str) -> DataFrame:
    """(a, b, dot), a < b, of contigs that share a reference."""
    a, b = (scores.select(F.col(contig).alias(x), ref, F.col("score").alias(f"_{x}")) for x in "ab")
    return a.join(b, ref).where("a < b").groupBy("a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def relative(x: Column, y: Column) -> Column:
    """1 / (1 + relative difference); null where both are zero."""
    top = F.greatest(F.abs(x), F.abs(y))
    return F.when(top > 0, 1 / (1 + F.abs(x - y) / top))


def compare_dist(x: Column, y: Column) -> Column:
    """The sum of relative likeness over the coordinates of two arrays that aren't both zero."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.coalesce(relative(a, b), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def compare_best(best: DataFrame, contig: str) -> DataFrame:
    """(a, b, likeness) of contigs with the same best coordinate, a < b; all other pairs are 0."""
    a, b = (best.select(F.col(contig).alias(x), "best", F.col("score").alias(f"_{x}")) for x in "ab")
    return a.join(b, "best").where("a < b").select("a", "b", relative(F.col("_a"), F.col("_b")).alias("likeness"))


def compare_rank(x: Column, y: Column) -> Column:
    """1 + concordant - 2 discordant pairs over the coordinates that neither has at zero; ties in y are concordant."""
    both = F.filter(F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: (p["a"] != 0) & (p["b"] != 0))
    ordered = F.array_sort(both, lambda p, q: F.when(p["a"] > q["a"], -1).when(p["a"] < q["a"], 1).otherwise(0))
    pairs = F.transform(ordered, lambda p, i: F.aggregate(F.slice(ordered, i + 2, F.size(ordered)), F.lit(0), lambda s, q: s + F.when(p["b"] >= q["b"], 1).otherwise(-2)))
    return F.when(F.size(both) > 1, 1 + F.aggregate(pairs, F.lit(0), lambda s, v: s + v)).otherwise(1)


def compare_order(x: Column, y: Column, top: int | None = None, strict: bool = False) -> Column:
    """1 if y never rises from one coordinate to the next in x's falling order (ties in place), else 0; top: only the first
    so many steps; strict: vectors with zeros match each other, all in one bin, and no others."""
    both = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ordered = F.transform(F.array_sort(both, lambda p, q: F.when(p["a"] > q["a"], -1).when(p["a"] < q["a"], 1).otherwise(0)), lambda p: p["b"])
    steps = F.size(x) - 1 if top is None else F.least(F.size(x) - 1, F.lit(top))
    rises = F.exists(F.transform(ordered, lambda b, i: (i < steps) & (F.get(ordered, i + 1) > b)), lambda r: r)
    same = F.when(rises, 0).otherwise(1)
    zero_x, zero_y = F.exists(x, lambda v: v == 0), F.exists(y, lambda v: v == 0)
    return F.when(zero_x | zero_y, (zero_x & zero_y).cast("int")).otherwise(same) if strict else same


def references(contigs: DataFrame, bin_col: str, ref: str, length: str, top: int = 10) -> DataFrame:
    """(bin, reference, rank, contigs, bases): each bin's reference genomes with most bases, of equal ones the first by name."""
    n = contigs.groupBy(bin_col, ref).agg(F.count("*").alias("contigs"), F.sum(length).alias("bases"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy(bin_col).orderBy(F.desc("bases"), ref)))
    return ranked.where(F.col("rank") <= top).select(bin_col, ref, "rank", "contigs", "bases")


def all_pairs(vectors: DataFrame, contig: str, vector: str) -> DataFrame:
    """(a, b, x, y), a < b: each pair of contigs once with their vectors, whether or not they share a reference. Very many
    contigs are dealt out in parts, each of which meets every other."""
    from . import graph, tables

    rows = graph.written(vectors.select(F.lit(0).alias("_all"), F.col(contig).alias("c"), F.col(vector).alias("v")))
    a, b = (rows.select("_all", F.col("c").alias(c), F.col("v").alias(v)) for c, v in ("ax", "by"))
    a, b, on = tables.dealt(a, b, "_all", "a", "b")
    return a.join(b, on).where("a < b").select("a", "b", "x", "y")


def totals(met: DataFrame, contigs: DataFrame, contig: str, alone: str, product: bool = False) -> DataFrame:
    """(contig, others, likeness): the sum of each contig's likeness to all others, from the pairs that meet (a, b, likeness;
    each once) and a closed form for those that don't, whose likeness is the sum, or the product, of their values of alone.

    compare_dist gives half the number of its coordinates for a vector that shares none, compare_rank a half each, and
    strict compare_order the product of having zeros; so no pair without a common reference is ever formed."""
    both = met.select("a", "b", "likeness").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    other = contigs.select(F.col(contig).alias("b"), F.col(alone).alias("_v"))
    own = both.join(other, "b").groupBy("a").agg(F.sum("likeness").alias("_l"), F.count("*").alias("_m"), F.sum("_v").alias("_met"))
    all_ = contigs.agg(F.count("*").alias("_n"), F.sum(alone).alias("_all"))
    j = contigs.join(own, F.col(contig) == F.col("a"), "left").na.fill(0, ["_l", "_m", "_met"]).join(F.broadcast(all_))  # all_ is one row
    rest = F.col("_all") - F.col(alone) - F.col("_met")
    absent = F.col(alone) * rest if product else (F.col("_n") - 1 - F.col("_m")) * F.col(alone) + rest
    return j.select(contig, (F.col("_n") - 1).alias("others"), (F.col("_l") + absent).cast("double").alias("likeness"))


def order_key(scores: DataFrame, contig: str, ref: str, top: int) -> DataFrame:
    """(contig, key): its top references in order; contigs with the same key fall in one bin."""
    ranked = scores.where("score > 0").withColumn("_i", F.row_number().over(W.partitionBy(contig).orderBy(F.desc("score"), ref))).where(F.col("_i") <= top)
    return ranked.groupBy(contig).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(ref).cast("string").alias("r")))), lambda s: s["r"]), ",").alias("key"))


def basis(scores: DataFrame, contig: str, ref: str, top: int = 4) -> DataFrame:
    """(rep, member) of references: each contig's top ones vote for each other; the reference related to most others
    leads and takes them out, again and again."""
    from . import graph

    tops = scores.where("score > 0").withColumn("_i", F.row_number().over(W.partitionBy(contig).orderBy(F.desc("score"), ref))).where(F.col("_i") <= top).select(contig, ref)
    edges = tops.select(contig, F.col(ref).alias("a")).join(tops.select(contig, F.col(ref).alias("b")), contig).where("a < b").select("a", "b").distinct()
    return graph.greedy_cover(tops.select(F.col(ref).alias("node")).distinct(), edges, least=1)


def seed(contigs: DataFrame, hits: DataFrame, second: DataFrame, contig: str, ref: str, least_length: float, least_coverage: float) -> DataFrame:
    """(contig, bin, how): contigs long and covered enough go to their best hit's reference; those without a hit to
    that of the second hit set, where the first made a bin of it."""
    ok = contigs.where((F.col("length") >= least_length) & (F.col("coverage") >= least_coverage)).select(contig)

    def best(h: DataFrame) -> DataFrame:
        return h.join(ok, contig, "left_semi").groupBy(contig).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(ref).alias("r"))).alias("b")).select(contig, F.col("b.r").alias("bin"))

    placed = best(hits)
    later = best(second.join(placed, contig, "left_anti")).join(placed.select("bin").distinct(), "bin", "left_semi")
    return placed.withColumn("how", F.lit("seed")).unionByName(later.withColumn("how", F.lit("second")))


def audit(df: DataFrame, keys: list[str], states: dict[str, Column]) -> DataFrame:
    """For each category how many rows there are, and how many are in each state."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in states.items()))


def filter_effect(contigs: DataFrame, length: float, coverage: float) -> DataFrame:
    return contigs.groupBy((F.col("length") >= length).alias("long"), (F.col("coverage") >= coverage).alias("covered")).agg(F.count("*").alias("contigs"), F.sum("length").alias("bases"))


def summarize(contigs: DataFrame, bin_: str, role: str, c1: float = 1, c2: float = 5) -> DataFrame:
    """Contigs, size, coverage by length, and the universal-role score: c1 for each kind of role, less c2 for each kind with
    more than one copy."""
    base = contigs.groupBy(bin_).agg(F.count("*").alias("contigs"), F.sum("length").alias("bases"), (F.sum(F.col("length") * F.col("coverage")) / F.sum("length")).alias("coverage"))
    unis = contigs.groupBy(bin_, role).agg(F.count("*").alias("_n")).groupBy(bin_).agg((c1 * F.count("*") - c2 * F.count_if(F.col("_n") > 1)).alias("uni_score"))
    return base.join(unis, bin_)


def match_expected(bins: DataFrame, expected: DataFrame, contig: str) -> DataFrame:
    """For each expected bin its best bin by shared contigs (the smaller of equal ones), shared, extra and missed."""
    shared = expected.join(bins, contig).groupBy("expected", "bin").agg(F.count("*").alias("shared"))
    best = shared.groupBy("expected").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col("bin"))).alias("b")).select("expected", "b.bin", (-F.col("b.s")).alias("shared"))
    sizes, wanted = bins.groupBy("bin").agg(F.count("*").alias("_size")), expected.groupBy("expected").agg(F.count("*").alias("_wanted"))
    out = wanted.join(best, "expected", "left").join(sizes, "bin", "left")
    return out.select("expected", F.coalesce(F.col("bin").cast("string"), F.lit("MISSING")).alias("bin"), F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("_size", F.lit(0)) - F.coalesce("shared", F.lit(0))).alias("extra"), (F.col("_wanted") - F.coalesce("shared", F.lit(0))).alias("missed"))


def overlap(a: DataFrame, b: DataFrame, contig: str) -> DataFrame:
    """(bin_a, bin_b, only_a, both, only_b) of bins that share a contig."""
    x, y = a.select(contig, F.col("bin").alias("bin_a")), b.select(contig, F.col("bin").alias("bin_b"))
    nx, ny = x.groupBy("bin_a").agg(F.count("*").alias("_x")), y.groupBy("bin_b").agg(F.count("*").alias("_y"))
    both = x.join(y, contig).groupBy("bin_a", "bin_b").agg(F.count("*").alias("both"))
    return both.join(nx, "bin_a").join(ny, "bin_b").select("bin_a", "bin_b", (F.col("_x") - F.col("both")).alias("only_a"), "both", (F.col("_y") - F.col("both")).alias("only_b"))


def flows(a: DataFrame, b: DataFrame, contig: str) -> DataFrame:
    """(source, target, contigs, bases) between two binnings; contigs of one only flow to unbinned or from unused."""
    x, y = a.select(contig, F.col("bin").cast("string").alias("_a"), F.col("length").alias("_la")), b.select(contig, F.col("bin").cast("string").alias("_b"), F.col("length").alias("_lb"))
    return x.join(y, contig, "full").groupBy(F.coalesce("_a", F.lit("unused")).alias("source"), F.coalesce("_b", F.lit("unbinned")).alias("target")).agg(F.count("*").alias("contigs"), F.sum(F.coalesce("_la", "_lb")).alias("bases"))


def side_by_side(runs: DataFrame, contig: str, names: list[str]) -> DataFrame:
    """A column for each run's bin of a contig, X for a bin of one contig, and how many runs agree on the top label."""
    size = F.count("*").over(W.partitionBy("run", "bin"))
    labelled = runs.withColumn("_l", F.when(size == 1, "X").otherwise(F.col("bin").cast("string")))
    wide = labelled.groupBy(contig).pivot("run", names).agg(F.min("_l"))
    labels = F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names))  # a blank counts as a label
    return wide.withColumn("agreement", F.array_max(F.transform(labels, lambda x: F.size(F.filter(labels, lambda y: y == x)))))


def crosstab(a: DataFrame, b: DataFrame, contig: str, least: int = 2) -> DataFrame:
    """(cluster, bins, contigs) of clusters that fall in at least that many bins; bins of one contig don't count."""
    real = b.withColumn("_n", F.count("*").over(W.partitionBy("bin"))).where("_n > 1").select(contig, "bin")
    return a.join(real, contig).groupBy("cluster").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("contigs")).where(F.col("bins") >= least)


def placement(contigs: DataFrame, bins: DataFrame, contig: str) -> DataFrame:
    """(contig, placed): unplaced, once or several times; bins' contigs that aren't known are unexpected."""
    n = bins.groupBy(contig).agg(F.count("*").alias("_n"))
    known = contigs.select(contig, F.lit(1).alias("_k")).distinct()
    return known.join(n, contig, "full").select(contig, F.when(F.col("_k").isNull(), "unexpected").when(F.col("_n").isNull(), "unplaced").when(F.col("_n") > 1, "multiple").otherwise("once").alias("placed"))


def coverage(contigs: DataFrame, bin_: str, is_seed: Column, least: float = 20) -> DataFrame:
    """Mean coverage of a bin and of its seed contigs, where either reaches the floor."""
    out = contigs.groupBy(bin_).agg(F.avg("coverage").alias("coverage"), F.avg(F.when(is_seed, F.col("coverage"))).alias("seed_coverage"))
    return out.where((F.col("coverage") >= least) | (F.col("seed_coverage") >= least))


def site_report(df: DataFrame, keys: list[str], good: Column, binned: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.sum(F.when(binned, F.col("length")).otherwise(0)).alias("bases_binned"), F.sum(F.when(binned, 0).otherwise(F.col("length"))).alias("bases_unbinned"), (F.sum(F.col("length") * F.col("coverage")) / F.sum("length")).alias("coverage"))


def compare_good(a: DataFrame, b: DataFrame, sample: str, good: str) -> DataFrame:
    def counts(df: DataFrame, x: str) -> DataFrame:
        return df.groupBy(sample).agg(F.count_if(F.col(good)).alias(f"good_{x}"), F.count_if(~F.col(good)).alias(f"bad_{x}"))

    return counts(a, "a").join(counts(b, "b"), sample)


def expectations(expected: DataFrame, found: DataFrame, category: str, least_depth: float = 5) -> DataFrame:
    """(category, expected, found, state): expected categories with enough depth, found or missed, and unexpected ones."""
    e = expected.where(F.col("depth") >= least_depth).groupBy(category).agg(F.count("*").alias("expected"))
    f = found.groupBy(category).agg(F.count("*").alias("found"))
    return e.join(f, category, "full").select(category, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), F.when(F.col("expected").isNull(), "unexpected").when(F.col("found").isNull(), "missed").otherwise("found").alias("state"))


def composition(contigs: DataFrame, bin_: str, source: str) -> DataFrame:
    n = contigs.groupBy(bin_, source).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy(bin_)))
