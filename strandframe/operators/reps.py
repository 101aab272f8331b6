"""Representatives: assignment, sets, neighbourhoods and reports. Scores are tables (query, rep, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, tables


def find(scores: DataFrame, query: str, rep: str) -> DataFrame:
    """The best representative of each query that has one, ties to the smallest."""
    return scores.groupBy(query).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(rep).alias("r"))).alias("b")).select(query, F.col("b.r").alias(rep), (-F.col("b.s")).alias("score"))


def list_close(scores: DataFrame, queries: DataFrame, query: str, rep: str, least: int) -> DataFrame:
    """Every representative with at least that score; a query without one is kept with nulls."""
    return queries.select(query).join(scores.where(F.col("score") >= least), query, "left").select(query, rep, "score")


def count_close(scores: DataFrame, queries: DataFrame, query: str, least: int) -> DataFrame:
    close = scores.where(F.col("score") >= least).groupBy(query).agg(F.count("*").alias("n"))
    return queries.select(query).join(close, query, "left").na.fill(0, ["n"])


def neighbor_lists(pairs: DataFrame, least: int = 25, size: int = 10_000) -> DataFrame:
    """(a, part, neighbors): neighbours by descending score, then id, oneself left out, in parts from 0 on of `size` each.
    Ranks run over ranges (tables.running), so that a node near to all others is neither sorted nor listed in one task."""
    near = pairs.where((F.col("score") >= least) & (F.col("a") != F.col("b"))).select("a", "b", "score")
    ranked = tables.running(near, ["a"], [F.desc("score"), F.col("b")], {"_i": F.lit(1)})
    lists = ranked.groupBy("a", F.floor(F.col("_i") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("_i", "b"))).alias("_n"))
    return lists.select("a", "part", F.col("_n.b").alias("neighbors"))


def closest_n(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rank") <= n)


def closest_by_score(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.where(F.col("score") >= least)


def thin(pairs: DataFrame, nodes: DataFrame, threshold: int, keep: DataFrame | None = None) -> DataFrame:
    """Nodes (node, rank) kept when each drops its neighbours of at least the threshold, in order of rank."""
    return graph.first_independent_set(nodes, pairs.where(F.col("score") >= threshold), keep)


def n_reps(pairs: DataFrame, nodes: DataFrame, n: int, thresholds: list[int]) -> tuple[int, DataFrame]:
    """The threshold whose set is closest to n nodes (of equal ones the smallest), and the set. The pairs are written once
    and the sets of all thresholds are made in the same rounds; for a wide range give a coarse list first and then a finer
    one around its result."""
    sets = graph.written(graph.independent_sets(nodes, graph.written(pairs.where(F.col("score") >= min(thresholds))), thresholds))
    sizes = {r.threshold: r.n for r in sets.groupBy("threshold").agg(F.count("*").alias("n")).collect()}  # a row a threshold
    best = min(thresholds, key=lambda t: (abs(sizes.get(t, 0) - n), t))
    return best, sets.where(F.col("threshold") == best).select("node")


def crude(pairs: DataFrame, nodes: DataFrame, least: int, final: bool = False) -> DataFrame:
    """(node, rep, score): in order of rank a node without a representative so far becomes one; others take the
    closest earlier representative (final: the closest of all). Pairs hold a score for each direction."""
    reps = graph.written(thin(pairs, nodes, least))
    rank = nodes.select("node", F.struct("rank", "node").alias("rank"))  # of equal ranks the smaller node comes first
    near = pairs.where(F.col("score") >= least).join(reps.select(F.col("node").alias("b")), "b", "left_semi")
    near = near.join(rank.select(F.col("node").alias("a"), F.col("rank").alias("_ra")), "a").join(rank.select(F.col("node").alias("b"), F.col("rank").alias("_rb")), "b")
    if not final:
        near = near.where("_rb < _ra")
    best = find(near.join(reps.select(F.col("node").alias("a")), "a", "left_anti").select("a", "b", "score"), "a", "b").select(F.col("a").alias("node"), F.col("b").alias("rep"), "score")
    return best.unionByName(reps.select("node", F.col("node").alias("rep"), F.lit(None).cast("long").alias("score")))


def check(scores: DataFrame, queries: DataFrame, query: str, rep: str, least: int, mid: int | None = None) -> DataFrame:
    """The best representative and whether the query is represented, (mid) in the middle, or an outlier."""
    s = F.coalesce("score", F.lit(0))
    kind = F.when(s >= least, "represented")
    if mid is not None:
        kind = kind.when(s >= mid, "middle")
    return queries.select(query).join(find(scores, query, rep), query, "left").select(query, rep, s.alias("score"), kind.otherwise("outlier").alias("class"))


def cover(pairs: DataFrame, nodes: DataFrame, least_score: int, least: int = 2) -> DataFrame:
    return graph.greedy_cover(nodes, pairs.where(F.col("score") >= least_score), least)


def update(members: DataFrame, scores: DataFrame, query: str, rep: str, clear: bool = False, least: int = 0, skip: DataFrame | None = None) -> DataFrame:
    """members (query, rep, score) with those that weren't in it yet, by their best representative of at least that
    score; skip: queries that are representatives themselves and join no group."""
    best = find(scores.where(F.col("score") >= least), query, rep)
    if skip is not None:
        best = best.join(skip.select(query), query, "left_anti")
    if clear:
        return best
    return members.select(query, rep, "score").unionByName(best.join(members, query, "left_anti").select(query, rep, "score"))


def region(close: DataFrame, members: DataFrame, query: str, rep: str, member: str, size: int = 100, per_group: int = 35, least: int = 25) -> DataFrame:
    """A neighbourhood for each query: the closest groups first, at most per_group members of each, whole slices until
    the size is reached."""
    near = close.where(F.col("score") >= least).select(query, rep, F.col("score").alias("_s"))
    group = members.select(rep, member, F.row_number().over(W.partitionBy(rep).orderBy(F.desc("score"), member)).alias("_i")).where(F.col("_i") <= per_group)
    rows = near.join(group, rep)
    sizes = rows.groupBy(query, rep, "_s").agg(F.count("*").alias("_n"))
    w = W.partitionBy(query).orderBy(F.desc("_s"), rep).rowsBetween(W.unboundedPreceding, -1)
    wanted = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_before") < size).select(query, rep)
    return rows.join(wanted, [query, rep], "left_semi").select(query, rep, member, F.col("_s").alias("score"))


def listing(reps: DataFrame, members: DataFrame, names: DataFrame, rep: str, member: str, name: str) -> DataFrame:
    """Each group's representative (position 0), then its members by descending score; unknown names as <unknown>."""
    w = W.partitionBy(rep).orderBy(F.desc("score"), member)
    rows = reps.select(rep, F.col(rep).alias(member), F.lit(None).cast("long").alias("score"), F.lit(0).alias("position")).unionByName(members.where(F.col(rep) != F.col(member)).select(rep, member, F.col("score").cast("long").alias("score"), F.row_number().over(w).alias("position")))
    return rows.join(names.select(F.col(member), F.col(name)), member, "left").withColumn(name, F.coalesce(name, F.lit("<unknown>")))


def stats(reps: DataFrame, members: DataFrame, rep: str) -> DataFrame:
    return reps.select(rep).join(members.groupBy(rep).agg(F.count("*").alias("members")), rep, "left").na.fill(0, ["members"])


def compare(groups: DataFrame, db: str, group: str) -> DataFrame:
    """For each database: groups, largest, singletons, groups of 100 or more, and the mean of all but one largest."""
    sizes = groups.groupBy(db, group).agg(F.count("*").alias("_n"))
    out = sizes.groupBy(db).agg(F.count("*").alias("groups"), F.max("_n").alias("largest"), F.count_if(F.col("_n") == 1).alias("singletons"), F.count_if(F.col("_n") >= 100).alias("large"), F.sum("_n").alias("_s"))
    return out.withColumn("interior_mean", F.when(F.col("groups") > 1, (F.col("_s") - F.col("largest")) / (F.col("groups") - 1))).drop("_s")


def taxonomy_fit(df: DataFrame, group: str, ranks: list[str]) -> DataFrame:
    """For each rank: the mean number of taxa in a group and of groups for a taxon."""
    long = df.select(group, F.inline(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks)))).where("taxon is not null").distinct()
    return long.groupBy("rank").agg((F.count("*") / F.count_distinct(group)).alias("taxa_per_group"), (F.count("*") / F.count_distinct("taxon")).alias("groups_per_taxon"))


def role_distance_stats(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Range, mean and deviation of two measures in each group of several rows, and their correlation, 1 where both
    ranges are at most 1."""
    aggs = [f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max), ("sd", F.stddev_samp))]
    out = df.groupBy(group).agg(F.count("*").alias("n"), *aggs, F.corr(x, y).alias("_r")).where("n > 1")
    flat = (F.col(f"max_{x}") - F.col(f"min_{x}") <= 1) & (F.col(f"max_{y}") - F.col(f"min_{y}") <= 1)
    return out.withColumn("correlation", F.when(flat, F.lit(1.0)).otherwise(F.col("_r"))).drop("_r")


def longest_of_tails(tails: DataFrame, lengths: DataFrame, id_col: str) -> DataFrame:
    """(set_id): the longest sequence of each tail that several have, of equal ones the first; pairs with others aren't needed
    in very_similar_sets."""
    shared = tails.join(tails.groupBy("tail").agg(F.count("*").alias("_n")).where("_n > 1"), "tail").join(lengths, id_col)
    return shared.groupBy("tail").agg(F.min(F.struct((-F.col("length")).alias("l"), F.col(id_col).alias("id"))).alias("m")).select(F.col("m.id").alias("set_id")).distinct()


def very_similar_sets(tails: DataFrame, lengths: DataFrame, pairs: DataFrame, id_col: str, least: int = 200) -> DataFrame:
    """(set_id, member): for each tail of several sequences the longest, and all with at least `least` k-mers in
    common with it; a member of several sets stays in that of the lowest id (the longest's)."""
    longest = longest_of_tails(tails, lengths, id_col)
    near = longest.join(pairs.where(F.col("score") >= least), F.col("set_id") == F.col("a")).select("set_id", F.col("b").alias("member"))
    return near.unionByName(longest.select("set_id", F.col("set_id").alias("member"))).groupBy("member").agg(F.min("set_id").alias("set_id"))


def bidirectional_best(scores: DataFrame, left: str, right: str, least: int = 100) -> DataFrame:
    """Pairs in which each side is the other's best (ties included), of at least that score."""
    s = scores.where(F.col("score") >= least)
    ranks = {"_l": F.rank().over(W.partitionBy(left).orderBy(F.desc("score"))), "_r": F.rank().over(W.partitionBy(right).orderBy(F.desc("score")))}
    return s.withColumns(ranks).where("_l = 1 and _r = 1").drop("_l", "_r")


def orphans(matches: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(side, id): what has no match, on both sides."""
    alone = [df.select(c).distinct().join(matches.select(c), c, "left_anti").select(F.lit(side).alias("side"), F.col(c).cast("string").alias("id")) for side, df, c in (("left", left, a), ("right", right, b))]
    return alone[0].unionByName(alone[1])


def similarity_range(pairs: DataFrame) -> DataFrame:
    """(a, n, least, largest, mean): how alike each representative is to the others that it shares something with."""
    return pairs.where("a <> b").groupBy("a").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("largest"), F.avg("score").alias("mean"))


def distance_range(distances: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """(node, n, nearest, farthest, mean): each node's distances to all others, from those of pairs that share something
    (a, b, distance; each once) and the number of those that don't, which are at 1. Nulls where there is no other."""
    both = distances.select("a", "distance").unionByName(distances.select(F.col("b").alias("a"), "distance"))
    met = both.groupBy("a").agg(F.count("*").alias("_m"), F.min("distance").alias("_low"), F.max("distance").alias("_high"), F.sum("distance").alias("_s"))
    j = nodes.select(node).join(F.broadcast(nodes.agg((F.count("*") - 1).alias("n")))).join(met, F.col(node) == F.col("a"), "left").na.fill(0, ["_m", "_s"])
    far = F.col("n") - F.col("_m")
    high = F.when(far > 0, 1.0).otherwise(F.col("_high"))
    return j.select(node, "n", F.when(F.col("n") > 0, F.coalesce("_low", F.lit(1.0))).alias("nearest"), F.when(F.col("n") > 0, high).alias("farthest"), F.when(F.col("n") > 0, (F.col("_s") + far) / F.col("n")).alias("mean"))


def match_scores(matches: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, part: str, least: int = 1) -> DataFrame:
    """matches (a, b) with pairs and score: how many of their parts are each other's best (most shared k-mers, then the
    first by name; at least `least`), and 100 * pairs over pairs and half of the parts without partner.

    left and right are k-mers (a or b, part, kmer) of the parts, such as proteins of genomes. Parts meet by an equality
    join on the matched pair and the k-mer, so only parts of matched genomes are ever compared."""
    pair = matches.select(a, b).distinct()
    x = pair.join(left.select(a, F.col(part).alias("_p"), "kmer").distinct(), a)
    y = pair.join(right.select(b, F.col(part).alias("_q"), "kmer").distinct(), b)
    met = x.join(y, [a, b, "kmer"]).groupBy(a, b, "_p", "_q").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    ranks = {"_i": F.row_number().over(W.partitionBy(a, b, "_p").orderBy(F.desc("_n"), "_q")), "_j": F.row_number().over(W.partitionBy(a, b, "_q").orderBy(F.desc("_n"), "_p"))}
    best = met.withColumns(ranks).where("_i = 1 and _j = 1").groupBy(a, b).agg(F.count("*").alias("pairs"))
    size = lambda df, by, name: df.groupBy(by).agg(F.count_distinct(part).alias(name))
    out = pair.join(best, [a, b], "left").join(size(left, a, "_x"), a, "left").join(size(right, b, "_y"), b, "left").na.fill(0, ["pairs", "_x", "_y"])
    alone = F.col("_x") + F.col("_y") - 2 * F.col("pairs")
    return out.select(a, b, "pairs", F.when(F.col("pairs") > 0, 100 * F.col("pairs") / (F.col("pairs") + alone / 2)).otherwise(0.0).alias("score"))


def closest_members(close: DataFrame, members: DataFrame, scores: DataFrame, query: str, rep: str, member: str, n: int = 10, least: int = 25) -> DataFrame:
    """Each query's n closest members of the groups whose representative it is close to; scores: (query, member, score)."""
    options = close.where(F.col("score") >= least).select(query, rep).join(members.select(rep, member), rep)
    ranked = options.join(scores.select(query, member, "score"), [query, member])
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), member))).where(F.col("rank") <= n)


def closest_refine(scores: DataFrame, pairs: DataFrame, nodes: DataFrame, query: str, node: str, levels: list[int]) -> DataFrame:
    """The closest node of each query, searched from coarse to fine: among the set thinned at the first level, then at
    each level among the neighbours (of that score) of the best one so far, itself included."""
    pairs, scores = graph.written(pairs), graph.written(scores)  # both are read at every level
    start = thin(pairs, nodes, levels[0]).select(F.col("node").alias(node))
    best = find(scores.join(start, node, "left_semi"), query, node)
    for level in levels:
        near = pairs.where(F.col("score") >= level).select(F.col("a").alias(node), F.col("b").alias("_n"))
        options = best.join(near, node).select(query, F.col("_n").alias(node)).unionByName(best.select(query, node)).distinct()
        best = graph.written(find(scores.join(options, [query, node]), query, node))
    return best


def taxonomy_breakdown(df: DataFrame, group: str, genus: str, species: str) -> DataFrame:
    """(group, genus, members, species): how many members and species of each genus a group has."""
    return df.groupBy(group, F.coalesce(genus, F.lit("<unknown>")).alias(genus)).agg(F.count("*").alias("members"), F.count_distinct(species).alias("species"))


def distances(kmers_a: DataFrame, kmers_b: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, distance) of pairs with a common k-mer: 1 - shared / union of their k-mer sets; all others are at 1."""
    x, y = kmers_a.select(a, "kmer").distinct(), kmers_b.select(b, "kmer").distinct()
    nx, ny = x.groupBy(a).agg(F.count("*").alias("_x")), y.groupBy(b).agg(F.count("*").alias("_y"))
    shared = x.join(y, "kmer").groupBy(a, b).agg(F.count("*").alias("_s"))
    return shared.join(nx, a).join(ny, b).select(a, b, (1 - F.col("_s") / (F.col("_x") + F.col("_y") - F.col("_s"))).alias("distance"))


def pair_check(seed: DataFrame, profile: DataFrame) -> DataFrame:
    """(a, b, seed_score, profile_score) of pairs that either similarity knows."""
    return seed.select("a", "b", F.col("score").alias("seed_score")).join(profile.select("a", "b", F.col("score").alias("profile_score")), ["a", "b"], "full")


def classify(scores: DataFrame, queries: DataFrame, query: str, rep: str, close: int, far: int) -> DataFrame:
    """The best representative with a class: blank if close, outlier below that, extreme below far."""
    out = check(scores, queries, query, rep, close, far)
    return out.withColumn("class", F.when(F.col("class") == "represented", "").when(F.col("class") == "middle", "outlier").otherwise("extreme"))
