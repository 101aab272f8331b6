"""Aligned sequences: columns, pairs, trimming. Gaps are - ; sequences of one alignment have equal length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, tables

GAP = "-"
#: Sequences that are compared with each other at a time, and the columns of pairs that are looked at together.
BLOCK, CELLS = 2000, 1 << 22


# BLOSUM62 in half bits, the rows of its lower triangle in the order of RESIDUES.
RESIDUES = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: The score of a pair with a letter outside RESIDUES; penalties of a gap's first and each further column.
OTHER, OPEN, EXTEND = -1, 11, 1


def blosum62() -> dict[tuple[str, str], int]:
    rows = [list(map(int, r.split())) for r in BLOSUM62.strip().splitlines()]
    return {(RESIDUES[i], RESIDUES[j]): rows[max(i, j)][min(i, j)] for i in range(20) for j in range(20)}


def measure(a: Column, b: Column, name: str, matrix: dict[tuple[str, str], int] | None = None) -> Column:
    """How alike two aligned sequences are, whatever their case: "nbs", the score in bits a column (matrix: half bits, of
    residue pairs in RESIDUES; BLOSUM62), a gap's columns costing OPEN and then EXTEND; "pos", the share of columns with a
    score above 0; "nbs2" and "pos2", the same without the columns at either end where one of them has only gaps.
    Columns with two gaps don't count; null without columns."""
    matrix = matrix or blosum62()
    flat = F.array(*(F.lit(matrix[x, y]) for x in RESIDUES for y in RESIDUES))
    place = lambda c: F.position(c, F.lit(RESIDUES))
    upto = lambda p: F.greatest(F.length(F.regexp_extract(a, p, 0)), F.length(F.regexp_extract(b, p, 0)))
    if name.endswith("2"):
        head, tail = upto("^-*"), upto("-*$")
        inside = F.greatest(F.length(a) - head - tail, F.lit(0))
        a, b = F.substring(a, head + 1, inside), F.substring(b, head + 1, inside)
    letters = lambda c: F.filter(F.split(F.upper(c), ""), lambda x: x != "")

    def column(x: Column, y: Column) -> Column:
        known = F.when((place(x) > 0) & (place(y) > 0), F.get(flat, (place(x) - 1) * 20 + place(y) - 1)).otherwise(OTHER)
        return F.struct(F.when((x == GAP) & (y == GAP), "").when(x == GAP, "a").when(y == GAP, "b").otherwise("=").alias("kind"), F.when((x == GAP) | (y == GAP), 0).otherwise(known).alias("score"))

    def scored(cols: Column) -> Column:
        kinds = F.array_join(F.transform(cols, lambda c: c["kind"]), "")
        gaps, opened, n = F.regexp_count(kinds, F.lit("[ab]")), F.regexp_count(kinds, F.lit("a+|b+")), F.length(kinds)
        if name.startswith("pos"):
            return F.when(n > 0, F.size(F.filter(cols, lambda c: c["score"] > 0)) / n)
        total = F.aggregate(cols, F.lit(0), lambda s, c: s + c["score"])
        return F.when(n > 0, (total - OPEN * opened - EXTEND * (gaps - opened)) * 0.5 / n)

    return F.element_at(F.transform(F.array(F.zip_with(letters(a), letters(b), column)), scored), 1)


def mask(a: Column, b: Column) -> Column:
    """A letter for each column of a pair: = same, x different, a or b a gap in that one, nothing for both."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == GAP) & (y == GAP), "").when(x == GAP, "a").when(y == GAP, "b").when(F.upper(x) == F.upper(y), "=").otherwise("x"))
    return F.array_join(chars, "")


def pair_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with matches, differences, gaps, openings (runs of gaps in one sequence) and, of these, those at either end."""
    m = F.col("_m")
    n = lambda p: F.regexp_count(m, F.lit(p))
    end = F.length(F.regexp_extract("_m", "^(a+|b+)", 1)) + F.when(n("[=x]") > 0, F.length(F.regexp_extract("_m", "(a+|b+)$", 1))).otherwise(0)
    end_runs = n("^(a+|b+)") + F.when(n("[=x]") > 0, n("(a+|b+)$")).otherwise(0)
    return df.withColumn("_m", mask(F.col(a), F.col(b))).withColumns({"matches": n("="), "differences": n("x"), "gaps": n("[ab]"), "openings": n("a+|b+"), "end_gaps": end, "end_openings": end_runs}).drop("_m")


def distance(df: DataFrame, gap_open: float = 0, gap_extend: float = 0) -> DataFrame:
    """The fraction of differences, inner gaps weighted by opening and length; from the columns of pair_stats."""
    inner, inner_runs = F.col("gaps") - F.col("end_gaps"), F.col("openings") - F.col("end_openings")
    cost = F.col("differences") + gap_open * inner_runs + gap_extend * inner
    size = F.col("matches") + F.col("differences") + gap_open * inner_runs + gap_extend * inner
    return df.withColumn("distance", F.when(size > 0, cost / size))


def identity(df: DataFrame, ends: bool = False) -> DataFrame:
    """Matches over aligned columns and inner gaps (ends: and end gaps)."""
    size = F.col("matches") + F.col("differences") + F.col("gaps") - (F.lit(0) if ends else F.col("end_gaps"))
    return df.withColumn("identity", F.when(size > 0, F.col("matches") / size))


def oligomer_identity(df: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """For each length: the share of stretches of so many aligned columns that are the same throughout."""
    text = mask(F.col(a), F.col(b))
    same, aligned = F.regexp_extract_all(text, F.lit("(=+)"), 1), F.regexp_extract_all(text, F.lit("([=x]+)"), 1)

    def stretches(runs: Column, k: int) -> Column:
        return F.aggregate(runs, F.lit(0), lambda s, r: s + F.greatest(F.length(r) - (k - 1), F.lit(0)))

    return df.withColumns({f"identity_{k}": F.when(stretches(aligned, k) > 0, stretches(same, k) / stretches(aligned, k)) for k in range(low, high + 1)})


def columns(df: DataFrame, aln: str, seq_id: str, seq: str) -> DataFrame:
    """(aln, seq_id, pos, residue), positions from 1."""
    return df.select(aln, seq_id, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("pos", "residue")).withColumn("pos", F.col("pos") + 1)


def assemble(long: DataFrame, aln: str, seq_id: str) -> DataFrame:
    return long.groupBy(aln, seq_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "residue"))), lambda c: c["residue"]), "").alias("seq"))


def pack(df: DataFrame, aln: str, seq_id: str, seq: str, keep: DataFrame | None = None) -> DataFrame:
    """Without columns of gaps only, or with the columns (aln, pos) to keep."""
    long = columns(df, aln, seq_id, seq)
    if keep is None:
        keep = long.where(F.col("residue") != GAP).select(aln, "pos").distinct()
    return assemble(long.join(keep.select(aln, "pos"), [aln, "pos"], "left_semi"), aln, seq_id)


def column_counts(df: DataFrame, aln: str, seq_id: str, seq: str) -> DataFrame:
    return columns(df, aln, seq_id, seq).groupBy(aln, "pos", "residue").agg(F.count("*").alias("n"))


def consensus(df: DataFrame, aln: str, seq_id: str, seq: str, least: float = 0, gaps: bool = False, unknown: str = "X") -> DataFrame:
    """The most frequent residue of each column (first letter of equal ones), where it has the least frequency."""
    n = column_counts(df, aln, seq_id, seq)
    if not gaps:
        n = n.where(F.col("residue") != GAP)
    total = F.sum("n").over(W.partitionBy(aln, "pos"))
    best = tables.best_per_key(n.withColumn("_t", total), [aln, "pos"], F.desc("n"), F.col("residue"))
    chosen = best.select(aln, "pos", F.when(F.col("n") >= least * F.col("_t"), F.col("residue")).otherwise(unknown).alias("residue"), F.lit("consensus").alias("_c"))
    return assemble(chosen, aln, "_c").select(aln, F.col("seq").alias("consensus"))


def trim_ends(df: DataFrame, aln: str, seq: str, quantile: float = 0.75) -> DataFrame:
    """Cut to where that share of the sequences has begun, and has not ended."""
    head, tail = F.length(F.regexp_extract(seq, "^-*", 0)), F.length(F.regexp_extract(seq, "-*$", 0))
    cut = None
    for name, gaps in (("_h", head), ("_t", tail)):  # counts of each length, not lists of sequences
        n = df.groupBy(aln, gaps.alias(name)).agg(F.count("*").alias("_c"))
        w = W.partitionBy(aln)
        placed = n.withColumns({"_upto": F.sum("_c").over(w.orderBy(name)), "_all": F.sum("_c").over(w)})
        one = placed.where(F.col("_upto") > F.floor(F.lit(quantile) * (F.col("_all") - 1) + 0.5)).groupBy(aln).agg(F.min(name).alias(name))
        cut = one if cut is None else cut.join(one, aln)
    return df.join(cut, aln).withColumn(seq, F.substring(F.col(seq), F.col("_h") + 1, F.greatest(F.length(seq) - F.col("_h") - F.col("_t"), F.lit(0)))).drop("_h", "_t")


def copies(df: DataFrame, aln: str, node: str, seq: str, *order: str) -> DataFrame:
    """(node, first): the sequences that an alignment has before, and the first of them in order (then by node). Sequences of
    gaps only are like nothing, themselves included, and aren't copies. Such a first node has the identities of its copies."""
    whole = df.where(F.col(aln).isNotNull() & (F.col(seq).rlike(f"[^{GAP}]") | (F.col(seq) == ""))).select(F.col(aln).alias("_aln"), F.col(seq).alias("_seq"), F.struct(*order, F.col(node).alias("_node")).alias("_o"))
    first = whole.groupBy("_aln", "_seq").agg(F.min("_o").alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    return graph.written(whole.join(first, ["_aln", "_seq"]).select(F.col("_o._node").alias("node"), F.col("_f._node").alias("first")).where("node <> first"))


def _identities(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, identity) of rows of x and y, upper case code points with 0 behind the end, where it is there and least or more."""
    gap = ord(GAP)
    matches = np.zeros((len(x), len(y)), np.int32)
    differences = np.zeros_like(matches)
    for p, q in zip(x.T, y.T, strict=True):
        letters = (p != gap)[:, None] & (q != gap)
        same = p[:, None] == q
        matches += letters & same & (p != 0)[:, None]
        differences += letters & ~same
    i, j = np.nonzero((matches >= least * (matches + differences)) if least > 0 else np.ones(matches.shape, bool))  # inner gaps only add
    found = []
    step = max(1, CELLS // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        u, v = x[a], y[b]
        kind = np.where(u == gap, np.where(v == gap, 0, 1), np.where(v == gap, 2, np.where((u == 0) & (v == 0), 0, 3))).astype(np.int8)
        gaps = (kind == 1).sum(1) + (kind == 2).sum(1)
        m, d = matches[a, b], differences[a, b]
        ends = np.zeros(len(a), np.int64)
        for turned in (kind, kind[:, ::-1]):
            run = np.zeros(len(a), np.int64)
            for one in (1, 2):
                run += (np.logical_and.accumulate((turned == 0) | (turned == one), axis=1) & (turned == one)).sum(1)
            ends += run if turned is kind else np.where(m + d > 0, run, 0)
        size = m + d + gaps - ends
        with np.errstate(divide="ignore", invalid="ignore"):
            identity = m / size
        keep = (size > 0) & (identity >= least)
        found.append((a[keep], b[keep], identity[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (i, j, np.zeros(0))


def identities(df: DataFrame, aln: str, node: str, seq: str, least: float = 0) -> DataFrame:
    """(a, b, identity), a < b, of all pairs of an alignment's sequences with an identity (pair_stats, identity) of `least` or
    more; node must be a long. Sequences are compared by blocks of about BLOCK, and pairs of blocks are dealt out."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    rows = df.where(F.col(aln).isNotNull() & F.col(seq).isNotNull()).select(F.col(aln).alias("_aln"), F.col(node).cast("long").alias("_id"), F.when(F.col(seq) == "", "\x01").otherwise(F.col(seq)).alias("_seq"))
    sizes = rows.groupBy("_aln").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    placed = rows.join(sizes, "_aln").withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    blocks = graph.written(placed.groupBy("_aln", "_block").agg(F.collect_list("_id").alias("ids"), F.collect_list("_seq").alias("seqs")))
    one, two = (blocks.select("_aln", F.col("_block").alias(f"{c}_block"), F.col("ids").alias(f"{c}_ids"), F.col("seqs").alias(f"{c}_seqs")) for c in "ab")
    pairs = one.join(two, "_aln").where("a_block <= b_block").repartition("_aln", "a_block", "b_block").select("a_ids", "a_seqs", "b_ids", "b_seqs")

    def points(*seqs: list[str]) -> list[np.ndarray]:
        width = max(map(len, [s for some in seqs for s in some]))
        flat = np.array([s for some in seqs for s in some], f"U{width}").view(np.uint32).reshape(-1, width)
        known, at = np.unique(flat, return_inverse=True)
        upper, number = {}, {}
        for c in map(int, known):
            number[c] = upper.setdefault(chr(c).upper(), c)
        codes = np.array([number[int(c)] for c in known], np.uint32)[at].reshape(flat.shape)
        return [codes[: len(seqs[0])], codes[len(seqs[0]) :]]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                a, x, b, y = (batch.column(i)[r].values for i in range(4))
                a, b = a.to_numpy(), b.to_numpy()
                x, y = points(x.to_pylist(), y.to_pylist())
                same, step = len(a) == len(b) and bool((a == b).all()), max(1, CELLS // len(y))
                for at in range(0, len(a), step):
                    i, j, identity = _identities(x[at : at + step], y, least)
                    keep = a[i + at] < b[j] if same else a[i + at] != b[j]
                    i, j, identity = a[i + at][keep], b[j][keep], identity[keep]
                    for low in range(0, len(i), 1 << 16):
                        c = slice(low, low + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[c], j[c])), pa.array(np.maximum(i[c], j[c])), pa.array(identity[c])], names=["a", "b", "identity"])

    return pairs.mapInArrow(part, "a long, b long, identity double")


def _with_copies(both: DataFrame, same: DataFrame | None) -> DataFrame:
    """Pairs (a, b, identity) of first nodes, in both directions, with those of their copies (a) and the first nodes (b)."""
    if same is None:
        return both
    more = both.join(same.select(F.col("node").alias("_n"), F.col("first").alias("a")), "a").select(F.col("_n").alias("a"), "b", "identity")
    return both.unionByName(more).unionByName(same.select(F.col("node").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("identity")))


def _firsts(nodes: DataFrame, same: DataFrame | None) -> DataFrame:
    return nodes if same is None else nodes.join(same.select("node"), "node", "left_anti")


def dereplicate(pairs: DataFrame, nodes: DataFrame, most_identity: float, same: DataFrame | None = None) -> DataFrame:
    """Of (a, b, identity) and nodes (node, rank): sequences kept so that no two are more alike, first ranks first.

    same: copies() by rank, whose pairs may then be left out: what drops or is the first drops the others."""
    return graph.first_independent_set(_firsts(nodes, same if most_identity < 1 else None), pairs.where(F.col("identity") > most_identity))


def dereplicate_n(pairs: DataFrame, nodes: DataFrame, n: int, bands: int = 32, same: DataFrame | None = None) -> tuple[float | None, DataFrame]:
    """Exactly n sequences, or all if there are fewer, and the greatest identity that was allowed.

    The bounds tried are the borders of so many bands of the pairs' identities, all in the same rounds over pairs that are
    written once. Of those that leave n or more the smallest is taken, then the first n by rank. With a bound as large as
    the largest identity all are left; pairs without one don't count as alike. same: as for dereplicate()."""
    near = graph.written(pairs.select("a", "b", F.col("identity").alias("score")).where("score is not null"))
    said = near.select("score") if same is None else near.select("score").unionByName(same.limit(1).select(F.lit(1.0).alias("score")))
    limits = said.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if limits.low is None:
        return None, tables.top_n(nodes, n, [F.col("rank"), F.col("node")]).select("node")
    bounds = sorted({0.0, *(limits.low + (limits.high - limits.low) * i / bands for i in range(bands)), limits.high})
    sets = graph.written(graph.independent_sets(_firsts(nodes, same), near, bounds, strict=True))
    sizes = {r.threshold: r.n for r in sets.groupBy("threshold").agg(F.count("*").alias("n")).collect()}  # a row a bound
    if same is not None and limits.high == 1:  # copies are no more alike than that
        sizes[limits.high] = sizes.get(limits.high, 0) + same.count()
    best = min((b for b in bounds if sizes.get(b, 0) >= n), default=limits.high)
    kept = sets.where(F.col("threshold") == best).select("node")
    kept = (kept if same is None or best < 1 else kept.unionByName(same.select("node"))).join(nodes, "node")
    return best, tables.top_n(kept, n, [F.col("rank"), F.col("node")]).select("node")



def cluster(pairs: DataFrame, nodes: DataFrame, t: float, same: DataFrame | None = None) -> DataFrame:
    """(node, rep): in order of rank a sequence no more like any representative than t founds a group; others join the
    group of the most similar representative that comes before them (of equal ones the first). same: as for dereplicate()."""
    same = same if t < 1 else None
    near = pairs.where(F.col("identity") > t)
    founders = graph.written(graph.first_independent_set(_firsts(nodes, same), near))
    both = _with_copies(near.select("a", "b", "identity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity")), same)
    rank = nodes.select("node", "rank")
    options = both.join(founders.select(F.col("node").alias("b")), "b", "left_semi").join(founders.select(F.col("node").alias("a")), "a", "left_anti")
    options = options.join(rank.select(F.col("node").alias("a"), F.struct("rank", "node").alias("_a")), "a").join(rank.select(F.col("node").alias("b"), F.struct("rank", "node").alias("_b")), "b").where("_b < _a")
    joined = options.groupBy("a").agg(F.min(F.struct((-F.col("identity")).alias("i"), "_b")).alias("m")).select(F.col("a").alias("node"), F.col("m._b.node").alias("rep"))
    return joined.unionByName(founders.select("node", F.col("node").alias("rep")))


def cluster_extended(pairs: DataFrame, nodes: DataFrame, t: float, power: float = 0.8, same: DataFrame | None = None) -> DataFrame:
    """(node, rep, is_rep): like cluster, but a group may have further representatives. In order of rank a sequence more
    alike than t ** power to a representative joins the group of the first such; one more alike than t becomes a further
    representative in the group of the most similar one (of equal ones the first); others found a group, whose rep they are.
    same: as for dereplicate().
    """
    same = same if t < 1 and t**power < 1 else None
    close = F.col("identity") > t**power
    near = pairs.where(F.col("identity") > t)
    found = graph.written(graph.first_independent_set(_firsts(nodes, same), near.where(close)))
    both = _with_copies(near.select("a", "b", "identity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity")), same)
    rank = nodes.select("node", F.struct("rank", "node").alias("_r"))
    before = both.join(found.select(F.col("node").alias("b")), "b", "left_semi").join(rank.toDF("a", "_a"), "a").join(rank.toDF("b", "_b"), "b").where("_b < _a")
    choice = F.min(F.struct((~close).alias("far"), F.when(close, 0.0).otherwise(-F.col("identity")).alias("i"), "_b"))
    joins = graph.written(before.groupBy("a").agg(choice.alias("m")).select("a", F.col("m._b.node").alias("b")))
    trees = graph.components(nodes, joins)  # each has one node that joins none
    founders = trees.join(joins.select(F.col("a").alias("node")), "node", "left_anti").select("component", F.col("node").alias("rep"))
    return trees.join(founders, "component").join(found.select("node", F.lit(True).alias("_is")), "node", "left").select("node", "rep", F.coalesce("_is", F.lit(False)).alias("is_rep"))


def bootstrap(df: DataFrame, aln: str, seq_id: str, seq: str, seed: int = 1) -> DataFrame:
    """Each alignment's columns drawn with replacement; the same draw for all its sequences."""
    long = columns(df, aln, seq_id, seq)
    size = long.groupBy(aln).agg(F.max("pos").alias("_n"))
    drawn = size.select(aln, "_n", F.explode(F.sequence(F.lit(1), "_n")).alias("pos")).withColumn("_from", (tables.share(seed, aln, "pos", parts=F.col("_n")) + 1).cast("int"))
    picked = long.withColumnRenamed("pos", "_from").join(drawn.select(aln, "pos", "_from"), [aln, "_from"])
    return assemble(picked, aln, seq_id)


def supermatrix(df: DataFrame, role: str, genome: str, seq: str) -> DataFrame:
    """(role, genome, seq): the longest sequence of each, of roles that every genome has."""
    best = df.groupBy(role, genome).agg(F.min(F.struct((-F.length(seq)).alias("l"), F.col(seq).alias("s"))).alias("b")).select(role, genome, F.col("b.s").alias(seq))
    return tables.complete_in_all(best, role, genome)


def filter_similar(pairs: DataFrame, id_col: str, least: float) -> DataFrame:
    """Ids whose identity with some reference (pairs with their identity) is at least that."""
    return pairs.where(F.col("identity") >= least).select(id_col).distinct()


def like_earlier(df: DataFrame, aln: str, node: str, seq: str, least: float) -> DataFrame:
    """(b): nodes whose identity with some smaller node of their alignment is `least` or more."""
    same = copies(df, aln, node, seq) if least <= 1 else None
    firsts = df if same is None else df.join(same.select(F.col("node").alias(node)), node, "left_anti")
    near = identities(firsts, aln, node, seq, least)
    both = near.select("a", "b", "identity").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity"))
    return _with_copies(both, same).where("b < a").select(F.col("a").alias("b")).distinct()
