"""Hand-computed cases: ties, empty inputs and the decisions named in docstrings."""

import math
import random

from pyspark.sql import functions as F

from strandframe.functions import seq, text
from strandframe.operators import align, bins, codon, features, graph, kmers, matrix, ml, quality, reads, reps, roles, signatures, stats, tables
from strandframe.sources import files


def test_kmers_shorter_equal_and_longer_than_k(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "abcde"), (4, "aaaaa"), (5, None)], "id long, s string")
    n = lambda tail: {r.id: r.n for r in kmers.explode(df, "id", "s", 4, tail).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert n("keep") == {2: 1, 3: 2, 4: 2} and n("drop") == {3: 1, 4: 1}


def test_occurrences_against_sets(spark):
    a, b = spark.createDataFrame([(1, "aaab")], "a long, s string"), spark.createDataFrame([(9, "aaaab")], "b long, s string")
    assert kmers.pair_similarity(a, b, "a", "b", "s", 2).first().score == 4
    assert kmers.pair_similarity(a, b, "a", "b", "s", 2, mode="set").first().score == 2


def test_all_pairs_by_prefix_equals_all_pairs(spark):
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(25)]
    sets = [{s[i : i + 3] for i in range(len(s) - 2)} for s in seqs]
    want = {(i, j, len(sets[i] & sets[j])) for i in range(25) for j in range(25) if i != j and len(sets[i] & sets[j]) >= 4}
    got = kmers.all_pairs(spark.createDataFrame(list(enumerate(seqs)), "id long, s string"), "id", "s", 3).collect()
    assert {(r.a, r.b, r.score) for r in got} == want


def test_all_pairs_of_occurrences(spark):
    rnd = random.Random(4)
    seqs = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))) for _ in range(25)] + ["aaaaaaa", "aaa", "", None]
    cut = [[s[i : i + 3] for i in range(len(s) - 3)] if s else [] for s in seqs]  # without the last one
    n = len(seqs)
    scores = {(i, j, sum(m in set(cut[i]) for m in cut[j])) for i in range(n) for j in range(n) if i != j}
    got = kmers.all_pairs_occurrences(spark.createDataFrame(list(enumerate(seqs)), "id long, s string"), "id", "s", 3, 4).collect()
    assert {(r.a, r.b, r.score) for r in got} == {x for x in scores if x[2] >= 4}


def test_order_comparison_with_and_without_zero_bin(spark):
    rows = [([3, 2, 1], [9, 8, 7]), ([3, 2, 1], [9, 7, 8]), ([2, 2, 1], [5, 6, 1]), ([3, 0, 1], [4, 0, 9]), ([3, 0, 1], [5, 1, 4]), ([1], [2])]
    v = spark.createDataFrame([tuple(list(map(float, c)) for c in r) for r in rows], "x array<double>, y array<double>")
    got = lambda **k: [r[0] for r in v.select(bins.compare_order(F.col("x"), F.col("y"), **k)).collect()]
    assert got() == [1, 0, 0, 0, 1, 1]
    assert got(top=1) == [1, 1, 0, 0, 1, 1]
    assert got(strict=True) == [1, 0, 0, 1, 0, 1]


def test_clusters_with_further_representatives(spark):
    rnd = random.Random(5)
    n, t = 40, 0.7
    alike = {(i, j): rnd.choice([0.5, 0.69, 0.7, 0.72, 0.74, 0.8, 0.9]) for i in range(n) for j in range(i) if rnd.random() < 0.15}
    reps, group = [], {}
    for i in range(n):  # one after the other
        near = [(r, alike.get((i, r), 0)) for r in reps]
        close = [r for r, v in near if v > t**0.8]
        far = [(-v, r) for r, v in near if v > t]
        group[i] = group[close[0]] if close else group[min(far)[1]] if far else i
        if not close:
            reps.append(i)
    pairs = spark.createDataFrame([(i, j, v) for (i, j), v in alike.items()], "a long, b long, identity double")
    got = align.cluster_extended(pairs, spark.createDataFrame([(i, i) for i in range(n)], "node long, rank long"), t).collect()
    assert {(r.node, r.rep, r.is_rep) for r in got} == {(i, group[i], i in reps) for i in range(n)}
    assert len(got) == n and len(reps) > len(set(group.values()))
    assert align.cluster_extended(pairs.limit(0), spark.createDataFrame([], "node long, rank long"), t).count() == 0


def test_medians_and_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0)], "k string, v double")
    got = {r.k: (r.q50, r.q0, r.q100) for r in stats.quantile(df, ["k"], "v", [0.5, 0.0, 1.0]).collect()}
    assert got == {"a": (2.5, 1.0, 10.0), "b": (5.0, 5.0, 5.0)}
    assert {r.k: r.sd is None for r in stats.mean_sd(df, ["k"], "v").collect()} == {"a": False, "b": True}


def test_contingency_with_an_empty_leading_column(spark):
    cells = [("r1", "c0", 0), ("r1", "c1", 10), ("r1", "c2", 20), ("r2", "c1", 20), ("r2", "c2", 10), ("r3", "c1", 0)]
    r = stats.contingency(spark.createDataFrame(cells, "r string, c string, n long"), [], "r", "c", "n").first()
    assert math.isclose(r.chi_square, 20 / 3) and r.df == 1


def test_p_values(spark):
    cases = [(1, 3.841458820694124, 0.05), (10, 18.307038053275146, 0.05), (2, 10.0, math.exp(-5)), (4, 6.0, math.exp(-3) * 4), (3, 1e-9, 1.0), (1, 0.0, 1.0), (1, 100.0, math.erfc(math.sqrt(50))), (41, 300.0, None), (0, 1.0, "null"), (5, None, "null")]
    got = spark.createDataFrame([(i, d, x) for i, (d, x, _) in enumerate(cases)], "i int, d int, x double").select("i", codon.upper_chi_square(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        want = cases[r.i][2]
        assert r.p is None if want == "null" else 0 < r.p < 1e-30 if want is None else math.isclose(r.p, want, rel_tol=1e-9)


def test_pair_measures_and_terminal_gaps(spark):
    df = spark.createDataFrame([(0, "--ACW-", "MMAC-K"), (1, "WW", "ww"), (2, "A-C", "A-C"), (3, "-", "A"), (4, "", ""), (5, "AXA", "AAB"), (6, "--A", "A--")], "i int, x string, y string")
    got = {r.i: r for r in df.select("i", *(align.measure(F.col("x"), F.col("y"), m).alias(m) for m in ("nbs", "pos", "nbs2", "pos2"))).collect()}
    assert got[0].pos == 2 / 6 and got[0].nbs == (4 + 9 - 11 - 1 - 11 - 11) * 0.5 / 6  # three runs of gaps, one of two columns
    assert got[0].pos2 == 2 / 3 and got[0].nbs2 == (4 + 9 - 11) * 0.5 / 3  # both ends are cut, the gap under W isn't
    assert got[1].nbs == got[1].nbs2 == 5.5 and got[1].pos == 1
    assert got[2].nbs == (4 + 9) * 0.5 / 2 and got[2].pos == 1  # a column of two gaps doesn't count
    assert got[3].nbs == -5.5 and got[3].pos == 0 and got[3].nbs2 is None and got[4].nbs is None and got[4].pos is None
    assert got[5].nbs == (4 - 1 - 1) * 0.5 / 3 and got[5].pos == 1 / 3
    assert got[6].pos2 is None and got[6].nbs == (-11 - 11) * 0.5 / 2
    matrix = align.blosum62()
    assert len(matrix) == 400 and all(matrix[x, y] == matrix[y, x] for x, y in matrix) and matrix["W", "W"] == 11 and matrix["I", "V"] == 3 and matrix["D", "E"] == 2


def test_match_scores(spark):
    matches = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "g long, h long")
    left = [(1, p, k) for p, ks in (("a", "xyz"), ("b", "xy"), ("c", "q")) for k in ks] + [(2, "a", "x"), (9, "z", "x")]
    right = [(10, p, k) for p, ks in (("u", "xyz"), ("v", "xy"), ("w", "q"), ("s", "t")) for k in ks] + [(20, "u", "y")]
    got = reps.match_scores(matches, spark.createDataFrame(left, "g long, p string, kmer string"), spark.createDataFrame(right, "h long, p string, kmer string"), "g", "h", "p")
    # a and u share most; b's best is u, so b and v have no partner; c and w have each other
    assert {(r.g, r.h): (r.pairs, r.score) for r in got.collect()} == {(1, 10): (2, 100 * 2 / (2 + 1.5)), (2, 20): (0, 0.0), (3, 30): (0, 0.0)}


def test_distance_range_counts_pairs_that_share_nothing(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    near = spark.createDataFrame([(0, 1, 0.25), (0, 2, 0.5), (1, 2, 0.5), (0, 3, 0.5)], "a long, b long, distance double")
    got = {r.id: (r.n, r.nearest, r.farthest, r.mean) for r in reps.distance_range(near, nodes, "id").collect()}
    assert got == {0: (3, 0.25, 0.5, 1.25 / 3), 1: (3, 0.25, 1.0, 1.75 / 3), 2: (3, 0.5, 1.0, 2 / 3), 3: (3, 0.5, 1.0, 2.5 / 3)}
    one = reps.distance_range(near.limit(0), nodes.limit(1), "id").first()
    assert (one.n, one.nearest, one.farthest, one.mean) == (0, None, None, None)


def test_sets_of_a_size(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(6)], "node long, rank long")
    near = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (3, 4, 0.7), (3, 5, 0.2), (1, 5, None)], "a long, b long, identity double")
    for n in range(1, 7):
        bound, kept = align.dereplicate_n(near, nodes, n)
        assert kept.count() == n
    bound, kept = align.dereplicate_n(near, nodes, 3)
    assert bound < 0.8 and {r.node for r in kept.collect()} == {0, 3, 5}
    assert align.dereplicate_n(near.limit(0), nodes, 2)[0] is None
    pairs = near.where("identity is not null").select("a", "b", (10 * F.col("identity")).cast("int").alias("score"))
    threshold, kept = reps.n_reps(pairs, nodes, 3, [1, 3, 8, 9])
    assert threshold == 3 and {r.node for r in kept.collect()} == {0, 3, 5}


def test_relabelled_bins(spark):
    report = spark.createDataFrame([(f"s{i}", f"{i}.1", f"name{i}", "") for i in range(1, 6)], "sample string, bin string, name string, ref string")
    lines = ["Processing 1.1", "noise", "Creating new GenomePackage 2.1 now", "Processing 2.1", "Creating new GenomePackage 3.1", "Creating new GenomePackage 9.9", "Processing 3.1", "Creating new GenomePackage 1.1", "Processing 5.1", "Creating new GenomePackage 2.1"]
    log = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    got = {r.bin: (r.sample, r.ref) for r in quality.relabel(report, log, "n", "line", "bin", "sample", "name", "ref").collect()}
    assert got == {"1.1": ("s1", "name3 (fine-trimmed)"), "2.1": ("s5", "name5 (fine-trimmed)"), "3.1": ("s1", "name2 (fine-trimmed)"), "4.1": ("s4", ""), "5.1": ("s5", "")}


def test_sweep_summary_takes_values_by_place(spark):
    sweeps = spark.createDataFrame([("k", float(v)) for v in (9, 1, 5, 3, 7, 2, 8)] + [("one", 50.0)], "k string, accuracy double")
    got = {r.k: tuple(r)[1:] for r in ml.sweep_summary(sweeps, ["k"]).collect()}
    assert got["k"] == (5.0, 1.0, 2.0, 5.0, 8.0, 9.0, 5.0, 6.0) and got["one"] == (50.0,) * 7 + (0.0,)


def test_equal_records_are_blocks_of_their_own(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\nb\n//\na\nb\n//\nc\n//\n")
    got = files.read_blocks(spark, str(tmp_path))
    blocks = {}
    for r in got.collect():
        blocks.setdefault(r.block, {})[r.pos] = r.line
    assert sorted(map(str, blocks.values())) == sorted(map(str, [{0: "a", 1: "b"}, {0: "a", 1: "b"}, {0: "c"}]))


def test_intervals_touching_nested_equal(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 11, 20), ("c", 12, 15), ("c", 12, 15), ("c", 30, 40), ("d", 21, 22)], "c string, l long, r long")
    assert sorted(map(tuple, features.merge(df, "c", "l", "r").collect())) == [("c", 1, 20), ("c", 30, 40), ("d", 21, 22)]
    assert sorted(map(tuple, features.merge(df, "c", "l", "r", gap=9).collect())) == [("c", 1, 40), ("d", 21, 22)]
    again = features.merge(features.merge(df, "c", "l", "r"), "c", "l", "r")
    assert again.count() == 3


def test_locate_boundaries(spark):
    seg = spark.createDataFrame([("k", 1, 5), ("k", 2, 5)], "k string, s long, n long")
    at = spark.createDataFrame([("k", p) for p in (0, 1, 5, 6, 10, 11)], "k string, p long")
    assert {r.p: r.s for r in features.locate(at, seg, "k", "p", "s", "n").collect()} == {0: None, 1: 1, 5: 1, 6: 2, 10: 2, 11: None}


def test_codons(spark):
    genes = spark.createDataFrame([("a", "ATGAAAUUUTAA"), ("b", "ATG"), ("c", "ATGNNNTAACCC"), ("d", "")], "g string, s string")
    assert sorted(map(tuple, codon.counts(genes, "g", "s").collect())) == [("a", "AAA", 1), ("a", "TTT", 1), ("c", "CCC", 1), ("c", "TAA", 1)]
    assert seq.genetic_code()["ATG"] == "M" and seq.genetic_code()["TGA"] == "*"
    row = spark.createDataFrame([("acgUN-",)], "s string").select(seq.revcomp(F.col("s")).alias("r"), seq.translate(F.lit("ATGNNN")).alias("t")).first()
    assert (row.r, row.t) == ("-NAcgt", "Mx")


def test_alignment_gaps(spark):
    df = spark.createDataFrame([("--ACG-T-", "-TAC--TA"), ("A-C-", "-A-C")], "x string, y string")
    got = [tuple(r)[2:] for r in align.identity(align.pair_stats(df, "x", "y")).collect()]
    assert got[0][:6] == (3, 0, 3, 3, 2, 2) and got[1][:4] == (0, 0, 4, 4)


def test_rank_comparison_and_vectors(spark):
    v = spark.createDataFrame([([3.0, 2.0, 1.0, 0.0], [3.0, 2.0, 1.0, 5.0]), ([3.0, 2.0, 1.0, 0.0], [1.0, 2.0, 3.0, 0.0]), ([0.0], [0.0])], "x array<double>, y array<double>")
    got = v.select(bins.compare_rank(F.col("x"), F.col("y")).alias("r"), bins.compare_dist(F.col("x"), F.col("y")).alias("d")).collect()
    assert [r.r for r in got] == [4, -5, 1] and math.isclose(got[0].d, 3.5) and got[2].d == 0


def test_reads_merge(spark):
    left = "ACGTACGGTTACGGATTACAGGCATTGCAC"
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole = left + "TTTTT"
    df = spark.createDataFrame([(left, rc(whole[10:])), (left, rc("G" * 30)), ("AC", "GT")], "l string, r string")
    got = reads.merge_pairs(df, "l", "r", probe=10).collect()
    assert (got[0].merged, got[0].overlap) == (whole, 20) and got[1].merged is None and got[2].merged is None
    assert reads.merge_pairs(df, "l", "r", probe=10, strict=True).first().merged == whole


def test_region_takes_whole_slices(spark):
    close = spark.createDataFrame([("q", "r1", 90), ("q", "r2", 50), ("q", "r3", 40)], "q string, rep string, score long")
    members = spark.createDataFrame([(r, f"{r}m{i}", 10 - i) for r in ("r1", "r2", "r3") for i in range(4)], "rep string, m string, score long")
    got = reps.region(close, members, "q", "rep", "m", size=4, per_group=3)
    assert sorted(r.m for r in got.collect()) == ["r1m0", "r1m1", "r1m2", "r2m0", "r2m1", "r2m2"]


def test_kfold_is_consecutive(spark):
    folds = {r.fold: r.n for r in matrix.kfold(spark.range(25), "id", 10).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert folds == {0: 10, 1: 10, 2: 5}


def test_column_predictors_learn(spark):
    rnd, cells = random.Random(1), []
    for i in range(400):
        on = rnd.random() < 0.5
        cells += [(i, "a", 1), (i, "b", 1)] if on else [(i, "c", 1)]
        cells += [(i, "d", 1)] * (rnd.random() < 0.5)
    folds = ml.column_predictors(spark.createDataFrame(cells, "row long, col string, n long"))
    good = {r.col: r.mean for r in ml.accuracy_summary(folds).collect()}
    assert good["a"] == good["b"] == good["c"] == 100 and good["d"] < 70
    assert {r.col for r in ml.select_roles(ml.accuracy_summary(folds)).collect()} == {"a", "b", "c"}


def test_holdout(spark):
    rows = [(i, float(i % 7), float(i % 2), i % 2) for i in range(300)]
    got = ml.holdout(spark.createDataFrame(rows, "id long, x double, y double, label int"), ["x", "y"], "label", "id", sweeps=1).first()
    assert got.accuracy == 1.0 and 30 < got.n < 90


def test_roles_and_words(spark):
    r = spark.createDataFrame([("A thing (EC 1.1.1.1) / B thing @ C # note",)], "f string").select(roles.roles_of(F.col("f")).alias("r"), text.first_words(F.lit(" Genus  species x"), 2).alias("w")).first()
    assert r.r == ["A thing (EC 1.1.1.1)", "B thing", "C"] and r.w == "Genus species"
    names = spark.createDataFrame([("a", "b"), ("A  THING (EC 2.3.-.-)", "a thing")], "x string, y string")
    assert [x.same for x in names.select((roles.checksum(F.col("x")) == roles.checksum(F.col("y"))).alias("same")).collect()] == [False, True]


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one two\nAC\r\nGT\n>y\n\n>z c\nTT")
    assert sorted(map(tuple, files.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("x", "one two", "ACGT"), ("y", "", ""), ("z", "c", "TT")]
    (tmp_path / "l.fq").write_text("@r1/1\nAC\n+\n@I\n@r2/1\nGG\n+r2\n!!\n")
    (tmp_path / "r.fq").write_text("@r1/2\nTT\n+\nII\n@r2/2\nCC\n+\nII\n")
    got = files.read_fastq(spark, str(tmp_path / "l.fq"), str(tmp_path / "r.fq")).collect()
    assert sorted(map(tuple, got)) == [("r1", 1, "AC", "@I"), ("r1", 2, "TT", "II"), ("r2", 1, "GG", "!!"), ("r2", 2, "CC", "II")]
    (tmp_path / "i.fq").write_text("@a/1\nA\n+\nI\n@a/2\nC\n+\nI\n")
    assert sorted(map(tuple, files.read_fastq(spark, str(tmp_path / "i.fq"), interlaced=True).collect())) == [("a", 1, "A", "I"), ("a", 2, "C", "I")]
    (tmp_path / "g.gff").write_text("##gff\nc1\ts\tCDS\t5\t9\t.\t+\t0\tID=g%201;Note=a,b\nc1\ts\tCDS\t1\t3\t.\t+\t0\tID=g%201;Note=c\nc1\ts\tCDS\t1\t3\t.\t-\t0\tID=h\nc2\ts\tCDS\t1\t3\t.\t-\t0\tID=h\n")
    g = files.read_gff(spark, str(tmp_path / "g.gff")).collect()
    assert len(g) == 1 and g[0].id == "g 1" and g[0].attributes["Note"] == ["a", "b", "c"] and [tuple(s) for s in g[0].segments] == [(1, 3), (5, 9)]
    (tmp_path / "g.json").write_text('{"id": "1.2", "scientific_name": "G s", "contigs": [{"id": "c", "dna": "ACGT"}], "features": [{"id": "f", "type": "CDS", "function": "x", "location": [["c", "1", "+", "3"]], "family_assignments": [["PGF", "F1", "x", "1"]]}]}')
    genomes, contigs, feats = files.read_genomes(spark, str(tmp_path / "g.json"))
    assert genomes.first().name == "G s" and contigs.first().len == 4 and feats.first().location[0].len == 3
    assert features.table(feats, "genome_id", "fid", F.col("location"), F.col("family"), "PGF").first().family == "F1"


def test_rep_database(spark, tmp_path):
    r = spark.createDataFrame([("a", "A", "ACGT"), ("b", None, "TT")], "id string, name string, seq string")
    files.save_reps(str(tmp_path / "db"), r, spark.createDataFrame([("g", "a", 7)], "genome_id string, rep_id string, score int"), 8, 100)
    got, members, k, score = files.load_reps(spark, str(tmp_path / "db"))
    assert (got.count(), members.count(), k, score) == (1, 1, 8, 100)


def test_listing_update_and_names(spark):
    r = spark.createDataFrame([("a",), ("b",)], "rep string")
    m = spark.createDataFrame([("a", "x", 5), ("a", "y", 9), ("a", "a", 99)], "rep string, member string, score long")
    names = spark.createDataFrame([("x", "X")], "member string, name string")
    got = sorted((x.rep, x.position, x.member, x.name) for x in reps.listing(r, m, names, "rep", "member", "name").collect())
    assert got == [("a", 0, "a", "<unknown>"), ("a", 1, "y", "<unknown>"), ("a", 2, "x", "X"), ("b", 0, "b", "<unknown>")]


def test_within_sigma_of_one_and_split(spark):
    df = spark.createDataFrame([("d", 5.0), ("e", 1.0), ("e", 1.0)], "d string, v double")
    assert tables.within_sigma(df, "d", "v").count() == 3
    a, b = tables.split(spark.range(1000), "id", 0.3)
    assert a.count() + b.count() == 1000 and 220 < a.count() < 380


def test_numbers_over_all_rows(spark):
    rows = [(i * 7 % 50, i % 3) for i in range(50)] + [(None, 1)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = {(r.a, r.b): r.n for r in tables.numbered(df, [F.desc("b"), F.col("a")], "n").collect()}
    order = sorted(rows, key=lambda r: (-r[1], -1 if r[0] is None else r[0]))
    assert got == {r: i + 1 for i, r in enumerate(order)}
    assert tables.numbered(df.limit(0), [F.col("a")], "n").count() == 0


def test_runs_of_rows(spark):
    df = spark.createDataFrame([("u", i, k) for i, k in enumerate(["a", "a", None, None, "b", "a"])] + [("v", 0, None)], "u string, i int, k string")
    assert [r.run for r in tables.group_rows(df, "u", ["i"], "k").orderBy("u", "i").collect()] == [1, 1, 2, 2, 3, 4, 1]


def test_update_has_a_floor_and_skips(spark):
    scores = spark.createDataFrame([(1, 9, 50), (2, 9, 5), (3, 9, 50), (4, 8, 70)], "q int, r int, score int")
    members = spark.createDataFrame([(4, 9, 60)], "q int, r int, score int")
    out = reps.update(members, scores, "q", "r", least=10, skip=spark.createDataFrame([(3,)], "q int"))
    assert sorted((x.q, x.r) for x in out.collect()) == [(1, 9), (4, 9)]
    assert sorted((x.side, x.id) for x in reps.orphans(members, scores, scores, "q", "r").collect()) == [("left", "1"), ("left", "2"), ("left", "3"), ("right", "8")]


def test_equal_ranks_in_one_pass(spark):
    pairs = spark.createDataFrame([(1, 2, 20), (2, 1, 20)], "a long, b long, score long")
    nodes = spark.createDataFrame([(1, 5), (2, 5)], "node long, rank int")
    assert sorted((r.node, r.rep) for r in reps.crude(pairs, nodes, 12).collect()) == [(1, 1), (2, 1)]


def test_a_family_that_is_absent(spark):
    df = spark.sql("SELECT 'g' AS g, 'f' AS f, array(named_struct('contig', 'c', 'begin', 1, 'strand', '+', 'len', 9)) AS l, array(named_struct('db', 'x', 'id', 'y')) AS m")
    assert features.table(df, "g", "f", F.col("l"), F.col("m"), "PGF").first().family is None


def test_signatures_by_names_or_hashes(spark):
    kmers = spark.createDataFrame([("aa", "x"), ("aa", "y"), ("ab", "x"), ("ac", "y"), ("ac", "y"), ("ad", None)], "kmer string, g string")
    by_hash = signatures.build(kmers, "g", kmers)
    assert sorted(map(tuple, by_hash.collect())) == sorted(map(tuple, signatures.build(kmers.where("g is not null"), "g").collect())) == [("ab", "x"), ("ac", "y")]


def test_coded_kmers_are_the_kmers(spark, monkeypatch):
    rnd = random.Random(8)
    df = spark.createDataFrame([(rnd.choice([1, 2, 3, None]), i, "".join(rnd.choice("abz") for _ in range(rnd.randrange(40)))) for i in range(60)] + [(1, 99, None)], "g long, i long, s string").coalesce(1)
    for letters in (1 << 21, 50):  # sequences over the border of two parts
        monkeypatch.setattr(kmers, "LETTERS", letters)
        for k in (1, 4, 13):  # of 13 letters only three ids fit one number
            for ids in (["g"], ["i"], ["g", "i"]):
                coded = kmers.coded(df, ids, "s", k).groupBy(*ids, kmers.decoded(F.col("kmer"), k).alias("kmer")).agg(F.sum("n").alias("n"))
                want = kmers.explode(df, ids, "s", k).groupBy(*ids, "kmer").agg(F.count("*").alias("n"))
                assert sorted(map(str, coded.collect())) == sorted(map(str, want.collect()))


def test_kmers_of_reads_are_never_broadcast(spark):
    """Spark takes them for as small as the reads."""
    reads = kmers.coded(spark.createDataFrame([(1, "abcabc")], "id long, s string"), "id", "s", 3)
    own = signatures.of_letters(spark.createDataFrame([("x", "abcd"), ("y", "xabc"), (None, "zzz")], "g string, s string"), "g", "s", 3)
    assert sorted((kmers_, g) for kmers_, g in own.select(kmers.decoded(F.col("kmer"), 3), "g").collect()) == [("bcd", "x"), ("xab", "y")]
    for df in (signatures.evidence(reads, own, "id", "g"), signatures.assign(reads, own, "id", "g"), kmers.voted(own, reads, "g", "id", "none")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "leftHint=(strategy=merge)" in plan


def test_identities_by_blocks_and_copies_give_the_rows_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    made = ["".join(rnd.choice("aAb-") for _ in range(rnd.choice([0, 4, 6, 6]))) for _ in range(25)] + ["------"]
    df = spark.createDataFrame([(rnd.choice([1, 1, 2]), i, rnd.choice(made), 0) for i in range(70)] + [(1, 90, None, 0), (None, 91, "aab", 0)], "aln int, id long, seq string, rank int").withColumn("rank", -F.length("seq")).na.fill(0, ["rank"])
    df = spark.createDataFrame(df.collect(), df.schema)
    nodes = df.select(F.col("id").alias("node"), "rank")
    both = df.select("aln", F.col("id").alias("a"), F.col("seq").alias("x")).join(df.select("aln", F.col("id").alias("b"), F.col("seq").alias("y")), "aln").where("a < b")
    pairs = graph.written(align.identity(align.pair_stats(both, "x", "y")).select("a", "b", "identity"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(pairs.where("identity is not null"))
    for block, cells in ((2000, 1 << 22), (7, 60)):
        monkeypatch.setattr(align, "BLOCK", block)
        monkeypatch.setattr(align, "CELLS", cells)
        assert rows(align.identities(df, "aln", "id", "seq")) == want
        assert rows(align.identities(df, "aln", "id", "seq", 0.7)) == [r for r in want if r[2] >= 0.7]
    same = align.copies(df, "aln", "id", "seq", "rank")
    assert same.count() > 10
    few = graph.written(align.identities(df.join(same.select(F.col("node").alias("id")), "id", "left_anti"), "aln", "id", "seq"))
    assert few.count() < pairs.count() / 3
    for t in (0.6, 1.0):
        assert rows(align.dereplicate(few, nodes, t, same)) == rows(align.dereplicate(pairs, nodes, t))
        assert rows(align.cluster(few, nodes, t, same)) == rows(align.cluster(pairs, nodes, t))
        assert rows(align.cluster_extended(few, nodes, t, same=same)) == rows(align.cluster_extended(pairs, nodes, t))
        assert rows(align.like_earlier(df, "aln", "id", "seq", t)) == rows(align.filter_similar(pairs, "b", t))
    for n in (3, 60):
        one, two = align.dereplicate_n(few, nodes, n, 4, same), align.dereplicate_n(pairs, nodes, n, 4)
        assert one[0] == two[0] and rows(one[1]) == rows(two[1])


def test_kmers_of_one_group_by_buckets(spark, monkeypatch):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.choice([-5, 7, 2**62]), "".join(rnd.choice("abz") for _ in range(rnd.randrange(40)))) for _ in range(60)] + [(7, None)], "g long, s string").repartition(3)
    df = spark.createDataFrame(df.collect(), df.schema)
    for letters in (1 << 21, 50):
        monkeypatch.setattr(kmers, "LETTERS", letters)
        for k in (1, 2, 4, 13):
            got = kmers.of_one_group(df, "g", "s", k).select(kmers.decoded(F.col("kmer"), k).alias("kmer"), "g")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, signatures.build(kmers.explode(df, "g", "s", k), "g").collect()))


def test_common_letters_are_those_of_common(spark, monkeypatch):
    rnd = random.Random(4)
    seqs = [("".join(rnd.choice("abz") for _ in range(rnd.randrange(60)))) for _ in range(40)] + [None, "z" * 70]
    df = spark.createDataFrame(list(enumerate(seqs)), "b long, s string").repartition(3)
    sets = df.where("b % 3 = 0 or b > 38").withColumnRenamed("b", "a")
    for letters in (1 << 21, 50):
        monkeypatch.setattr(kmers, "LETTERS", letters)
        for k in (2, 5, 26):
            want = kmers.common(kmers.explode(sets, "a", "s", k), kmers.explode(df, "b", "s", k), "a", "b")
            assert sorted(map(tuple, kmers.common_letters(sets, df, "a", "b", "s", k).collect())) == sorted(map(tuple, want.collect())) != []
