"""Running sums, carried values, dealt-out joins and grid counts on tables where one key holds most rows."""

import itertools
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandframe.operators import bins, features, kmers, stats, tables


def skewed(n=400):
    rnd = random.Random(7)
    return [(rnd.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), rnd.randrange(50), i, rnd.choice([None, 1, 2, 3])) for i in range(n)]


def test_running_sums(spark):
    rows = skewed()
    got = tables.running(spark.createDataFrame(rows, "k string, v long, id long, w long").repartition(6), ["k"], [F.desc("v"), F.col("id")], {"w": F.col("w"), "before": F.lit(1)})
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        total = sum(r[3] or 0 for r in mine)
        for i, r in enumerate(mine):
            want.add((*r[:3], sum(x[3] or 0 for x in mine[:i]), total, i, len(mine)))
    assert {tuple(r) for r in got.select("k", "v", "id", "w", "w_all", "before", "before_all").collect()} == want and got.count() == len(rows)


def test_a_hot_key_is_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small ranges aren't put together
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.lit("b")).otherwise("a").alias("k"), "id")
    placed = rows.repartitionByRange("k", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) > 2 and max(r["count"] for r in placed) < 12_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stats.quantile(rows, ["k"], "id", [0.5]).where("k = 'a'").first().q50 == sorted(i for i in range(20_000) if i % 50)[9799] / 2 + sorted(i for i in range(20_000) if i % 50)[9800] / 2


def test_carried_values(spark):
    rows = skewed()
    got = tables.carried(spark.createDataFrame(rows, "k string, v long, id long, w long").repartition(5), ["k"], [F.col("v"), F.col("id")], "w").collect()
    want = set()
    for k in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            last = r[3] if r[3] is not None else last
            want.add((*r[:3], last))
    assert {tuple(r) for r in got} == want


def test_locate_among_empty_segments(spark):
    segments = spark.createDataFrame([("x", i, n) for i, n in enumerate([0, 3, 0, 2, 0])] + [("y", 0, 1)], "k string, s long, n long")
    coords = spark.createDataFrame([(k, p) for k in ("x", "y", "z", None) for p in [0, 1, 3, 3, 4, 5, 6, None]], "k string, p long")
    got = Counter((r.k, r.p, r.s) for r in features.locate(coords, segments, "k", "p", "s", "n").collect())
    hold = {("x", 1): 1, ("x", 3): 1, ("x", 4): 3, ("x", 5): 3, ("y", 1): 0}
    assert got == Counter((k, p, hold.get((k, p))) for k in ("x", "y", "z", None) for p in [0, 1, 3, 3, 4, 5, 6, None])


def test_dealt_join_has_all_pairs_and_no_large_group(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(900)] + [(i, f"k{i % 40}") for i in range(900)], "a long, kmer string")
    right = spark.createDataFrame([(i, "hot") for i in range(500)] + [(i, f"k{i % 60}") for i in range(500)], "b long, kmer string")
    x, y, on = tables.dealt(left, right, "kmer", "a", "b", fine=20, least=16)
    assert len(on) == 3
    pairs = lambda d: Counter(map(tuple, d.select("a", "b", "kmer").collect()))
    assert pairs(x.join(y, on)) == pairs(left.join(right, "kmer"))
    for side, rows in ((x, 1800), (y, 1000)):
        sizes = [r["count"] for r in side.groupBy(*on).count().collect()]
        assert max(sizes) <= 3 * rows / 20
    a, b, on = tables.dealt(left.where("kmer <> 'hot'"), right.where("kmer <> 'hot'"), "kmer", "a", "b")
    assert on == ["kmer"] and a.columns == ["a", "kmer"]


def test_similarity_with_a_kmer_in_every_text(spark):
    seqs = [(i, "aaaa" + "".join(random.Random(i).choices("bcd", k=6))) for i in range(60)]
    df = spark.createDataFrame(seqs, "id long, s string")
    sets = {i: Counter(s[j : j + 3] for j in range(len(s) - 2)) for i, s in seqs}
    got = {(r.id, r.other): r.score for r in kmers.pair_similarity(df, df.withColumnRenamed("id", "other"), "id", "other", "s", 3).collect()}
    assert got == {(i, j): sum(n for k, n in sets[j].items() if k in sets[i]) for i in sets for j in sets}


def test_connections_over_several_blocks(spark):
    rnd = random.Random(9)
    index = [(f"g{rnd.randrange(130):03d}", f"k{rnd.randrange(60)}") for _ in range(900)] + [(f"g{i:03d}", "everywhere") for i in range(130)] + [(None, "everywhere")]
    groups = defaultdict(set)
    for g, k in index:
        if g:
            groups[k].add(g)
    want = Counter(p for gs in groups.values() for p in itertools.combinations(sorted(gs), 2))
    df = spark.createDataFrame(index, "g string, kmer string")
    assert {(r.a, r.b): r.kmers for r in kmers.connections(df, "g").collect()} == want
    some = spark.createDataFrame([("g005",)], "g string")
    assert {(r.a, r.b): r.kmers for r in kmers.connections(df, "g", some).collect()} == {p: n for p, n in want.items() if "g005" in p}


def test_grid_counts(spark):
    rows = [(x, y) for x in (None, 0.0, 1.0, 2.5) for y in (None, 1, 5, 9)]
    got = tables.grid_counts(spark.createDataFrame(rows, "x double, y long"), {"x": [1.0, 2.0, 9.0], "y": [5, 1]})
    want = {(a, b): sum(x is not None and y is not None and x >= a and y >= b for x, y in rows) for a in (1.0, 2.0, 9.0) for b in (1, 5)}
    assert {(r.x, r.y): r.n for r in got.collect()} == want


def test_totals_hold_pairs_that_share_nothing(spark):
    vectors = {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [2.0, 1.0, 0.0], 4: [0.0, 0.0, 0.0], 5: [1.0, 1.0, 1.0]}
    both = spark.createDataFrame([(a, b, vectors[a], vectors[b]) for a, b in itertools.combinations(vectors, 2)], "a long, b long, x array<double>, y array<double>")
    table = spark.createDataFrame(list(vectors.items()), "contig long, v array<double>")
    measures = {
        "sum": (bins.compare_dist(F.col("x"), F.col("y")), F.size(F.filter("v", lambda x: x != 0)) / 2, False),
        "rank": (bins.compare_rank(F.col("x"), F.col("y")), F.lit(0.5), False),
        "order": (bins.compare_order(F.col("x"), F.col("y"), strict=True), F.exists("v", lambda x: x == 0).cast("double"), True),
    }
    for name, (measure, alone, product) in measures.items():
        full = both.select("a", "b", measure.alias("likeness"), F.exists(F.zip_with("x", "y", lambda p, q: p * q), lambda p: p > 0).alias("met"))
        want = defaultdict(float)
        for r in full.collect():
            want[r.a] += r.likeness
            want[r.b] += r.likeness
        got = bins.totals(full.where("met"), table.withColumn("alone", alone), "contig", "alone", product).collect()
        assert {r.contig: r.likeness for r in got} == dict(want), name
        assert {r.others for r in got} == {4}
