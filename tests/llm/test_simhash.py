import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.llm import simhash
from strandframe.llm._graph import components

from . import brute

DOCS = "doc_id long, text string, fp long, `_k` string"


def test_graph_against_union_find(spark):
    rnd = random.Random(5)
    for n, m in ((1, 0), (30, 20), (80, 70), (60, 59)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] if n != 60 else [(i, i + 1) for i in range(59)]
        want = list(range(n))
        for _ in range(n):
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        got = components(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long")).collect()
        assert dict(map(tuple, got)) == dict(enumerate(want))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB é\n\x0b", max_size=80), st.integers(1, 5))
def test_fingerprint(text, size):
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode() * size)) == brute.simhash(text * size)


def test_fingerprint_of_many_shingles():
    text = " ".join(str(i * i % 977) for i in range(3000))
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == brute.simhash(text)


def test_links_against_brute_force(spark):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for flips in (1, 2, 4, 5):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), flips)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f, f) for f in signed], "fp long, label long")
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for distance in (1, 2, 3, 4):
        assert {tuple(r) for r in simhash.ring_links(table, distance).collect()} == {(a, b) for a in signed for b in signed if a < b and far(a, b) <= distance}


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(5)]
    texts = [b + rnd.choice(["", " x", " y z", " Q"]) for b in base for _ in range(6)] + ["", None, " ", "one", "ONE", "one two three", base[0]]
    docs = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)).collect()}
    assert got == brute.near_duplicates(docs)


def test_empty_null_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b", 1, ""), (4, "a b", 1, ""), (4, "a b", 1, ""), (3, None, 1, ""), (None, "zz", 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(((r.doc_id or 9), r.component_id or 9) for r in simhash.near_duplicates(docs).collect()) == [(3, 3), (4, 4), (4, 4), (9, 4), (9, 9)]
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r._k for r in kept.collect()} == {""} and sorted((r.doc_id or 9) for r in kept.collect()) == [3, 4, 9]


def test_the_rings_rows_are_never_broadcast(spark):
    """A few kB of fingerprints become many times that."""
    labelled = spark.range(1000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("label"))
    for distance in (1, 4):
        plan = simhash.ring_links(labelled, distance)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
