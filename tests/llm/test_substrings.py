import random

from strandframe.llm import substrings

from . import brute

DOCS = "doc_id long, text string, _k string, at long"


def passages(rnd, n=40):
    words = ["the", "ofé", "a", "then", "it\x0b", "is", "an"] + [f"w{i}" for i in range(30)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.choice([20, 50, 51, 90]))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [rnd.choice([rnd.choice(shared), " ".join(rnd.choice(words) for _ in range(rnd.randrange(70)))]) for _ in range(rnd.randrange(5))]
        docs.append((i * 7 % n, rnd.choice([" ", "\n", "  "]).join(parts)))
    return docs + [(n, docs[3][1]), (n + 1, docs[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "la " * 400), (n + 5, "x la" + " la" * 300)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = passages(random.Random(seed))
        got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(spark.createDataFrame([(i, t, "x", 0) for i, t in docs], DOCS), width_bits=16).collect()}
        want = brute.substrings(docs)
        assert {k[0]: v for k, v in want.items()} == got


def test_crowded_sketch_loses_nothing(spark):
    docs = passages(random.Random(3), 20)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.digest(spark.createDataFrame([(i, t, "x", 0) for i, t in docs], DOCS).repartition(3), width_bits=4 + 12).collect()}
    assert {k[0]: v for k, v in brute.substrings(docs).items()} == got


def test_empty_null_and_repeated_rows(spark):
    assert substrings.digest(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = substrings.digest(spark.createDataFrame([(None, long, None, 1), (5, long, None, 1), (5, long, None, 1), (6, long, None, 1)], DOCS)).collect()
    assert sorted(((r.doc_id or 99), r.n_removed) for r in rows) == [(5, 0), (5, 0), (6, 60), (99, 60)]
