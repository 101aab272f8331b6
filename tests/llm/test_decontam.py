import random

from strandframe.llm import decontam

from . import brute

DOCS = "doc_id long, text string, lang string, _k string"


def check(spark, docs, items):
    got = {(r.doc_id, r.text): r for r in decontam.decontaminate(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")).join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect()}
    want = brute.decontaminate(docs, items)
    for k, v in want.items():
        assert tuple(got[k][1:6]) == v, (k, v)
    return got


def test_against_brute_force(spark):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["alpha", "Beta", "gämma", "d3lta", "x"])
    items = [(i, " ".join(word() for _ in range(rnd.randrange(0, 30)))) for i in range(40)] + [(99, None), (100, "")]
    docs = [(i, " ".join([word() for _ in range(rnd.randrange(0, 40))] + rnd.choice(items)[1:] * 1 if rnd.random() < 0 else [word() for _ in range(rnd.randrange(60))])) for i in range(60)]
    docs += [(200 + i, "zz, " * rnd.randrange(5) + (t or "") + ". the end") for i, t in items]
    docs += [(500, ""), (502, "--"), (503, "Beta" * 5000)]
    check(spark, docs, items)


def test_empty_and_null(spark):
    assert decontam.decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")).count() == 0
    rows = decontam.decontaminate(spark.createDataFrame([(None, None, None, None), (1, "a b", None, None), (1, "a b", None, None)], DOCS), spark.createDataFrame([(None, "a b"), (7, "b")], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 0, 0), (1, 2, 2), (1, 2, 2)]  # the item without an id counts for words


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "the words of an item here", "x", "y"), (2, "clean", "x", None), (None, None, None, None)], DOCS)
    out = decontam.drop_contaminated(docs, spark.createDataFrame([(1, "words of an item")], "item_id long, text string"))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, None}


def test_parts_of_items_at_all_offsets(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(f"w{rnd.randrange(6 if i % 2 else 500)}" for _ in range(n))) for i, n in enumerate((10, 11, 14, 25, 25, 60, 60, 1, 4, 9, 6))]
    docs, split = [], [t.split() for _, t in items]
    for w in split:
        for n in (8, 9, 10, 11, 13, 24):
            for p in range(0, max(1, len(w) - n + 1), 3):
                docs.append((len(docs), " ".join(["q"] * rnd.randrange(3) + w[p : p + n] + [f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(4))] + rnd.choice(split)[:12])))
    docs.append((9000, "w1 w2, W1! " * 30_000 + items[5][1]))  # one text of 90,060 words
    got = check(spark, docs, items)
    assert any(r.n_hit == r.n_words for r in got.values()) and any(0 < r.n_hit < r.n_words for r in got.values())


def test_fingerprints_of_equal_grams(spark):
    """Ties: the same word throughout, so that all grams of a window are equal."""
    check(spark, [(n, "a " * n) for n in range(1, 26)] + [(50, "b " + "a " * 12 + "c " + "a " * 9)], [(1, "a " * 12), (2, "a " * 3), (3, "c a a"), (4, "a " * 10 + "c")])
