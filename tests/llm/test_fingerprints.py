import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import fingerprints as fp

from . import brute

DOCS = "doc_id long, text string, fingerprint string, part int"
WORDS = [f"w{i}ö" for i in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé😀", max_size=30), st.text(alphabet="aé😀", max_size=30), st.integers(0, 30), st.integers(0, 30))
def test_extension(x, y, i, j):
    i, j = min(i, len(x)), min(j, len(y))
    want = 0
    while i + want < len(x) and j + want < len(y) and x[i + want] == y[j + want]:
        want += 1
    assert fp.Prefixes(fp.code_points(x)).extension(np.array([i]), fp.Prefixes(fp.code_points(y)), np.array([j]))[0] == want


def rows(spark, docs, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return fp.edited_pairs(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(parts)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    docs = [(i * 3, rnd.choice([prose(rnd, rnd.randrange(1, 400)), "", "é", None, "same text " * 9])) for i in range(50)]
    rnd.shuffle(docs)
    got = {r.doc_id: r for r in rows(spark, docs, 4)}
    ordered = sorted(docs)
    for (i, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        a, b, c = fp.fingerprint([t]), fp.fingerprint([e]), fp.fingerprint([n])
        z = np.zeros(1, int)
        assert tuple(got[i][1:]) == (len(t), brute.sha(e), a.text(0), b.text(0), fp.likeness(a, z, b, z)[0], fp.likeness(a, z, c, z)[0], next((p for p, (x, y) in enumerate(zip(t, e, strict=False)) if x != y), min(len(t), len(e))))
        if len(t) > 1000 and len(n) > 1000:
            assert got[i].near_edited > 0.5 and got[i].near_next < 0.3


def test_likeness_is_near_the_share_in_common():
    """Against the Dice coefficient of the sets of all spans of GRAM letters."""
    rnd, z, off = random.Random(5), np.zeros(1, int), []
    for cut in (0, 1, 2, 3, 4, 6, 8):
        x = prose(rnd, 600)
        y = x[: len(x) * (8 - cut) // 8] + prose(rnd, 75 * cut)
        p, q = ({t[i : i + fp.GRAM] for i in range(len(t) - fp.GRAM + 1)} for t in (x, y))
        a, b = fp.fingerprint([x]), fp.fingerprint([y])
        off.append(abs(fp.likeness(a, z, b, z)[0] - 2 * len(p & q) / (len(p) + len(q))))
        assert (a.bins != fp.EMPTY).sum() > 0.9 * fp.BINS
    assert max(off) < 0.25


def test_small_tables(spark):
    assert rows(spark, [], 1) == []
    one = rows(spark, [(None, "abcdefgh")], 2)
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == brute.sha("abcdefab")
    same = rows(spark, [(1, "x y"), (1, "x y"), (2, None)], 2)
    assert [r.n_chars for r in sorted(same, key=lambda r: r.doc_id)] == [3, 3, 0]
    assert fp.edited_pairs(spark.createDataFrame([(1, "a")], "doc_id long, text string")).first().n_chars == 1


def test_extension_table(spark):
    pairs = spark.createDataFrame([("abcd", 1, "xbcx", 1), ("a", 5, "a", 0), (None, 0, "a", 0)], "text_a string, at_a int, text_b string, at_b int")
    assert [r.lce for r in fp.longest_common_extensions(pairs).collect()] == [2, None, None]
