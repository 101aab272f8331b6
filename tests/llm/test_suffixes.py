import random

import numpy as np
import pytest

from strandframe.llm import suffixes

from . import brute

DOCS = "doc_id long, text string, n int, anchor string"


def corpus(rnd, n=40):
    prose = lambda k: "".join(rnd.choice("abcdeé ") for _ in range(k))
    shared = [prose(rnd.choice([120, 199, 200, 201, 320, 500])) for _ in range(6)]
    docs = [(i, "".join(rnd.choice([rnd.choice(shared), prose(rnd.randrange(300))]) for _ in range(rnd.randrange(5)))) for i in range(n)]
    twice = prose(260)
    return docs + [(n, docs[5][1]), (n + 1, "ab" * 300), (n + 2, "z" * 700), (n + 3, twice + "!" + twice), (n + 4, None), (n + 5, ""), (n + 6, docs[5][1][:-1] + "?")]


@pytest.mark.parametrize("block", [suffixes.BLOCK, 2])
def test_against_brute_force(spark, block):
    docs = corpus(random.Random(block))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3), block=block, width_bits=16).collect()}
    want = {d[0]: w for d, w in zip(docs, brute.suffixes(docs), strict=True)}
    assert got == want


def test_columns_against_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        length, segments = 3, []
        for g in range(rnd.randrange(1, 4)):
            for _ in range(rnd.randrange(1, 7)):
                lead = rnd.randrange(4)
                segments.append((g, lead, bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(lead + 1, lead + 7)))))
        group, lead = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
        data = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
        first = np.concatenate(([0], np.cumsum([len(s[2]) for s in segments])))
        seen = {}
        for i, (g, d, b) in enumerate(segments):
            for p in range(len(b) - length + 1):
                seen.setdefault((g, p - d, b[p : p + length]), []).append((i, p))
        want = sorted(x for v in seen.values() if len(v) > 1 for x in v)
        assert sorted(map(tuple, np.stack(suffixes.insert_columns(group, data, first, lead, length), axis=1).tolist())) == want


def test_empty_null_and_repeated_rows(spark):
    assert suffixes.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "q" + "ab c" * 50, 1, "x"), (3, "ab c" * 50, 1, "x"), (4, "xyzw" * 10, 1, ""), (4, "xyzw" * 10, 1, ""), (5, "0123456789" * 20, 1, ""), (5, "0123456789" * 20, 1, "")]
    got = sorted(tuple(r)[1:] for r in suffixes.digest(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted(brute.suffixes([r[:2] for r in rows]))


@pytest.mark.parametrize("block", [suffixes.BLOCK, 500])
def test_large_group_of_segments(spark, block):
    """One passage in very many different surroundings: thousands of distinct segments with one anchor."""
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(230))
    docs = [(i, f"{rnd.random()}{rnd.random()}{passage}{rnd.random()}{rnd.random()}") for i in range(3000)] + [(9000, "x" * 150 + passage[:180]), (9001, passage[20:] + "y" * 90)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3), block=block, width_bits=18).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.suffixes(docs), strict=True)}


def test_very_long_text(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefghij") for _ in range(60_000))
    docs = [(1, long), (2, long[30_000:30_900] + "end"), (3, long[:200])]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digest(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS), width_bits=18).collect()}
    assert got == {d[0]: w for d, w in zip(docs, brute.suffixes(docs), strict=True)}
