import random
import zlib

import numpy as np

from strandframe.llm import langid

DOCS = "doc_id long, text string, lang string, score string, held_out int"


def prose(rnd, lang):
    words = {"aa": ["anta", "bara", "sol"], "bb": ["uéu", "lom", "kru", "sol"], "cc": ["ßen", "und", "die"], "dd": ["zzyx", "qua", "wip"]}[lang]
    return " ".join(rnd.choice(words) + rnd.choice(["", "a", "en"]) for _ in range(rnd.randrange(4, 60)))


def test_held_out_accuracy_and_columns(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, lang := rnd.choice(["aa", "bb", "cc", "dd"])), lang, "x", 1) for i in range(400)]
    rows = [(i, t, None if zlib.crc32(str(i).encode()) % 4 == 2 else x, s, h) for i, t, x, s, h in rows]
    truth = dict((r[0], t) for r, t in zip(rows, [None] * 400))  # noqa: B905
    rnd = random.Random(1)
    for i in range(400):
        lang = rnd.choice(["aa", "bb", "cc", "dd"])
        prose(rnd, lang)
        truth[i] = lang
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    test = [i for i in got if got[i].held_out]
    assert len(test) > 60 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].lang_pred == truth[i] for i in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all()
    assert langid.codewords(1).shape == (1, 0)


def test_edges(spark):
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    nothing = langid.identify(spark.createDataFrame([(1, "some text", None, None, None)], DOCS)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    rows = [(1, "hello there", "en", None, None), (1, "hello there", "en", None, None), (3, None, "en", None, None), (None, "12 34", None, None, None), (4, "", None, None, None), (5, "é", None, None, None), (6, "word " * 40000, None, None, None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()]
    assert got == [(1, "en", 1.0), (1, "en", 1.0), (3, "und", 0.0), (None, "und", 0.0), (4, "und", 0.0), (5, "en", 1.0), (6, "en", 1.0)]
