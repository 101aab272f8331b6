import math
import random
import re
from collections import Counter

from strandframe.llm import licenses

DOCS = "doc_id long, path string, text string, license string"


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def plain(docs):
    """{id: (own, score)} with dictionaries."""
    n, df = len(docs), Counter(w for _, _, t, _ in docs for w in set(words(t or "")))
    known = {w for _, t in licenses.TEMPLATES for w in words(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in known else 0))) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}

    def cos(a, b):
        dot = sum(x * b.get(w, 0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0.0

    out = {}
    for i, _, t, _ in docs:
        best = max(((round(cos(vec(x), vec(m)), 9), -k) for x in [t or "", *(t or "").split("\n")] for k, (_, m) in enumerate(licenses.TEMPLATES)), default=(0, 0))
        out[i] = (licenses.TEMPLATES[-best[1]][0], round(best[0], 6)) if best[0] >= licenses.CLOSE else (None, 0.0)
    return out


def test_cosines_against_dictionaries(spark):
    rnd = random.Random(3)
    lines = [t for _, t in licenses.TEMPLATES] + ["licensed under the terms", "the quick brown fox", "version 2", "Released under this MIT licence text"]
    docs = [(i, f"a/{i % 3}/f{i}", "\n".join(rnd.choice([rnd.choice(lines), "plain words of no use é " * rnd.randrange(1, 4)]) for _ in range(rnd.randrange(0, 4))), "x") for i in range(80)] + [(900, None, None, None), (901, "", "", "")]
    got = {r.doc_id: (r.own_license, round(r.own_score, 6)) for r in licenses.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == plain(docs)


def test_inheritance(spark):
    mit, apache, text = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "plain words and nothing " * 9
    docs = [(1, "LICENSE", mit, ""), (2, "a/x", text, ""), (3, "a/b/LICENSE", apache, ""), (4, "a/b/c/d/y", text, ""), (5, "a/b/c/z", f"{mit}\n{text}", ""), (6, None, text, ""), (6, None, text, ""), (7, "top", text, "")]
    out = {r.doc_id: (r.license, r.license_from, r.is_licence_file) for r in licenses.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert out == {1: ("MIT", "", True), 2: ("MIT", "/", False), 3: ("Apache-2.0", "", True), 4: ("Apache-2.0", "a/b/", False), 5: ("MIT", "", False), 6: (None, None, False), 7: ("MIT", "/", False)}
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_paths(spark):
    docs = spark.createDataFrame([(1, "en", "s", "t"), (None, None, None, None)], "doc_id long, lang string, source string, text string")
    assert [r.path for r in licenses.with_paths(docs).collect()] == ["s/en/1", "unknown/unknown/unknown"]
