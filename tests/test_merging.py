"""Merging of clusters against the sequential definition: the greatest total first, again and again."""

import random

import pytest

from strandframe.operators import clusters


def merge_sequence(edges):
    total, size, out = {}, {}, []
    for a, b, s in edges:
        for x, y in ((a, b), (b, a)):
            total.setdefault(x, {})[y] = total.get(x, {}).get(y, 0) + s
        size[a] = size[b] = 1
    while left := [(-v, a, b) for a in total for b, v in total[a].items() if a < b]:
        v, a, b = min(left)
        out.append((a, b, -v, -v / (size[a] * size[b])))
        size[a] += size.pop(b)
        for y, w in total.pop(b).items():
            del total[y][b]
            if y != a:
                total[a][y] = total[y][a] = total[a].get(y, 0) + w
    return out


def parts(edges):
    root = {x: x for e in edges for x in e[:2]}
    for _ in root:
        for a, b, _s in edges:
            root[a] = root[b] = min(root[a], root[b])
    return {r: [e for e in edges if root[e[0]] == r] for r in set(root.values())}


def made(seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(rnd.randrange(6, 12))]
    return [(*sorted(rnd.sample(names, 2)), float(rnd.randrange(1, 7))) for _ in range(rnd.randrange(6, 20))]


#: here rounds of mutually best edges would merge a and b before a and c
OVERTAKEN = [("c", "d", 10.0), ("a", "b", 5.0), ("a", "c", 4.0), ("a", "d", 4.0)]
CHAIN = [(f"x{i}", f"x{i + 1}", float(2**i)) for i in range(7)] + [("p", "q", 3.0), ("y", "z", 3.0)]


@pytest.mark.parametrize("edges", [OVERTAKEN, CHAIN, made(1), made(2)], ids=["overtaken", "chain", "1", "2"])
def test_rounds_equal_the_sequence(spark, edges):
    turned = [(b, a, s) if i % 2 else (a, b, s) for i, (a, b, s) in enumerate(edges)]
    got = {}
    for r in sorted(clusters.merge_list(spark.createDataFrame(turned, "a string, b string, score double")).collect(), key=lambda r: (r.component, r.step)):
        got.setdefault(r.component, []).append((r.a, r.b, r.total, r.average))
        assert r.step == len(got[r.component])
    assert got == {c: merge_sequence(es) for c, es in parts(edges).items()}


def test_without_edges(spark):
    assert clusters.merge_list(spark.createDataFrame([("a", "a", 1.0)], "a string, b string, score double")).count() == 0
