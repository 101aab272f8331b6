import random

import pytest

from strandframe.operators import graph, reps


def sequential_thin(order, near):
    kept, gone = [], set()
    for n in order:
        if n not in gone:
            kept.append(n)
            gone |= near[n]
    return set(kept)


def sequential_cover(nodes, near, least):
    left, out = set(nodes), []
    while left:
        best = min(left, key=lambda n: (-len(near[n] & left), n))
        if len(near[best] & left) + 1 < least:
            return out
        taken = (near[best] & left) | {best}
        out += [(best, m) for m in taken]
        left -= taken
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_equal_the_sequential_walk(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(8, 25)
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(4, 40))]
    near = {i: {b for a, b in edges + [(y, x) for x, y in edges] if a == i and b != i} for i in range(n)}
    ranks = {i: rnd.randrange(4) for i in range(n)}
    table = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame(list(ranks.items()), "node long, rank long")
    order = sorted(range(n), key=lambda i: (ranks[i], i))
    assert {r.node for r in graph.first_independent_set(nodes, table).collect()} == sequential_thin(order, near)
    keep = [order[-1], order[-2]]
    kept = graph.first_independent_set(nodes, table, spark.createDataFrame([(k,) for k in keep], "node long"))
    assert {r.node for r in kept.collect()} == sequential_thin(sorted(order, key=lambda i: (i not in keep, ranks[i], i)), near)
    assert {tuple(r) for r in graph.greedy_cover(nodes, table).collect()} == set(sequential_cover(range(n), near, 2))
    root = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(map(tuple, graph.components(nodes.select("node"), table).collect())) == root


def test_crude_connects_to_the_closest_earlier(spark):
    pairs = spark.createDataFrame([(1, 2, 30), (2, 1, 30), (2, 4, 40), (4, 2, 40), (3, 2, 20), (2, 3, 20)], "a long, b long, score long")
    nodes = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "node long, rank long")
    assert {tuple(r) for r in reps.crude(pairs, nodes, 25).collect()} == {(1, 1, None), (2, 1, 30), (3, 3, None), (4, 4, None)}
    assert {tuple(r) for r in reps.crude(pairs, nodes, 25, final=True).collect()} == {(1, 1, None), (2, 4, 40), (3, 3, None), (4, 4, None)}


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 2)], "node long, rank long")
    none = spark.createDataFrame([], "a long, b long")
    assert graph.first_independent_set(nodes, none).count() == 2
    assert graph.greedy_cover(nodes, none).count() == 0
    assert graph.components(nodes.select("node"), none).count() == 2
