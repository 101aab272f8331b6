"""Whitening against numpy on the whole vectors."""

import math
import random

import numpy as np
import pytest

from strandframe.llm import _skew, whitening

VECTORS = "vec_id long, embedding array<float>, x string, weight int"


def brute(rows, components=16, count=False):
    """(id, component) to deviation, |whitened| and explained, and the n and identity error of one length of vectors."""
    whole = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array([v for _, v in whole] if count else sorted({tuple(v) for _, v in whole}), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in whole:
        c = n * np.array(v, dtype=object) - s
        z = (c / n).astype(float) @ u
        out += [(i, k + 1, int((c**2).sum()), abs(z[k]) / math.sqrt(e[k]), e[k] / e.sum()) for k in range(min(components, len(e)))]
    return sorted(out, key=str), n


def compare(got, want, n):
    got = sorted(((r.vec_id, r.component, r.deviation, abs(r.whitened), r.explained) for r in got if not (r.n != n)), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitened(spark, weights):
    rng = random.Random(2)
    scale = [1, 3, 9, 27, 81, 0.5, 0.2]
    rows = [(i, [float(np.float32(rng.gauss(k, s))) for k, s in enumerate(scale)], "x", 1) for i in range(300)]
    rows += [(rng.choice([None, 5, 1000 + i]), rows[rng.choice([0, 0, 0, i])][1], None, None) for i in range(150)]
    rows += [(1, None, "x", 1), (2, [1.0] * 6 + [None], "x", 1), (3, [math.nan] * 7, "x", 1), (4, [math.inf] * 7, "x", 1), (4, [1.0] * 6 + [-math.inf], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS), components=5, weights=weights).collect()
    want, n = brute(rows, 5, weights == "count")
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    compare(got, want, n)
    first = {}
    for r in got:  # one sign for all rows: equal vectors whiten alike, whatever their ids
        assert first.setdefault((r.deviation, r.component), r.whitened) == pytest.approx(r.whitened)


def test_query(spark):
    from strandframe.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    want, n = brute(rows)
    compare(got, want, n)
    assert {r.n for r in got} == {n} and 0 <= got[0].identity_error < 1e-9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [1e30, 0.0]), (4, [5.0]), (5, []), (6, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 8.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), *((i, k) for i in (6, 7) for k in (1, 2, 3))}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 1].explained == 1 and got[1, 2].whitened is None and got[1, 2].explained == 0
    assert got[4, 1].whitened is None and got[4, 1].explained is None and got[4, 1].identity_error is None and got[4, 1].deviation == 0
    assert abs(got[7, 1].whitened) == pytest.approx(1) and got[7, 2].whitened is None
    large = [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 0.0]), (3, [0.0, 1.0])]
    out = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    want = 3**2 * (2**56) ** 2
    assert want > 2**63 and all(r.deviation is None for r in out if r.vec_id < 3) and {r.deviation for r in out if r.vec_id == 3} == {128**2}


def test_empty(spark):
    out = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 2049)], "vec_id long, embedding array<float>"))


def test_joins_of_hot_and_other_keys(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([0] * 3000 + list(range(1, 1500)))], "id long, k long")
    facts = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS v").where("k % 3 < 2")
    got = sorted(map(tuple, _skew.joined_by_count(rows, facts, ["k"], "n", "left").select("id", "k", "v").collect()))
    assert got == sorted((r.id, r.k, r.k * 2 if r.k % 3 < 2 else None) for r in rows.collect())
