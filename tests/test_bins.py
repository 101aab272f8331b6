"""Comparisons of all pairs of vectors, on nations some of which share no priority."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandframe.operators import bins
from strandframe.plans import library
from tests import oracle

#: Each nation's orders by priority; nations 1 and 2 share nothing, nor does 5 with 1, 2 and 3.
COUNTS = {1: {"1-URGENT": 2}, 2: {"2-HIGH": 4}, 3: {"1-URGENT": 3, "2-HIGH": 1}, 4: {"1-URGENT": 1, "2-HIGH": 1, "9-NEW": 2}, 5: {"9-NEW": 1}}
PAIRS = [(a, b) for a in COUNTS for b in COUNTS if a < b]


def tables(path, counts):
    con = duckdb.connect()
    orders = [(c, p) for c, by in counts.items() for p, n in by.items() for _ in range(n)]
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(i, c, p) for i, (c, p) in enumerate(orders)])
    con.execute("CREATE TABLE customer AS SELECT DISTINCT o_custkey AS c_custkey, o_custkey AS c_nationkey FROM orders")
    con.execute("CREATE TABLE nation AS SELECT c_nationkey AS n_nationkey FROM customer WHERE c_nationkey < 90")
    for name in ("orders", "customer", "nation"):
        con.execute(f"COPY {name} TO '{path}/{name}.parquet' (FORMAT parquet)")
    return con


@pytest.fixture
def found(spark, tmp_path):
    con = tables(tmp_path, COUNTS)

    def run(name):
        assert oracle.differences(spark, con, str(tmp_path), library.queries()[name], library.oracle_sql()[name]) == ""
        got = library.queries()[name](spark, str(tmp_path)).collect()
        assert sorted((r.a, r.b) for r in got) == PAIRS
        return {(r.a, r.b): r[2] for r in got}

    return run


def test_distance_of_every_pair(found):
    got = found("b5_distance")
    assert got[1, 2] == 1 and got[1, 5] == 1 and got[3, 5] == 1.5 and got[4, 5] == round(1 + 1 / 1.5, 6)
    assert got[1, 3] == round(1 / (1 + 1 / 3) + 0.5, 6)


def test_rank_of_every_pair(found):
    got = found("b7_rank")
    assert got[1, 2] == 1 and got[1, 3] == 1 and got[3, 4] == 2


def test_order_of_every_pair(found):
    got = found("b8_compare_order")  # nation 4 has all three priorities
    assert got == {p: int(4 not in p) for p in PAIRS}


@pytest.mark.parametrize("name", ["b5_distance", "b7_rank", "b8_compare_order"])
def test_missing_priorities_and_unknown_nations(spark, tmp_path, name):
    con = tables(tmp_path, {**COUNTS, 6: {None: 2, "1-URGENT": 1, "2-HIGH": 3, "9-NEW": 1}, 95: {"1-URGENT": 1}})
    assert oracle.differences(spark, con, str(tmp_path), library.queries()[name], library.oracle_sql()[name]) == ""


def test_all_pairs_of_many_contigs(spark, monkeypatch):
    from strandframe.operators import tables as t

    dealt = t.dealt
    monkeypatch.setattr(t, "dealt", lambda *a: dealt(*a, fine=4, least=16))
    vectors = spark.range(120).select("id", F.array(F.col("id").cast("double")).alias("v"))
    got = bins.all_pairs(vectors, "id", "v").collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(120) for b in range(a + 1, 120)]
    assert all(r.x == [r.a] and r.y == [r.b] for r in got)
