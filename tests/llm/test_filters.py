"""The filter audit and its matrix against plain Python."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandframe.llm import filters

DOCS = "doc_id long, text string, lang string, source string, fails int, n_words long"


def fails(rows):
    out = []
    for d, t, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        first = min((float("inf") if e is None else e) for e, u, *_ in rows if (u or "") == (t or ""))
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t or "")) > 3 * len(t or ""), bool(re.search("[#$%&*|]", t or "")), first < (float("inf") if d is None else d)]
        out.append({f for f, b in zip("ABCDE", bad, strict=True) if b})
    return out


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    bad, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [(d, b) for d, b in left if f in b]
                left = [(d, b) for d, b in left if f not in b]
                shapley[f] += len(gone)
                failing = sum(f in b for _, b in mine)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(b == {f} for _, b in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shapley[o[k - 1]])
    return out


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 500])], k=rng.choice([5, 199, 200, 400]))) for _ in range(40)]
    texts += ["A" * 4 + "b" * 96, "A" * 3 + "b" * 97, "x#y", "", None, " \t\n\x0b\x0c\r", "\x1c  ", "é É ÄÖ", "x" * 400_000, " ".join(words * 400)]
    texts += rng.choices(texts, k=30)
    rows = [(None if i % 17 == 3 else rng.randrange(60) if i % 5 else i, t, rng.choice(["en", "de", None, ""]), "s", 1, 1) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = made()
    got = filters.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in got} == brute(rows, labels)
    assert len(got) == 600 * 3


@pytest.mark.parametrize("clash", [False, True])
def test_matrix_has_each_word_once(spark, monkeypatch, clash):
    rows, _ = made()
    if clash:
        whole = filters.code
        monkeypatch.setattr(filters, "code", lambda w: F.when(w.startswith("w1"), F.lit(7)).otherwise(whole(w)))
    docs = spark.createDataFrame([(i, r[1] or "") for i, r in enumerate(rows)], "doc_id long, text string").repartition(5)
    matrix, dictionary = filters.document_terms(docs, "text")
    word = {r.number: r.word for r in dictionary.collect()}
    assert len(word) == dictionary.count() == len(set(word.values()))
    got = {}
    for s in matrix.collect():
        for d, a, b in zip(s.docs, s.starts, s.starts[1:], strict=False):
            got[d.doc_id] = {word[s.numbers[c]]: n for c, n in zip(s.columns[a:b], s.counts[a:b], strict=True)}
    assert got == {i: dict(Counter(x for x in re.split("[\x20\x09-\x0d]+", r[1] or "") if x)) for i, r in enumerate(rows)}


def test_shards_are_closed(spark, monkeypatch):
    big = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 6 << 20).alias("text")).coalesce(1)
    matrix, _ = filters.document_terms(big, "text")
    assert sorted(len(r.docs) for r in matrix.collect()) == [1, 1, 1]
    assert {(r.n_words, r.n_distinct) for r in filters.row_sums(matrix).collect()} == {(6 << 20, 1)}


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert filters.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_large_rows_are_written_in_small_row_groups(spark):
    """A task holds a row group, which would be of a hundred rows at least, whatever their size."""
    import pyarrow.parquet as pq

    from strandframe.llm import _shared

    rows = spark.range(0, 40, 1, 1).select(F.expr("transform(sequence(1, 20000), i -> xxhash64(id, i))").alias("x"))
    table = _shared.written(rows, "zstd", 1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    assert sum(m.num_rows for m in groups) == 40 and max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 14
    assert filters.SHARD_BYTES <= filters.GROUP_BYTES <= 8 << 20
