"""Every query on the whole sf0.001 tables, against brute force, a library or held-out truth."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import pii, queries
from tests import oracle

from . import brute, test_near_copies

SF = "/root/testdata/sf0.001"
LIB = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def rows(spark, name):
    return {r[0]: tuple(r)[1:] for r in queries.queries()[name](spark, SF).collect()}


def tokens(text):
    e = LIB.encode(text)
    return len(e), brute.sha(",".join(map(str, e))), brute.sha(LIB.decode(e))


def test_pii(spark, docs):
    got = rows(spark, "op1_pii")
    assert {d: list(got[d][:5]) for d, _ in docs} == {d: brute.pii(t) for d, t in docs}


def test_pieces(spark, docs):
    assert rows(spark, "op3_pieces") == {d: tokens(t) for d, t in docs}


def test_substrings(spark, docs):
    assert rows(spark, "op4_substring_dedup") == {k[0]: v for k, v in brute.substrings(docs).items()}


def test_suffixes(spark, docs):
    assert rows(spark, "op5_suffix_dedup") == {d[0]: w for d, w in zip(docs, brute.suffixes(docs), strict=True)}


def test_simhash(spark, docs):
    assert rows(spark, "op6_simhash") == brute.near_duplicates(docs)


def test_decontamination(spark, docs, items):
    assert rows(spark, "op7_decontamination") == {k[0]: v for k, v in brute.decontaminate(docs, items).items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_licenses(spark):
    got = queries.op2_licenses(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    wanted = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    for r in got:
        named = {k for k, v in wanted.items() if v in texts[r.doc_id]}
        assert (r.own_license in named) if named else r.own_license is None


def test_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op8_language")
    test = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d][0] for d in test) and np.mean([got[d][1] == lang[d] for d in test]) > 0.95


def test_fingerprints(spark, docs):
    got, ordered = rows(spark, "op9_fingerprints"), sorted(docs)
    for (d, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        k = len(t) // 4
        assert got[d][:2] == (len(t), brute.sha(t[: len(t) - k] + n[:k]))
    long = [d for d, t in docs if len(t) > 800]
    assert np.mean([got[d][4] for d in long]) > 0.6 > 0.2 > np.mean([got[d][5] for d in long])


def test_quality(spark):
    got = rows(spark, "op10_quality")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([got[d][3] == bool(q) for d, q in labels.items() if d in got]) > 0.95


def test_pipeline(spark, items):
    stages = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages["quality classifier"](spark, table, SF)
    assert kept.columns == table.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    first = test_near_copies.kept(left)[0]
    left = [(d, t) for d, t in left if d in first]
    bad = brute.decontaminate(left, items)
    left = [(d, t) for d, t in left if not bad[d, t][-1]]
    want = {d: pii.redact(t, pii.find(t)) for d, t in left}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*table.columns, "ids", "decoded", "n_tokens"]
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.ids == LIB.encode(r.text) and r.decoded == r.text and r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in got.values())
    empty = table.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
