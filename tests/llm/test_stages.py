"""The pipeline's stages on odd rows: nulls in every column, empty and repeated texts, a long one, and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _f_source string, _doc string, ids string, n_tokens int, decoded string, component_id long"
EXTRA = ("f", "d", "i", 1, "e", 7)


def odd():
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, "Write to jo@example.org or call.", "en", "s", 33), (1, "Write to jo@example.org or call.", "en", "s", 33), (None, "no id", "en", None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, "x" * 50_000, None, "s", 1)]
    return [(*r, *EXTRA) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    docs = spark.createDataFrame(odd(), COLUMNS)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert set(out.columns) == set(docs.columns)
    got = out.collect()
    assert all((r._f_source, r._doc, r.component_id) == ("f", "d", 7) for r in got)
    if name in ("PII", "SentencePiece encoding and decoding"):
        assert len(got) == 7
    if name == "PII":
        assert not any("jo@example" in (r.text or "") for r in got) and all(r.n_chars == len(r.text) for r in got if r.text)
        assert dict(corpus_pipeline.STAGES)[name](spark, docs.drop("n_chars"), SF).count() == 7
    if name == "SentencePiece encoding and decoding":
        assert all(r.n_tokens == len(r.ids) for r in got) and any(len(r.decoded) > 100_000 for r in got)
    if name == "SimHash near-dedup":
        assert sum(r.doc_id == 1 for r in got) == 1 and any(r.doc_id is None for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_no_rows(spark, name):
    docs = spark.createDataFrame(odd(), COLUMNS).where(F.lit(False))
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0
