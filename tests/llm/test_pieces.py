import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from strandframe.llm import pieces

from . import brute

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
DOCS = "doc_id long, text string, ids string, decoded long"


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.Model(f.read())


def agree(model, texts):
    ids, first = pieces.Encoder(model, 50)(texts)
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == LIB.encode(t), t
    assert [x.decode() for x in model.decode(ids, first)] == [LIB.decode(LIB.encode(t)) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
@example(["", " ", "  a   b ", "a\n\nb", "▁x", "a▁▁ b", "\x00é😀", "aaaaaaaaaaaaaaaaaaa", "the theory  of\tit"])
def test_any_text(model, texts):
    agree(model, [t.encode("utf-8", "ignore").decode() for t in texts])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst th▁", max_size=120))
def test_many_merges(model, text):
    agree(model, [text, text * 3])


def test_long_words(model):
    rnd = random.Random(4)
    agree(model, ["".join(rnd.choice("aeinrst") for _ in range(n)) for n in (150, 199, 201, 3000)] + ["a" * 5000, " " * 700, "x" + " " * 300])
    agree(model, ["".join(rnd.choice("etaoinshrdlu") for _ in range(50_000)), "ha" * 5000, "the" * 7000, "=" * 20_000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=30))
def test_decode_any_ids(model, ids):
    assert model.decode(np.array(ids, np.int32), np.array([0, len(ids)]))[0].decode() == LIB.decode(ids)


def test_tables(spark):
    assert pieces.digest(spark.createDataFrame([], DOCS), PATH).count() == 0
    rows = [(1, "the cat\nsat", "x", 1), (1, "the cat\nsat", "x", 1), (None, None, None, None), (2, "", None, 2), (3, "word " * 30000, None, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    want = [(i, len(e := LIB.encode(t or "")), brute.sha(",".join(map(str, e))), brute.sha(LIB.decode(e))) for i, t, _, _ in rows]
    assert [tuple(r) for r in pieces.digest(docs, PATH).collect()] == want
    back = pieces.decode(pieces.encode(docs, PATH), PATH)
    both = pieces.round_trip(docs, PATH)
    assert both.columns == back.columns
    assert [(r.ids, r.decoded) for r in both.collect()] == [(r.ids, r.decoded) for r in back.collect()] == [(LIB.encode(t or ""), t or "") for _, t, _, _ in rows]
