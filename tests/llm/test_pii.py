import random

from hypothesis import example, given, settings
from hypothesis import strategies as st

from strandframe.llm import pii

from . import brute

DOCS = "doc_id long, pii_spans string, text string, spans string"


def base(text):
    spans = [s for s in pii.find(text) if s[0] in pii.BASE]
    return [*(sum(s[0] == k for s in spans) for k in pii.BASE), brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.@+-0129 ()é_", max_size=40))
@example("a@b.c@d.e_x@f.g")
@example("1.2.3.4.5.6.7.8 1..2.3.4.5 300.1.1.1 0255.1.1.1")
@example("4111 1111-1111 1111  4111111111111111 +1 (017) 555-7713.")
def test_base_spans(text):
    assert base(text) == brute.pii(text)


def test_dense_numbers():
    rnd = random.Random(2)
    for _ in range(400):
        text = "".join(rnd.choice(["4111111111111111", "378282246310005", "192.168.1.", "7", "-", " ", "+44 ", ".", "x@y.", "(0)"]) for _ in range(30))
        assert base(text) == brute.pii(text)


def test_added_spans():
    text = 'token = "24be64439e3e49cf46b2d7c90f36" ftp://me:pw@host/x, IBAN: GB82 WEST 1234 5698 7654 32 at 12 Green Hill Road.'
    assert [(k, text[s:e]) for k, s, e in pii.find(text) if k in pii.ADDED] == [("url", "ftp://me:pw@host/x"), ("secret", "24be64439e3e49cf46b2d7c90f36"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("address", "12 Green Hill Road")]
    assert pii.redact("mail a@b.co now", pii.find("mail a@b.co now")) == "mail <EMAIL> now"


def test_long_text_is_linear():
    text = "9" * 300_000 + "a" * 300_000 + "@" * 2000
    assert base(text)[:4] == [0, 0, 0, 0]


def test_tables(spark):
    assert pii.digest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "x", "é a@b.co 10.0.0.1", None), (1, "x", "é a@b.co 10.0.0.1", None), (None, None, None, None), (2, None, "", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in pii.digest(docs).collect()]
    assert got[0] == got[1] and got[0][-1] == "email:2:8,ip:9:17"
    assert [list(g[1:6]) for g in got] == [brute.pii(r[2]) for r in rows]
    out = pii.redacted(docs)
    assert out.columns == docs.columns and [r.text for r in out.collect()] == ["é <EMAIL> <IP>"] * 2 + [None, ""]


def test_added_spans_dont_overlap():
    assert [x for x in pii.find("at 12 Green Lane Road now")] == [("address", 3, 16)]
    assert [x[0] for x in pii.find("12 Green Lane, 13 Red Road")] == ["address"] * 2
