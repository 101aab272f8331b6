import random

import numpy as np

from strandframe.llm import _units as u
from strandframe.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, y int"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, n=600):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        text = " ".join(rnd.choice(words) + ("###" if bad else rnd.choice(["", "", ","])) for _ in range(rnd.randrange(5, 120)))
        docs.append((i, text, rnd.choice(["en", None]), "site" + str(rnd.randrange(2) + 2 * bad), len(text), "x", 7))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    shown = labels[:300]
    out = {r.doc_id: r for r in quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(shown, LABELS)).collect()}
    assert np.mean([out[i].keep == bool(q) for i, q, _ in labels[300:]]) > 0.98
    assert np.mean([(out[i].p_text > 0.5) == bool(q) for i, q, _ in labels[300:]]) > 0.95
    assert np.mean([(out[i].p_meta > 0.5) == bool(q) for i, q, _ in labels[300:]]) > 0.85
    kept = quality.drop_rejected(spark.createDataFrame(docs, DOCS), spark.createDataFrame(shown, LABELS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.keep}


def test_pseudo_labels_help_the_weaker_view():
    rnd = np.random.default_rng(1)
    y = (rnd.random(4000) < 0.5).astype(float)
    strong, weak = y[:, None] * 6 + rnd.normal(size=(4000, 1)), (y[:, None] * 2 + rnd.normal(size=(4000, 30)))
    few = slice(0, 24)
    alone = quality.fit(weak[few], y[few])
    model = quality.co_train([strong[few], weak[few]], y[few], lambda *m: quality.pseudo_sums(*m, [strong[24:2000], weak[24:2000]]))
    right = lambda m: np.mean((m.logit(weak[2000:]) > 0) == (y[2000:] > 0))
    assert right(model.views[1]) >= right(alone)


def test_features_of_long_and_empty_texts():
    data, offsets = u.utf8(__import__("pyarrow").array(["", "a a a b", "A# 9.\né", "x" * 300_000]))
    x = dict(zip(quality.TEXT, quality.text_features(data, offsets).T, strict=True))
    assert x["adjacent"].tolist() == [0, 0.5, 0, 0] and x["repeated"].tolist() == [0, 0.5, 0, 0]
    assert x["symbols"][2] == 1 / 8 and x["wide"][2] == 2 / 8 and not x["size"][0]


def test_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(spark.createDataFrame([], DOCS), none).count() == 0
    docs = spark.createDataFrame([(1, "a", None, None, None, None, None), (1, "a", None, None, None, None, None), (None, None, None, None, None, None, None), (2, "", "en", "s", -5, None, None)], DOCS)
    assert [(r.score, r.keep, r.p_text) for r in quality.classify(docs, none).collect()] == [(1.0, True, None)] * 4
    assert quality.drop_rejected(docs, none).count() == 4
    twice = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, None), (None, 1, 1), (3, None, 0)], LABELS)
    assert quality.classify(docs, twice).count() == 4


def test_the_views_teach_each_other():
    """Few labels, metadata that tells all: the text view alone errs, with the other's pseudo-labels it learns."""
    rnd = np.random.default_rng(5)
    y = (rnd.random(4000) < 0.5).astype(float)
    meta, text = y[:, None] * 8 + rnd.normal(size=(4000, 2)), y[:, None] * 0.4 + rnd.normal(size=(4000, 40))
    few, pool, test = slice(0, 120), slice(120, 3000), slice(3000, None)
    right = lambda m: np.mean((m.logit(text[test]) > 0) == (y[test] > 0))
    none = lambda models, _: [np.zeros((2, 1 + len(m.weights) * (1 + len(m.weights)))) for m in models]
    alone = quality.co_train([text[few], meta[few]], y[few], none)
    taught = quality.co_train([text[few], meta[few]], y[few], lambda *m: quality.pseudo_sums(*m, [text[pool], meta[pool]]))
    assert right(taught.views[0]) > right(alone.views[0]) + 0.05


def test_pool_sums_are_those_of_all_rows(spark):
    docs, labels = tables(spark, 300)
    rows = quality.features(spark.createDataFrame(docs, DOCS).repartition(5))
    views = quality._views(lambda c, t=rows.toPandas(): t[c].to_numpy())
    y = np.array([q for _, q, _ in labels], float)
    models = [quality.fit(x, np.resize(y, len(x))) for x in views]
    calibration = [quality.fit(m.logit(x)[:, None], np.resize(y, len(x))) for m, x in zip(models, views, strict=True)]
    for got, want in zip(quality._pool(rows)(models, calibration), quality.pseudo_sums(models, calibration, views), strict=True):
        assert np.allclose(got, want)


def test_ties_and_long_texts(spark):
    """The same text twice gets one score; a very long one is read whole."""
    docs, labels = tables(spark, 200)
    long = " ".join(["w1"] * 60_000)
    docs += [(900, docs[0][1], *docs[0][2:]), (901, long, "en", "site0", len(long), "x", 1), (902, long + "###" * 60_000, "en", "site0", 1, "x", 1)]
    out = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert out[900] == out[0] and out.keys() >= {901, 902} and all(0 <= x <= 1 for x in out.values())
