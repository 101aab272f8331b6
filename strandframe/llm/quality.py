"""Quality classification by co-training.

Two views of a document: its text (shares of symbols, capitals, digits, repeated words, line shapes and the like, over
the whole text) and its metadata (source, language, stated length). A logistic classifier for each view starts from the
labelled rows. In every round each classifier scores all unlabelled documents, and those it is sure of (its calibrated
probability, by one threshold for all) are pseudo-labels of the other, which takes a Newton step on labels and pseudo-labels together. The step needs
sums of gradients and curvatures only; tasks add them up and a shuffle merges them. Of either side the pseudo-labels
together weigh at most as much as the labels. Calibration (Platt) is on labelled rows that training never saw; at the end
a last logistic regression on those rows combines the calibrated views, and every document is scored.

Features come from one pass over all documents, whole texts. Only the labelled rows are a sample, of about LABELLED by
a threshold on a hash of id and text, so some 20,000 short rows of numbers reach the driver whatever the input. Scoring
is a DataFrame expression.

Null or empty text: all text features zero. Null metadata is a value of its own. Null ids and ids without a label are
scored, not learned from; of several labels of an id the smallest quality counts. Without labels of both kinds nothing
is learned: every document gets the share of good labels (1 without labels) and views null. Repeated rows are scored
alike. Extra columns are ignored by `classify` and kept by `drop_rejected`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import emptied, extended, written

LABELLED, ROUNDS, SURE, THRESHOLD = 20_000, 4, 0.95, 0.5
SOURCES, LANGUAGES = 32, 8

_CLASS = np.zeros((6, 256), bool)  # symbols, capitals, digits, sentence marks, line ends, beyond ASCII
_CLASS[0, list(b"#$%&*!|<>{}[]\\^~=_@+/`")] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, list(b".,;:?")] = True
_CLASS[4, 10] = True
_CLASS[5, 128:] = True

TEXT = ["symbols", "capitals", "digits", "marks", "lines", "wide", "word_size", "adjacent", "repeated", "marked_words", "size"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of TEXT for each document."""
    n = np.maximum(np.diff(offsets), 1)
    w = u.words(data, offsets, ~u.ASCII_SPACE)
    count = np.maximum(np.diff(w.first), 1)
    doc = np.repeat(np.arange(len(n)), np.diff(w.first))
    adjacent = np.zeros(len(w.hash), bool)
    adjacent[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, doc))
    seen = np.zeros(len(w.hash), bool)
    seen[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    marked = _CLASS[0][data[w.end - 1]] if len(w.end) else np.zeros(0, bool)
    rows = [_sums(c[data], offsets) / n for c in _CLASS]
    rows += [np.minimum(np.log1p(_sums(~u.ASCII_SPACE[data], offsets) / count), 10), _sums(adjacent, w.first) / count, _sums(seen, w.first) / count, _sums(marked, w.first) / count, np.log1p(np.diff(offsets))]
    return np.stack(rows, axis=1)


def _features(batches):
    for rows, data, offsets in u.chunks(batches):
        x = text_features(data, offsets)
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "_id", "_k", "source", "lang", "stated")), *map(pa.array, np.ascontiguousarray(x.T))], ["doc_id", "_id", "_k", "source", "lang", "stated", *TEXT])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _k, the metadata as numbers (source, lang: hashed cells; stated: log of the length), and TEXT."""

    rows = docs.select(*(c.alias(n) for n, c in (_metadata(docs) | _key(docs)).items()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_features, f"doc_id {id_type}, _id long, _k long, source int, lang int, stated double, " + ", ".join(f"{c} double" for c in TEXT))


def _metadata(docs: DataFrame) -> dict[str, Column]:
    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")

    return {
        "source": F.pmod(F.xxhash64(F.coalesce(column("source"), F.lit(""))), F.lit(SOURCES)).cast("int"),
        "lang": F.pmod(F.xxhash64(F.coalesce(column("lang"), F.lit(""))), F.lit(LANGUAGES)).cast("int"),
        "stated": F.log1p(F.greatest(F.coalesce(column("n_chars").try_cast("double"), F.lit(0.0)), F.lit(0.0))),
    }


def _key(docs: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in ("doc_id",)} | {
        "text": F.coalesce("text", F.lit("")),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)),
        "_k": F.xxhash64("doc_id", "text"),
    }


class Logistic(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(((x - self.mean) / self.spread, np.ones(len(x))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def column(self, inputs: list[Column]) -> Column:
        out = F.lit(float(self.weights[-1]))
        for c, m, s, w in zip(inputs, self.mean, self.spread, self.weights[:-1], strict=True):
            out = out + (c - F.lit(float(m))) * F.lit(float(w / s))
        return out


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> Logistic:
    """Newton's method with an L2 penalty."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, spread, w)


def metadata_matrix(source: np.ndarray, lang: np.ndarray, stated: np.ndarray) -> np.ndarray:
    return np.column_stack((np.eye(SOURCES)[source], np.eye(LANGUAGES)[lang], stated, stated**2))


def metadata_columns() -> list[Column]:
    stated = F.col("stated")
    return [*((F.col("source") == i).cast("double") for i in range(SOURCES)), *((F.col("lang") == i).cast("double") for i in range(LANGUAGES)), stated, stated * stated]


class Model(NamedTuple):
    views: list[Logistic]  # text, metadata
    calibration: list[Logistic]
    combination: Logistic


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _slopes(m: Logistic, x: np.ndarray, y: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss of rows x with labels y."""
    z = m.scaled(x)
    p = _p(z @ m.weights)
    return z.T @ (p - y), (z * (p * (1 - p) + 1e-9)[:, None]).T @ z


def pseudo_sums(models: list[Logistic], calibration: list[Logistic], views: list[np.ndarray]) -> list[np.ndarray]:
    """For each pupil, two rows (bad, good): how many rows its teacher is sure of, their gradient and curvature, flat."""
    out = []
    for pupil in range(2):
        p = _p(calibration[1 - pupil].logit(models[1 - pupil].logit(views[1 - pupil])[:, None]))
        rows = []
        for good, sure in ((0.0, p < 1 - SURE), (1.0, p > SURE)):
            gradient, curvature = _slopes(models[pupil], views[pupil][sure], good)
            rows.append(np.concatenate(([sure.sum()], gradient, curvature.ravel())))
        out.append(np.array(rows))
    return out


def _step(m: Logistic, x: np.ndarray, y: np.ndarray, pseudo: np.ndarray, penalty: float = 1.0) -> Logistic:
    gradient, curvature = _slopes(m, x, y)
    n = len(m.weights)
    for (count, *sums), share in zip(pseudo, (1 - y.mean(), y.mean()), strict=True):
        if count:
            weight, sums = min(1.0, len(y) * share / count), np.array(sums)
            gradient, curvature = gradient + weight * sums[:n], curvature + weight * sums[n:].reshape(n, n)
    ridge = np.diag([penalty] * (n - 1) + [1e-6])
    return m._replace(weights=m.weights - np.linalg.solve(curvature + ridge, gradient + ridge @ m.weights))


def co_train(views: list[np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """views: the labelled rows as each view sees them, y 0 or 1; every fourth labelled row is kept for calibration.

    pool: from two classifiers and their calibration to the sums of pseudo_sums() over all unlabelled rows."""
    aside = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside[:] = False
    known = [x[~aside] for x in views]
    models = [fit(x, y[~aside]) for x in known]
    test = aside if aside.any() else np.ones(len(y), bool)

    def calibrated():
        logits = [m.logit(x[test])[:, None] for m, x in zip(models, views, strict=True)]
        return logits, [fit(v, y[test]) for v in logits]

    for _ in range(rounds):
        sums = pool(models, calibrated()[1])
        models = [_step(m, x, y[~aside], s) for m, x, s in zip(models, known, sums, strict=True)]
    logits, calibration = calibrated()
    combination = fit(np.column_stack([c.logit(v) for c, v in zip(calibration, logits, strict=True)]), y[test])
    return Model(models, calibration, combination)


def _views(column) -> list[np.ndarray]:
    """Both views' matrices; column: from a name to an array."""
    return [np.column_stack([column(c).astype(float) for c in TEXT]), metadata_matrix(column("source").astype(int), column("lang").astype(int), column("stated").astype(float))]


def _pool(free: DataFrame):
    """pseudo_sums() over all rows of free, added up on Spark."""

    def sums(models: list[Logistic], calibration: list[Logistic]) -> list[np.ndarray]:
        sent = free.sparkSession.sparkContext.broadcast((models, calibration))

        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    found = pseudo_sums(*sent.value, _views(lambda c, b=b: b.column(c).to_numpy()))
                    total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
            if total is not None:
                flat = np.concatenate([x.ravel() for x in total])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

        shapes = [(2, 1 + len(m.weights) * (1 + len(m.weights))) for m in models]
        flat = np.zeros(sum(a * b for a, b in shapes))
        for r in free.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as the models have entries
            flat[r.i] = r.v
        cut = shapes[0][0] * shapes[0][1]
        return [flat[:cut].reshape(shapes[0]), flat[cut:].reshape(shapes[1])]

    return sums


def learn(rows: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[Model | None, float]:
    """A model and the share of good labels; rows as from features()."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").alias("_doc")).agg(F.min(label_col).alias("y"))
    marked = rows.dropDuplicates(["_id", "_k"]).join(good, rows.doc_id == good._doc, "left").where("doc_id is not null")
    marked = written(marked.select("_id", "_k", "y", "source", "lang", "stated", *TEXT))
    known, n = marked.where("y is not null"), marked.where("y is not null").count()
    if n > LABELLED:  # by a hash, so no task sends more than its share
        known = known.where(F.pmod(F.xxhash64("_id", "_k", F.lit("sample")), F.lit(1 << 30)) < int(LABELLED / n * (1 << 30)))
    known = known.toPandas().sort_values(["_id", "_k"], kind="stable")
    y = known["y"].to_numpy(float)
    model = co_train(_views(lambda c: known[c].to_numpy()), y, _pool(marked.where("y is null"))) if len(set(y)) == 2 else None
    emptied(marked)
    return model, float(y.mean()) if len(y) else 1.0


def _probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))


def probabilities(model: Model | None, share: float) -> list[Column]:
    """p_text, p_meta and score (probability of good quality) from the columns of features()."""
    if model is None:
        return [F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(share)]
    logits = [c.column([m.column(x)]) for m, c, x in zip(model.views, model.calibration, ([F.col(c) for c in TEXT], metadata_columns()), strict=True)]
    return [*map(_probability, logits), _probability(model.combination.column(logits))]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta, score and keep."""
    rows = written(features(docs))
    columns = probabilities(*learn(rows, labels))
    return rows.select("doc_id", *(c.alias(n) for c, n in zip(columns, ("p_text", "p_meta", "score"), strict=True))).withColumn("keep", F.col("score") >= threshold)


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns whatever their names, without the rejected ones. The texts are read twice, once to learn and once
    to judge, so that they needn't be shuffled for a join with their scores."""
    score = probabilities(*learn(written(features(docs)), labels))[2]
    own = "_f_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    names = [f"{own}{c}" for c in TEXT]

    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, np.ascontiguousarray(x.T))], [*rows.schema.names, *names])

    meta = docs.select("*", *(c.alias(f"{own}{n}") for n, c in _metadata(docs).items()))
    judged = meta.mapInArrow(run, extended(meta, dict.fromkeys(names, "double")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    return judged.select(whole, *(F.col(f"{own}{c}").alias(c) for c in ("source", "lang", "stated", *TEXT))).where(score >= threshold).select("_doc.*")
