"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1 bits: the exhaustive code for up to EXHAUSTIVE languages, else random dense
columns of a fixed seed. Each bit has a binary classifier over hashed byte trigrams: the log ratio of a trigram's
frequency in the languages of +1 to that in those of -1. The counts behind it are one pass over all training
documents, added up by partition and then by a shuffle; nothing is sampled.

A document's margin for a bit is its trigrams' mean log ratio, centred and scaled so that the two sides are expected at
+1 and -1. Decoding takes the codeword of least loss, the sum of exp(-margin * bit) weighted by each bit's separation.
The score is the softmax of the negative losses; a document is ambiguous if the runner-up's loss is within AMBIGUOUS
of the best.

Training uses rows with a non-null language and a non-null id whose crc32 isn't in the held-out quarter. Prediction
sees text only. Text that is null or has no letter gets `und` with score 0; so does all text if nothing was learned.
With one language learned, text gets it with score 1. Ties go to the first language by name. Rows that repeat count
each; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import extended

CELLS, EXHAUSTIVE, SEED, SMOOTHING, AMBIGUOUS = 1 << 15, 5, 11, 0.5, 0.1

#: Lower case; what is neither an ASCII letter nor part of another character is a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # (CELLS + 1) x bits; the last row, of no trigram, is zero
    centre: np.ndarray
    scale: np.ndarray


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    if n <= EXHAUSTIVE:
        if n < 2:
            return np.zeros((n, 0), np.int8)
        columns = [[1, *(1 if bits >> i & 1 else -1 for i in range(n - 1))] for bits in range((1 << (n - 1)) - 1)]
        return np.array(columns, np.int8).T
    bits, rnd = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    while True:
        code = rnd.choice(np.array([-1, 1], np.int8), (n, bits))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The cell of the trigram at each byte; CELLS where a document has no three more bytes or only spaces follow."""
    b = FOLD[data].astype(np.uint32)
    cell = np.full(len(b), CELLS, np.int64)
    if len(b) > 2:
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        cell[:-2] = np.where(code == 0x202020, CELLS, code * np.uint32(0x9E3779B1) >> np.uint32(32 - 15))
    ends = offsets[1:][np.diff(offsets) > 0]
    cell[ends - 1] = CELLS
    cell[np.maximum(ends - 2, 0)] = CELLS
    return cell


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _counts(batches):
    total: dict[str, np.ndarray] = {}
    for rows, data, offsets in u.chunks(batches):
        cell = trigrams(data, offsets)
        langs = rows.column("lang").to_pylist()
        names = sorted(set(langs))
        index = {x: i for i, x in enumerate(names)}
        of_doc = np.repeat([index[x] for x in langs], np.diff(offsets))
        found = np.bincount(of_doc * (CELLS + 1) + cell, minlength=len(names) * (CELLS + 1)).reshape(len(names), -1)
        for x, row in zip(names, found, strict=True):
            total[x] = total[x] + row if x in total else row
    for x, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "cell", "n"])


def learn(docs: DataFrame) -> Model:
    """docs: text, lang (no null). What comes to the driver is a count for each language and cell, not of documents."""
    counts = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(languages), CELLS + 1))
    np.add.at(table, ([index[x] for x in counts.column("lang").to_pylist()], counts.column("cell").to_numpy()), counts.column("n").to_numpy())
    table = table[:, :CELLS]
    share = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights, centre, scale = np.zeros((CELLS + 1, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1])
    for bit in range(code.shape[1]):
        plus, minus = share[code[:, bit] > 0].mean(axis=0), share[code[:, bit] < 0].mean(axis=0)
        w = np.log(plus / minus)
        weights[:CELLS, bit] = w
        centre[bit], scale[bit] = (plus @ w + minus @ w) / 2, max((plus @ w - minus @ w) / 2, 1e-9)
    return Model(languages, code, weights, centre, scale)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict_chunk(m: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language, score and ambiguity of each document."""
    n = len(offsets) - 1
    cell = trigrams(data, offsets)
    doc = np.flatnonzero(np.diff(offsets))
    sums, count = np.zeros((n, m.code.shape[1])), np.zeros(n)
    if len(doc):
        sums[doc] = np.add.reduceat(m.weights[cell], offsets[doc], axis=0, dtype=np.float64)
        count[doc] = np.add.reduceat(cell != CELLS, offsets[doc], dtype=np.int64)
    margin = np.where(count[:, None] > 0, (sums / np.maximum(count, 1)[:, None] - m.centre) / m.scale, 0.0)
    weight = m.scale / m.scale.sum() if len(m.scale) else m.scale
    loss = (weight * np.exp(np.clip(-margin[:, None, :] * m.code, -30, 30))).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    share = np.exp(4 * (loss.min(axis=1, keepdims=True) - loss))
    best = order[:, 0]
    score = share[np.arange(n), best] / share.sum(axis=1)
    second = np.take_along_axis(loss, order[:, 1:2], axis=1)[:, 0] if loss.shape[1] > 1 else np.full(n, np.inf)
    return best, score, second - loss.min(axis=1) < AMBIGUOUS


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names = np.array([*m.languages, "und"])
        for rows, data, offsets in u.chunks(batches, text_col):
            n = rows.num_rows
            letters = np.concatenate(([0], np.cumsum((FOLD[data] != 32) & (data < 128))))
            lettered = letters[offsets[1:]] > letters[offsets[:-1]]
            for i in np.flatnonzero(~lettered):
                lettered[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            best, score, unsure = predict_chunk(m, data, offsets) if m.languages else (np.zeros(n, int), np.zeros(n), np.ones(n, bool))
            best = np.where(lettered, best, len(m.languages))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(np.where(lettered, unsure, True))],
                [*rows.schema.names, "lang_pred", "score", "ambiguous"],
            )

    return docs.mapInArrow(run, extended(docs, {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learned from the rows that aren't held out."""
    training = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("text", "lang")
    model = learn(training)
    return predict(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model).drop("text")
