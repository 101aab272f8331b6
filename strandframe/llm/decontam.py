"""Benchmark decontamination by winnowing.

Of every window of ten words the least 5-gram hash is kept, with its place: windows that follow each other mostly keep
the same one, so two of seven words or so have a fingerprint. A shared span of ten words has a common fingerprint at the
same place of the span. Each one carries the hashes of the words that a window with it may still hold, up to five on either
side. Training and test fingerprints are joined, and a hit is extended to both sides as far as the words agree: a common
span of ten words or more is made of windows that occur in the item. An item of fewer words is one window of its own; for
each such length that the benchmark has, documents are winnowed with windows of that length, and the hit must extend to
the whole item.

A bitmap of the test fingerprints (fixed size) is sent to the tasks, so that only document fingerprints which may occur
are shuffled; the join itself is exact, whatever the bitmap lets through. Fingerprints of very many documents or
items, as those of a one-word item, are dealt out over tasks. Words are told apart by 64 bits of their hashes, and the
five (or fewer) of a fingerprint by 128 bits of theirs together.

An item without an id counts like any other for words and hits, and all of them as one item in n_items, as in the
query's SQL; the list of ids leaves null out.

Null and empty texts have no words; a document without words, and any document when the benchmark is empty, has no
hits. Rows that agree in doc_id and text count as one document for the joins, and each of them gets its row. Texts of any
length are winnowed whole. Equal fingerprints in one window: the leftmost is kept on both sides, so ties change nothing.
Extra columns are ignored by `hits` and kept by `drop_contaminated`.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import dealt
from . import _sketch
from . import _units as u
from ._shared import keyed, matched, written

WINDOW, GRAM, BITS = 10, 5, 24

#: Words are runs of these bytes of the lower-cased text: a-z, 0-9 and everything beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[np.r_[48:58, 97:123, 128:256]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_FIELDS = {"len": "int", "fp": "long", "fp2": "long", "at": "int", "before": "array<long>", "after": "array<long>"}
_FOUND_SQL = f"array<struct<{', '.join(f'{k} {v}' for k, v in _FIELDS.items())}>>"


class Fingerprints(NamedTuple):
    doc: np.ndarray
    at: np.ndarray  # place of the gram among the document's words
    fp: np.ndarray
    fp2: np.ndarray  # 64 more bits of the gram
    before: pa.ListArray  # hashes of the words before the gram that a window may hold, nearest first
    after: pa.ListArray


def _listed(hashes: np.ndarray, index: np.ndarray, inside: np.ndarray) -> pa.ListArray:
    """For each row of places, the hashes of those inside, which come before the others."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(inside.sum(axis=1)))).astype(np.int32)), u.long(hashes[index[inside]]))


def winnowed(w: u.Words, size: int, whole: bool, bits: np.ndarray | None = None) -> Fingerprints:
    """The fingerprints of windows of size words, with whole only of documents of just that size, with bits only of those
    set in this bitmap."""
    starts = w.first[:-1][np.diff(w.first) == size] if whole else u.window_starts(w.first, size)
    k = min(GRAM, size)
    place, gram = u.anchors(w.hash, starts, size, k)
    place = np.unique(place)
    fp = gram[place]
    if bits is not None:
        cell = fp >> u.U(64 - BITS)
        keep = np.flatnonzero(bits[cell >> u.U(3)] >> (cell & u.U(7)).astype(np.uint8) & 1)
        place, fp = place[keep], fp[keep]
    doc = np.searchsorted(w.first, place, "right") - 1
    fp2 = u.mix(u.between(u.span_hashes(u.mix(w.hash + u.U(1)), 1), place, place + k, 1))
    reach = np.arange(size - k)
    back, on = place[:, None] - 1 - reach, place[:, None] + k + reach
    return Fingerprints(doc, place - w.first[doc], fp, fp2, _listed(w.hash, back, back >= w.first[doc][:, None]), _listed(w.hash, on, on < w.first[doc + 1][:, None]))


def _columns(f: Fingerprints, size: int) -> list[pa.Array]:
    return [pa.array(np.full(len(f.doc), size, np.int32)), u.long(f.fp), u.long(f.fp2), pa.array(f.at.astype(np.int32)), f.before, f.after]


def _item_fingerprints(size: int):
    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            w = u.words(LOWER[data], offsets, INSIDE)
            for n in range(1, size + 1):
                f = winnowed(w, n, n < size)
                yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(f.doc)), *_columns(f, n)], ["item", *_FIELDS])

    return run


def _document_fingerprints(lengths: list[int], bitmap):
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for rows, data, offsets in u.chunks(batches):
            w = u.words(LOWER[data], offsets, INSIDE)
            found = [winnowed(w, n, False, bits) for n in lengths]
            doc = np.concatenate([f.doc for f in found]) if found else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            of_doc = np.searchsorted(doc[order], np.arange(rows.num_rows + 1)).astype(np.int32)
            none = [pa.array([], pa.int32()), *[pa.array([], pa.int64())] * 2, pa.array([], pa.int32()), *[pa.array([], pa.list_(pa.int64()))] * 2]
            columns = [pa.concat_arrays(list(c)) for c in zip(none, *(_columns(f, n) for f, n in zip(found, lengths, strict=True)), strict=True)]
            values = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in columns], list(_FIELDS))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "_id", "_k")), u.long(np.diff(w.first)), pa.ListArray.from_arrays(pa.array(of_doc), values)],
                ["doc_id", "_id", "_k", "n_words", "found"],
            )

    return run


def _bitmap(windows: DataFrame) -> bytearray:
    """One bit for each possible leading BITS bits of a fingerprint: 2 MB, whatever the benchmark's size."""
    cell = F.shiftrightunsigned("fp", 64 - BITS).cast("long")
    return _sketch.bitmap(windows.select(cell.alias("cell")).distinct(), 1 << BITS)


def _common(x: str, y: str) -> Column:
    """How many leading elements of two arrays agree."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1)


def spans(found: DataFrame, tests: DataFrame) -> DataFrame:
    """(_id, _k, item, at, to): common spans of a document and an item, not less than a window, around their common
    fingerprints; both are written tables."""
    left, right, keys = dealt(found, tests.select("len", "fp", "fp2", F.col("before").alias("_before"), F.col("after").alias("_after"), "item"), "fp", "_k", "item")
    hit = left.join(right, [*keys, "len", "fp2"]).withColumns({"_l": _common("before", "_before"), "_r": _common("after", "_after")})
    at, to = F.col("at") - F.col("_l"), F.col("at") + F.least(F.lit(GRAM), F.col("len")) + F.col("_r")
    return hit.select("_id", "_k", "item", "len", at.alias("at"), to.alias("to")).where(F.col("to") - F.col("at") >= F.col("len"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """doc_id, _id, _k, n_words, n_hit (words inside an occurrence of a window), items (sorted ids as strings, without null)
    and no_id (whether an item without an id occurs)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    tests = written(items.mapInArrow(_item_fingerprints(window), f"item string, {', '.join(f'{k} {v}' for k, v in _FIELDS.items())}").drop("at").distinct())
    lengths = sorted(r.len for r in tests.select("len").distinct().collect())  # at most `window` numbers
    bitmap = spark.sparkContext.broadcast(_bitmap(tests))
    seen = written(keyed(docs, id_col, text_col).mapInArrow(_document_fingerprints(lengths, bitmap), f"doc_id {id_type}, _id long, _k long, n_words long, found {_FOUND_SQL}"))
    found = written(seen.where(F.size("found") > 0).dropDuplicates(["_id", "_k"]).select("_id", "_k", F.inline("found")))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "to"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["at"], a["to"]))).alias("n"), F.greatest(a["to"], x["to"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    of_doc = spans(found, tests).groupBy("_id", "_k").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("no_id"))
    return seen.drop("found").join(of_doc, ["_id", "_k"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")), "no_id": F.coalesce("no_id", F.lit(False))})


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document with its digest columns."""
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("no_id").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the contaminated ones."""
    return matched(docs, hits(docs, benchmark).where("n_hit > 0").select("_id", "_k").distinct(), "left_anti")
