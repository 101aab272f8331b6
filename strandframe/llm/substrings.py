"""Substring deduplication behind a count-min prefilter.

A word goes if it is covered by a window of 50 words that also starts in a document with a smaller doc_id. The
sketches that partitions build are merged and overestimate window counts (`_repeats`); a second pass groups exactly
those windows estimated repeated, so none is lost.

The second pass groups equal runs of windows first. Of a distinct run only the smallest doc_id can be in doubt: in
every other document all its windows go. Only where an anchor has several distinct runs, the windows of their first
documents are grouped one by one.

Null or empty text: no words, nothing removed. A null doc_id counts as larger than any other. Rows that agree in
doc_id and text are one document and get a row each; documents with the same doc_id don't remove each other's words.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as rep
from . import _units as u
from ._shared import keyed, written

WINDOW, GRAM = 50, 8
INSIDE = ~u.ASCII_SPACE


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = u.words(data, offsets, INSIDE)
    return w.hash, w.first


def removed_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sketch) -> DataFrame:
    """(_id, _k, at, n): stretches of n consecutive windows to remove, from place at on; docs as from keyed()."""
    runs = written(rep.candidate_runs(docs, units, window, gram, **sketch))
    first = F.min(F.struct("_id", "_k", "at", "n", "anchor"))
    distinct = written(runs.groupBy(*rep.RUN).agg(first.alias("first")).select(*rep.RUN, "first.*"))
    later = runs.join(distinct.select(*rep.RUN, F.col("_id").alias("least")), rep.RUN).where("_id > least").select("_id", "_k", "at", "n")
    doubtful = distinct.join(rep.shared_anchors(distinct).select("anchor"), "anchor", "left_semi")
    each = rep.windows(docs, doubtful, units, window)  # not written: so its exchange of the texts is the result's too
    least = each.groupBy(*rep.WINDOW).agg(F.min("_id").alias("least"))
    lost = each.join(least, rep.WINDOW).where("_id > least").select(*rep.RUN, "_id", "step").distinct()
    firsts = runs.join(doubtful.select(*rep.RUN, "_id"), [*rep.RUN, "_id"], "left_semi")  # a run may stand several times in its first document
    singly = firsts.join(lost, [*rep.RUN, "_id"]).select("_id", "_k", (F.col("at") + F.col("step")).alias("at"), F.lit(1).alias("n"))
    return later.unionByName(singly)


def _applied(window: int):
    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            start, end, first = u.word_spans(data, offsets, INSIDE)
            listed = rows.column("spans")
            doc = pa.compute.list_parent_indices(listed).to_numpy().astype(np.int64)
            flat = listed.flatten()
            low = first[doc] + flat.field("at").to_numpy()
            high = low + flat.field("n").to_numpy() + window - 1
            change = np.bincount(low, minlength=len(start) + 1)[: len(start) + 1] - np.bincount(high, minlength=len(start) + 1)[: len(start) + 1]
            gone = np.cumsum(change)[: len(start)] > 0
            lost = np.concatenate(([0], np.cumsum(gone)))
            texts = []
            for i in range(rows.num_rows):
                a, b = first[i], first[i + 1]
                kept = np.flatnonzero(~gone[a:b]) + a
                one = data[offsets[i] : offsets[i + 1]]
                texts.append(b" ".join(one[s:e].tobytes() for s, e in zip(start[kept] - offsets[i], end[kept] - offsets[i], strict=True)) if lost[b] > lost[a] else b" ".join(one.tobytes().split()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), u.long(np.diff(first)), u.long(lost[first[1:]] - lost[first[:-1]]), pa.array([t.decode() for t in texts], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sketch) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    docs_k = keyed(docs)
    spans = removed_windows(docs_k, window, gram, **sketch).groupBy("_id", "_k").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    id_type = docs_k.schema["doc_id"].dataType.simpleString()
    return docs_k.join(spans, ["_id", "_k"], "left").select("doc_id", "text", "spans").mapInArrow(_applied(window), f"doc_id {id_type}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, **options) -> DataFrame:
    return deduplicate(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
