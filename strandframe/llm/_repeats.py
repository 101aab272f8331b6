"""Finding repeated windows without moving every window.

Consecutive windows with the same anchor (their least k-gram) form a run. A window's content fixes its anchor and
the anchor's place in it, so equal windows stand in runs with equal anchors. A count-min sketch of the anchors
overestimates every window's count, and only runs with an anchor estimated repeated are looked at further. Equal runs
(a 128-bit hash of the content and the anchor's place) are grouped exactly, with partial aggregation, so that any
number of copies becomes one distinct run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from . import _units as u

#: Names a distinct run: 128 bits of its content, which also fix its anchor.
RUN = ["key", "key2"]
#: Names a window's content.
WINDOW = ["wh", "wh2"]

#: From bytes and offsets of a chunk to the hashes of its units and each document's first unit.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def anchor_keys(units: Units, width: int, k: int):
    def run(batches):
        for _, data, offsets in u.chunks(batches):
            hashes, first = units(data, offsets)
            yield u.runs(hashes, first, width, k).anchor

    return run


def runs_of(units: Units, width: int, k: int, found: _sketch.Sketch):
    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            hashes, first = units(data, offsets)
            r = u.runs(hashes, first, width, k)
            keep = np.flatnonzero(found.repeated(r.anchor))
            doc = np.searchsorted(first, r.start[keep], "right") - 1
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [u.long(r.anchor[keep]), u.long(r.key[keep]), u.long(r.key2[keep]), rows.column("_id").take(row), rows.column("_k").take(row), u.long(r.start[keep] - first[doc]), pa.array(r.count[keep].astype(np.int32)), pa.array((r.place - r.start)[keep].astype(np.int32))],
                ["anchor", "key", "key2", "_id", "_k", "at", "n", "lead"],
            )

    return run


def candidate_runs(docs: DataFrame, units: Units, width: int, k: int, width_bits: int = _sketch.WIDTH_BITS) -> DataFrame:
    """(anchor, key, key2, _id, _k, at, n, lead) of every run whose anchor may occur twice; docs as from keyed()."""
    found = _sketch.sketch(docs.select("text"), anchor_keys(units, width, k), width_bits)
    return docs.select("_id", "_k", "text").mapInArrow(runs_of(units, width, k, found), "anchor long, key long, key2 long, _id long, _k long, at long, n int, lead int")


def shared_anchors(distinct: DataFrame) -> DataFrame:
    """The anchors of several distinct runs: only there can different runs share a window."""
    return distinct.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")


def windows_of(units: Units, width: int):
    """For mapInArrow over (_id, _k, text, runs array<struct<key, key2, at, n>>): a row for each window of each run.

    step: the window's place in its run; wh, wh2: 128 bits of its content.
    """

    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            hashes, first = units(data, offsets)
            p, p2 = u.span_hashes(hashes), u.span_hashes(u.mix(hashes + u.U(1)), 1)
            listed = rows.column("runs")
            doc = pa.compute.list_parent_indices(listed).to_numpy().astype(np.int64)
            flat = listed.flatten()
            at, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(np.arange(len(n)), n)
            start = first[doc[of]] + at[of] + step
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(c).take(pa.array(of)) for c in RUN), rows.column("_id").take(pa.array(doc[of])), pa.array(step.astype(np.int32)), u.long(u.mix(u.between(p, start, start + width))), u.long(u.mix(u.between(p2, start, start + width, 1)))],
                [*RUN, "_id", "step", *WINDOW],
            )

    return run


WINDOWS = "key long, key2 long, _id long, step int, wh long, wh2 long"


def windows(docs: DataFrame, runs: DataFrame, units: Units, width: int) -> DataFrame:
    """Every window of the given runs (key, key2, _id, _k, at, n), from the documents' texts."""
    of_doc = runs.groupBy("_id", "_k").agg(F.collect_list(F.struct(*RUN, "at", "n")).alias("runs"))
    return docs.join(of_doc, ["_id", "_k"]).mapInArrow(windows_of(units, width), WINDOWS)
