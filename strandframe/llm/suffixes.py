"""Suffix-array deduplication by column-wise construction over many documents at once.

A byte goes if it is covered by a 200-byte string that also starts at any other place of the corpus, in the same
document or another.

The method inserts one symbol per document each round, from the last to the first, and updates the order of all
suffixes (the permutation behind the collection's Burrows-Wheeler transform) and the common prefixes of neighbours. As
it stands it takes as many rounds, each through files as long as the corpus, as the longest document has bytes: over a
hundred thousand here. So documents are first cut into the stretches that can matter. Runs of 200-byte windows with a
common anchor (their least 32-byte gram, see `_repeats`) are grouped; equal runs are repeats at once, whatever their
number; anchors with a single distinct run are done. What is left are segments of at most 367 bytes of different runs
with one anchor. These are the collection's documents: sorted by anchor through Spark's shuffle files, read in
sequence in blocks of whole groups, aligned at their anchors, and inserted column by column. Equal windows stand in
equal columns of one group, so after the round of a column each window of 200 bytes or more in common with a neighbour
in the order is a repeat, and no other is.

Every group is inserted in parts of about BLOCK segments, told by a hash, so that a passage with very many different
surroundings is never gathered in a task; all but very large groups have one part. Of a group of several parts each part
also gives one of every distinct window, and these, aggregated over the parts, tell the windows that repeat across them.

Null or empty text: no bytes. Rows that agree in doc_id and text are separate places, so they repeat each other. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as rep
from . import _units as u
from ._shared import keyed, written

LENGTH, GRAM, BLOCK = 200, 32, 20_000


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return u.BYTE_HASH[data], offsets


def insert_columns(group: np.ndarray, data: np.ndarray, first: np.ndarray, lead: np.ndarray, length: int, listed: np.ndarray | None = None):
    """For each segment and window, whether another segment of its group has the same window in the same column.

    group: non-decreasing; data, first: the segments' bytes; lead: bytes of each segment before its anchor. Returns
    (segment, place in the segment) of every repeated window; if listed, a flag for each segment, is given, also
    (segment, place, repeated) of the first in the order of all equal windows of the flagged segments.
    """
    low, high = -lead, np.diff(first) - lead  # columns of each segment, relative to the anchor
    order = np.zeros(0, np.int64)  # segments with a suffix from the last column on, by group and suffix
    common = np.zeros(0, np.int64)  # common prefix with the suffix before, 0 for the first of a group
    enter = np.argsort(-high, kind="stable")
    entered, segments, places, heads = 0, [], [], []
    for column in range(int(high.max(initial=0)) - 1, int(low.min(initial=0)) - 1, -1):
        upto = int(np.searchsorted(-high[enter], -column, "left"))
        if upto > entered:  # their suffix so far is empty: the least of their group
            new = np.sort(enter[entered:upto])
            entered = upto
            at = np.searchsorted(group[order], group[new], "left")
            old = np.insert(common, at, 0)
            order = np.insert(order, at, new)
            head = at + np.arange(len(at)) + 1
            head = head[head < len(order)]
            old[head] = 0
            common = old
        gone = low[order] > column
        if gone.any():  # the least common prefix of those that leave passes on to the next that stays
            stay = np.flatnonzero(~gone)
            bounds = np.stack((np.concatenate(([-1], stay[:-1])) + 1, stay + 1), axis=1).ravel()
            common = np.minimum.reduceat(np.append(common, 0), bounds)[::2] if len(stay) else common[:0]
            order = order[stay]
        if not len(order):
            continue
        key = group[order] * 256 + data[first[order] + column - low[order]]
        moved = np.arange(len(order))
        down = np.flatnonzero(key[1:] < key[:-1]) + 1
        if len(down):  # only groups with a symbol out of order are sorted again
            groups = group[order]
            sub = np.flatnonzero(np.isin(groups, groups[down]))
            moved[sub] = sub[np.argsort(key[sub], kind="stable")]
            order, key = order[moved], key[moved]
        grown = np.zeros(len(order), np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        p, q = moved[same - 1], moved[same]
        least = common[q].copy()
        apart = np.flatnonzero(q - p > 1)
        if len(apart):
            bounds = np.stack((p[apart] + 1, q[apart] + 1), axis=1).ravel()
            padded = np.append(common, 0)
            least[apart] = np.minimum.reduceat(padded, bounds)[::2]
        grown[same] = least + 1
        common = grown
        reach = common >= length
        repeated = reach.copy()
        repeated[:-1] |= reach[1:]
        hit = order[repeated]
        segments.append(hit)
        places.append(column - low[hit])
        if listed is not None:
            head = np.flatnonzero(~reach & listed[order] & (high[order] - column >= length))
            heads.append((order[head], column - low[order[head]], repeated[head]))
    none = [np.zeros(0, np.int64)]
    found = np.concatenate(none + segments), np.concatenate(none + places)
    return found if listed is None else (*found, *(np.concatenate(x) for x in zip((none[0], none[0], np.zeros(0, bool)), *heads, strict=True)))


def _segments(length: int):
    """For mapInArrow over (_id, _k, text, runs): each run's bytes."""

    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            listed = rows.column("runs")
            doc = pa.compute.list_parent_indices(listed).to_numpy().astype(np.int64)
            flat = listed.flatten()
            start = offsets[doc] + flat.field("at").to_numpy()
            end = start + flat.field("n").to_numpy() + length - 1
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(c) for c in ("anchor", "part", "parts", "lead", "copies")), *(rows.column(c).take(pa.array(doc)) for c in ("_id", "_k")), flat.field("at"), pa.array([data[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary())],
                ["anchor", "part", "parts", "lead", "copies", "_id", "_k", "at", "bytes"],
            )

    return run


def _groups(t: pa.Table) -> np.ndarray:
    """The number of each row's group; rows of one anchor and part stand together."""
    anchor, part = t.column("anchor").to_numpy(), t.column("part").to_numpy()
    return np.cumsum(np.concatenate(([0], (np.diff(anchor) != 0) | (np.diff(part) != 0))))


def _blocks(batches, block: int):
    """Tables of whole groups, of about block segments, from rows sorted by anchor and part."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= block:
            table = pa.Table.from_batches(held).combine_chunks()
            group = _groups(table)
            cut = int(np.searchsorted(group, group[-1], "left"))
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).to_batches(), size - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeated(length: int, block: int):
    """For mapInArrow over sorted segments: stretches of repeated windows of the segments without copies; of groups of
    several parts also the distinct windows, named by 128 bits, and whether these still are in doubt."""

    def run(batches):
        for t in _blocks(batches, block):
            data, first = u.utf8(t.column("bytes"))
            group, at = _groups(t), t.column("at").to_numpy()
            single = t.column("copies").to_numpy() == 1
            segment, place, head, head_place, settled = insert_columns(group, data, first, t.column("lead").to_numpy().astype(np.int64), length, t.column("parts").to_numpy() > 1)
            segment, place = segment[single[segment]], place[single[segment]]
            order = np.lexsort((place, segment))
            segment, place = segment[order], place[order]
            new = np.ones(len(segment), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (place[1:] != place[:-1] + 1)
            begin = np.flatnonzero(new)
            of = pa.array(segment[begin])
            columns = [t.column(c).combine_chunks() for c in ("_id", "_k")]
            none = pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(of) for c in columns), pa.array(at[segment[begin]] + place[begin]), pa.array(np.diff(np.append(begin, len(segment))).astype(np.int32)), none, none, pa.nulls(len(begin), pa.bool_())],
                ["_id", "_k", "at", "n", *rep.WINDOW, "open"],
            )
            if len(head):
                hashes, start, of = u.BYTE_HASH[data], first[head] + head_place, pa.array(head)
                names = [u.long(u.mix(u.between(u.span_hashes(x, i), start, start + length, i))) for i, x in enumerate((hashes, u.mix(hashes + u.U(1))))]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(of) for c in columns), pa.array(at[head] + head_place), pa.array(np.ones(len(head), np.int32)), *names, pa.array(~settled & single[head])],
                    ["_id", "_k", "at", "n", *rep.WINDOW, "open"],
                )

    return run


def removed_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, **sketch) -> DataFrame:
    """(_id, _k, at, n): stretches of n consecutive repeated windows from byte at on; docs as from keyed()."""
    runs = written(rep.candidate_runs(docs, units, length, gram, **sketch))
    distinct = written(runs.groupBy(*rep.RUN).agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_k", "at", "n", "lead", "anchor")).alias("first")).select(*rep.RUN, F.least("copies", F.lit(2)).cast("int").alias("copies"), "first.*"))
    copied = runs.join(distinct.where("copies > 1").select(*rep.RUN), rep.RUN, "left_semi").select("_id", "_k", "at", "n")
    shared = rep.shared_anchors(distinct).select("anchor", F.ceil(F.col("runs") / block).cast("int").alias("parts"))
    doubtful = distinct.join(shared, "anchor").withColumn("part", F.pmod("key", "parts").cast("int"))
    of_doc = doubtful.groupBy("_id", "_k").agg(F.collect_list(F.struct("anchor", "part", "parts", "lead", "copies", "at", "n")).alias("runs"))
    # all columns of docs: so the exchange of the texts is the same here and where the result is applied, and is reused
    segments = docs.join(of_doc, ["_id", "_k"]).mapInArrow(_segments(length), "anchor long, part int, parts int, lead int, copies int, _id long, _k long, at long, bytes binary")
    placed = segments.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    found = written(placed.mapInArrow(_repeated(length, block), "_id long, _k long, at long, n int, wh long, wh2 long, open boolean"))
    listed = found.where("open is not null")
    across = listed.groupBy(*rep.WINDOW).agg(F.count("*").alias("times")).where("times > 1").drop("times")
    met = listed.where("open").join(across, rep.WINDOW, "left_semi")
    return copied.unionByName(found.where("open is null").unionByName(met).select("_id", "_k", "at", "n"))


def _applied(length: int):
    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            listed = rows.column("spans")
            doc = pa.compute.list_parent_indices(listed).to_numpy().astype(np.int64)
            flat = listed.flatten()
            low = offsets[doc] + flat.field("at").to_numpy()
            high = low + flat.field("n").to_numpy() + length - 1
            n = len(data) + 1
            gone = np.cumsum(np.bincount(low, minlength=n)[:n] - np.bincount(high, minlength=n)[:n])[:-1] > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            cut = offsets[:-1][offsets[:-1] < len(data)]
            begins[cut] = gone[cut]
            lost, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, begins))
            kept = data[~gone].tobytes()
            at = offsets - lost[offsets]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), u.long(np.diff(offsets)), u.long(np.diff(lost[offsets])), u.long(np.diff(spans[offsets])), pa.array([kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept (the bytes that stay)."""
    docs_k = keyed(docs)
    spans = removed_windows(docs_k, length, **options).groupBy("_id", "_k").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    id_type = docs_k.schema["doc_id"].dataType.simpleString()
    return docs_k.join(spans, ["_id", "_k"], "left").select("doc_id", "text", "spans").mapInArrow(_applied(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    return deduplicate(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
