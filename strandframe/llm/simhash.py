"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint has 64 bits; two link at four or fewer differing bits. The bits are cut into a ring of five segments.
If at most four bits differ in all, some segment starts a chain in which the first 1, 2, 3, 4, 5 segments differ
in at most 4/5, 8/5, 12/5, 16/5 and 4 bits: a strictly smaller set of candidates than one equal segment gives. The
first two budgets (no bit, then one bit) become the join key - an equal segment with a neighbour of at most one
flipped bit -, the next two are conditions of the join, and the last is the full Hamming check.

Equal fingerprints are one node, so copies are never expanded into pairs. Links are found in two passes over the ring:
first those of one bit, whose budgets are 0, 0, 0, 0 and 1 bits, so that four equal segments in a row are the key; groups
they connect are labelled, and the pass for four bits then keeps only pairs between different labels, of each pair of
labels one. A link inside a label can't change a component.

`drop_near_copies`, for pipelines, keeps one document of each group of near copies; its measure and its candidates are
those of `_near_copies`, which uses the links of this module first.

Null or empty text: fingerprint zero, linked like any other. A null doc_id is larger than any other; component_id is
null if the component has no other id. Each row gets a row; extra columns are ignored by `components` and kept by
`drop_near_copies`.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._graph import components as connected
from ._shared import NO_ID, emptied, keyed, matched, written

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Widths of the ring's segments, from the lowest bit on.
SEGMENTS = (13, 13, 13, 13, 12)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = text.lower().split()  # bytes: lowers A-Z only, splits at the six ASCII spaces
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)] if words else [], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    return np.fromiter((h(joined[s:e], seed) for s, e in zip([0, *(e + 1 for e in ends)], ends[size - 1 :])), np.uint64, len(words) - size + 1)  # noqa: B905


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit the majority; counts are added eight at a time, as bytes, in blocks that can't overflow."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    blocks = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
    counts = blocks.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for rows, data, offsets in u.chunks(batches):
        text = data.tobytes()
        fp = np.array([fingerprint(shingle_hashes(text[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("_id"), rows.column("_k"), u.long(fp)], ["doc_id", "_id", "_k", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _k and the fingerprint as a (signed) long."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).mapInArrow(_fingerprints, f"doc_id {id_type}, _id long, _k long, fp long")


_STARTS = [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]


def _segment(fp: Column, i: int) -> Column:
    i %= len(SEGMENTS)
    return F.shiftrightunsigned(fp, _STARTS[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1)).cast("long")


def ring_links(labelled: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of labels that hold fingerprints within distance (1 to 4) of each other; labelled: (fp, label), each fp once.

    The segments of a chain whose budgets are zero are the key; if that is one segment only, its neighbour with at most one
    flipped bit belongs to the key too."""
    fp = F.col("fp")
    n = len(SEGMENTS)
    budgets = [length * distance // n for length in range(1, n + 1)]
    equal = budgets.count(0)

    def key(i: int, flip: int | None = None) -> Column:
        parts = [_segment(fp, i + j) for j in range(equal)]
        if flip is not None:
            parts.append(_segment(fp, i + equal).bitwiseXOR(F.lit(flip)))
        out = parts[0]
        for j, part in enumerate(parts[1:], 1):
            out = out.bitwiseOR(F.shiftleft(part, 13 * j))
        return F.struct(F.lit(i).alias("i"), out.alias("key"))

    if equal > 1:
        covered, index = equal, [key(i) for i in range(n)]
        flips = index
    else:
        covered, index = 2, [key(i, 0) for i in range(n)]
        flips = [key(i, bit) for i in range(n) for bit in (0, *(1 << b for b in range(SEGMENTS[(i + 1) % n])))]
    a = labelled.select(fp.alias("fp_a"), F.col("label").alias("a"), F.inline(F.array(*index)))
    b = labelled.select(fp.alias("fp_b"), F.col("label").alias("b"), F.inline(F.array(*flips)))
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))

    def chain(length: int) -> Column:
        """The budget of the chain of so many segments from the i-th on."""
        masks = [sum(1 << bit for j in range(length) for bit in range(_STARTS[(i + j) % n], _STARTS[(i + j) % n] + SEGMENTS[(i + j) % n])) for i in range(n)]
        signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
        return F.bit_count(differ.bitwiseAND(F.element_at(signed, F.col("i") + 1))) <= budgets[length - 1]

    # either of a pair has the other among its flips, so one order of the two is enough
    wanted = (F.col("fp_a") < F.col("fp_b")) & (F.col("a") != F.col("b")) & (F.bit_count(differ) <= distance)
    for length in range(covered + 1, n):
        wanted &= chain(length)
    # a row gives 5 and up to 70; Spark's estimate leaves that out and would broadcast a table a hundred times its threshold
    return a.join(b.hint("merge"), ["i", "key"]).where(wanted).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(seen: DataFrame) -> DataFrame:
    """(fp, component) of the distinct fingerprints of seen (fp, _id): the smallest _id reachable."""
    nodes = written(seen.groupBy("fp").agg(F.min("_id").alias("least")))
    near = connected(nodes.select(F.col("fp").alias("node")), ring_links(nodes.select("fp", F.col("fp").alias("label")), 1))
    labelled = written(nodes.join(near, nodes.fp == near.node).select("fp", "least", F.col("component").alias("label")))
    emptied(nodes)
    label_ids = labelled.groupBy("label").agg(F.min("least").alias("least"))
    wide = connected(label_ids.select(F.col("label").alias("node")), ring_links(labelled))
    joined = label_ids.join(wide, label_ids.label == wide.node).select("label", "least", "component")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    return labelled.select("fp", "label").join(joined.select("label", "component"), "label").join(smallest, "component").select("fp", F.col("smallest").alias("component"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _k, fp and component (the smallest _id reachable)."""
    seen = written(fingerprints(docs))
    return seen.join(linked(seen), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    found = components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group of near copies: that of the smallest doc_id (then of the least
    text hash, and of repeated rows one)."""
    from ._near_copies import near_copy_groups

    return matched(docs, near_copy_groups(docs).select("k.*"), "left_semi")
