"""Groups of near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the same shingles come first: each document is compared with one of those that pigeonring links
reach from it. These are candidates; every pair is settled by its whole sets. Pairs of that similarity differ by ten fingerprint bits or so, more than a Hamming budget can search, so
what they leave apart is found by an exact prefix filter: shingles are put in one order, and two such sets share one of
the first fifth of either. Shingles that stand in one set only come first in that order. They meet nothing, so a document
with a fifth of its own words, whatever passages it shares with others, has no candidates. All shingles are counted; a
bitmap of fixed size tells the repeated ones, and one that it takes for repeated by mistake only comes later.

Before whole sets move, candidates go that can't reach 0.8 by their sizes, by the places of the shingle they share, or by
parities: each set has a bit for each of at least twice as many cells as it has shingles, the parity of its shingles
there, and two sets differ in at least as many shingles as these bits.

Equal sets are one node. Nodes that share a shingle are first compared with the one of them that has the fewest shingles
of its own, as copies with edits are closer to what they were made from than to each other; then, in shingles whose nodes
aren't connected yet, all but those of the largest component with all whose parities allow it. Every group is aggregated or joined, none is
listed in a task, and tables that aren't read again are emptied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _sketch
from . import _units as u
from ._graph import components as connected
from ._graph import merged
from ._shared import emptied, keyed, written
from .decontam import BITS, _bitmap
from .simhash import SEED, fingerprint, linked, shingle_hashes

#: Words of a shingle, and the least similarity in fifths.
SHINGLE, FIFTHS = 5, 4
#: Shingles are counted by so many bits of their hashes; the bitmap of the repeated ones has 2**CELLS bits (32 MB).
COUNTED, CELLS = 40, 28
#: Parities over so many words of 64 cells are a condition of the join of what stars leave apart.
FOLD = 8


def _set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def parities(h: np.ndarray) -> bytes:
    """The parity of the shingles in each cell; as many cells as the power of two from twice their number on."""
    cells = 64
    while cells < 2 * len(h):
        cells *= 2
    return np.packbits(np.bincount((h & u.U(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def folded(h: np.ndarray) -> np.ndarray:
    """The parities of FOLD * 64 cells, whatever the size."""
    cells = FOLD * 64
    return np.packbits(np.bincount((h & u.U(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").view("<u8")


def differing(x: bytes, y: bytes) -> int:
    """The parity bits that differ, the longer one folded to the cells of the shorter."""
    if len(x) < len(y):
        x, y = y, x
    a, size = int.from_bytes(x, "little"), len(x)
    while size > len(y):
        size //= 2
        a = (a >> 8 * size) ^ (a & (1 << 8 * size) - 1)
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _described(batches):
    """Each document's set: its hash (the node), size, fingerprint and parities."""
    for rows, data, offsets in u.chunks(batches):
        text, found = data.tobytes(), []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            h = _set(text[a:b])
            found.append((_node(h), len(h), fingerprint(h), parities(h), folded(h)))
        node, n, fp, parity, fold = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays(
            [rows.column("_id"), rows.column("_k"), u.long(np.array(node, np.uint64)), pa.array(n, pa.int32()), u.long(np.array(fp, np.uint64)), pa.array(parity, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, FOLD * len(fold) + 1, FOLD), pa.int32()), u.long(np.concatenate(fold)))],
            ["_id", "_k", "node", "n", "fp", "parity", "fold"],
        )


def _node(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def _chosen(batches, bitmap):
    """(row, its document's set) of the documents whose bit is set; no other text is cut into shingles."""
    bits = np.frombuffer(bitmap.value, np.uint8)
    for rows, data, offsets in u.chunks(batches):
        text, cell = data.tobytes(), rows.column("_k").to_numpy().view(np.uint64) >> u.U(64 - BITS)
        for i in np.flatnonzero(bits[cell >> u.U(3)] >> (cell & u.U(7)).astype(np.uint8) & 1):
            yield rows.slice(i, 1), _set(text[offsets[i] : offsets[i + 1]])


def _counted(bitmap):
    def run(batches):
        held, size = [], 0
        for _, h in _chosen(batches, bitmap):
            held.append(h)
            size += len(h)
            if size > 1 << 20:
                yield keys(held)
                held, size = [], 0
        if held:
            yield keys(held)

    def keys(held):  # sorted, so that they pack well
        h, n = np.unique(np.concatenate(held) >> u.U(64 - COUNTED), return_counts=True)
        return pa.RecordBatch.from_arrays([u.long(h), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    return run


def _postings(bitmap, repeated):
    """Of each set's first fifth, the shingles that may stand in other sets; own: the percentage that stand in no other."""

    def run(batches):
        bits, held = np.frombuffer(repeated.value, np.uint8), []
        for _, h in _chosen(batches, bitmap):
            n = len(h)
            if n > 3:  # smaller sets have no partner but their equals
                cell = h >> u.U(64 - CELLS)
                again = (bits[cell >> u.U(3)] >> (cell & u.U(7)).astype(np.uint8) & 1).astype(bool)
                own = n - int(again.sum())
                place = np.arange(own, n - -(-FIFTHS * n // 5) + 1)
                if len(place):
                    held.append((h[again][place - own], np.full(len(place), _node(h), np.uint64), np.full(len(place), n), place, np.full(len(place), 100 * own // n)))
            if len(held) > 1000:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    def rows(held):
        h, node, n, at, own = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([u.long(h), u.long(node), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(own.astype(np.int8))], ["h", "node", "n", "at", "own"])

    return run


def _plausible(batches):
    """Candidates (a, b, x, y: parities, total: shingles of both) whose parities allow a similarity of FIFTHS."""
    for b in batches:
        x, y, total = (b.column(c).to_pylist() for c in ("x", "y", "total"))
        keep = [i for i, t in enumerate(total) if (5 + FIFTHS) * differing(x[i], y[i]) <= (5 - FIFTHS) * t]
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])


def _sets(bitmap):
    def run(batches):
        for row, h in _chosen(batches, bitmap):
            yield pa.RecordBatch.from_arrays([row.column("_id"), row.column("_k"), pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), u.long(h))], ["_id", "_k", "shingles"])

    return run


def _bits(keys: DataFrame):
    """Marks the documents of these _k in a bitmap of fixed size."""
    return keys.sparkSession.sparkContext.broadcast(_bitmap(keys.select(F.col("_k").alias("fp"))))


def similar(rows: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the candidates (a, b) with a Jaccard similarity of FIFTHS or more, by their whole sets; written."""
    side = nodes.select("node", "n", "parity")
    both = pairs.distinct().join(side.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x")), "a").join(side.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y")), "b")
    sized = both.where((5 * F.col("n_a") >= FIFTHS * F.col("n_b")) & (5 * F.col("n_b") >= FIFTHS * F.col("n_a")))
    left = written(sized.select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(_plausible, "a long, b long"))
    if not left.count():
        return left
    needed = written(nodes.join(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "k.*"))
    bitmap = _bits(needed)
    sets = rows.mapInArrow(_sets(bitmap), "_id long, _k long, shingles array<long>").join(needed, ["_id", "_k"]).dropDuplicates(["node"]).select("node", "shingles")
    pair = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    out = written(pair.where(5 * same >= FIFTHS * (F.size("x") + F.size("y") - same)).select("a", "b"))
    emptied(left, needed)
    bitmap.destroy()
    return out


def _may(x: str, y: str) -> Column:
    """Whether two postings' sets can be similar if the shingle is the first that they share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    return (5 * n >= FIFTHS * m) & (5 * m >= FIFTHS * n) & ((5 + FIFTHS) * left >= FIFTHS * (n + m))


def _pairs(joined: DataFrame) -> DataFrame:
    """(a, b) of rows with structs x and y of different components."""
    return joined.where((F.col("x.component") != F.col("y.component")) & _may("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _connected(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after these links; written. The tables read go, and without links there is nothing to do."""
    if not links.count():
        return component
    out = written(merged(component, links))
    emptied(component, links)
    return out


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(component, k): the groups of near copies, and the (_id, _k) of the smallest document of each."""
    rows = keyed(docs).select("_id", "_k", "text")
    seen = rows.mapInArrow(_described, "_id long, _k long, node long, n int, fp long, parity binary, fold array<long>")
    nodes = written(seen.groupBy("node").agg(F.min(F.struct("_id", "_k")).alias("k"), *(F.first(c).alias(c) for c in ("n", "fp", "parity", "fold"))))
    near = nodes.select("fp", "node").join(linked(nodes.select("fp", F.col("node").alias("_id"))), "fp")
    links = similar(rows, nodes, near.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    component = written(connected(nodes.select("node"), links))
    emptied(links)
    firsts = _bits(nodes.select("k._k"))  # one document of each set, and few others
    counts = rows.mapInArrow(_counted(firsts), "h long, n byte").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = docs.sparkSession.sparkContext.broadcast(_sketch.bitmap(counts.where("n > 1").select(F.shiftright("h", COUNTED - CELLS).alias("cell")), 1 << CELLS))
    posts = written(rows.mapInArrow(_postings(firsts, repeated), "h long, node long, n int, at int, own byte").dropDuplicates(["h", "node"]))
    for read in (firsts, repeated):  # the driver keeps them otherwise
        read.destroy()

    def labelled() -> DataFrame:
        return posts.join(component, "node").select("h", F.struct("node", "n", "at", "own", "component").alias("x"))

    several = F.min("x.component") < F.max("x.component")
    centre = labelled().groupBy("h").agg(F.min_by("x", F.struct("x.own", F.xxhash64("x.node"))).alias("y"), several.alias("several")).where("several").drop("several")
    component = _connected(component, similar(rows, nodes, _pairs(labelled().join(centre, "h"))))
    sizes = labelled().groupBy("h", F.col("x.component").alias("component")).agg(F.count("*").alias("c")).groupBy("h").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("most"))
    split = labelled().join(sizes.where("parts > 1"), "h").join(nodes.select(F.col("node").alias("_node"), "fold"), F.col("x.node") == F.col("_node")).drop("_node")
    rest = split.where("x.component <> most").select("h", "x", F.col("fold").alias("fold_x")).join(split.select("h", F.col("x").alias("y"), F.col("fold").alias("fold_y")), "h")
    differ = sum((F.bit_count(F.col("fold_x")[i].bitwiseXOR(F.col("fold_y")[i])) for i in range(FOLD)), F.lit(0))
    close = (5 + FIFTHS) * differ <= (5 - FIFTHS) * (F.col("x.n") + F.col("y.n"))
    component = _connected(component, similar(rows, nodes, _pairs(rest.where(close))))
    emptied(posts)
    return nodes.select("node", "k").join(component, "node").groupBy("component").agg(F.min("k").alias("k"))
