"""Count-min sketches that partitions build apart and a shuffle merges."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _units as u

#: Cells of each row. What reaches the driver and the tasks is one bit a cell, so 16 MB a row whatever the input.
WIDTH_BITS, DEPTH = 27, 2
#: So many bits of a bitmap reach the driver at a time.
PART_BITS = 1 << 25


class Sketch(NamedTuple):
    bits: object  # broadcast: for each row, the bits of the cells with a merged count of at least two
    width_bits: int
    depth: int

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimated count is two or more: true for every key counted twice, and for some others."""
        rows = np.frombuffer(self.bits.value, np.uint8).reshape(self.depth, -1)
        out = np.ones(len(keys), bool)
        for row, at in zip(rows, cells(keys, self.width_bits, self.depth), strict=True):
            out &= (row[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def cells(keys: np.ndarray, width_bits: int, depth: int) -> list[np.ndarray]:
    """The cell of each key in each row."""
    return [(u.mix(keys + u.U(i * u.BASES[1] & (1 << 64) - 1)) >> u.U(64 - width_bits)).astype(np.int64) for i in range(depth)]


def partition_cells(keys_of, width_bits: int, depth: int):
    """For mapInArrow: the non-zero cells of the partition's own sketch, those of each flush of about a million keys.

    keys_of yields arrays of 64-bit keys from batches.
    """

    def counted(held):
        keys = np.concatenate(held)
        for i, at in enumerate(cells(keys, width_bits, depth)):
            cell, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell + (i << width_bits)), pa.array(np.minimum(n, 2).astype(np.int8))], ["cell", "n"])

    def run(batches):
        held, size = [], 0
        for keys in keys_of(batches):
            held.append(keys)
            size += len(keys)
            if size > 1 << 20:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    return run


def bitmap(marked: DataFrame, size: int) -> bytearray:
    """A bit for each of size cells, set for those of marked (cell); packed by Spark in blocks of 2**16.

    The driver reads parts of at most 4 MB, one at a time. Each part is a job, so their number follows the bitmap's size and not
    the number of shuffle partitions: hundreds of jobs would fill the driver's memory with what it keeps of each."""
    block_bits = min(16, size.bit_length() - 1)
    placed = marked.select(F.shiftright("cell", block_bits).alias("block"), F.col("cell").bitwiseAND(F.lit((1 << block_bits) - 1)).cast("int").alias("at"))

    def packed(batches):
        held = [(b.column("block").to_numpy(), b.column("at").to_numpy()) for b in batches]
        if held:
            block, at = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(block, kind="stable")
            names, first = np.unique(block[order], return_index=True)
            for name, at in zip(names, np.split(at[order], first[1:]), strict=True):
                bits = np.zeros(1 << block_bits, np.uint8)
                bits[at] = 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["block", "bits"])

    out, step = bytearray(size // 8), (1 << block_bits) // 8
    for r in placed.repartition("block").mapInArrow(packed, "block long, bits binary").repartition(-(-size // PART_BITS)).toLocalIterator():
        out[r.block * step : (r.block + 1) * step] = r.bits
    return out


def sketch(docs: DataFrame, keys_of, width_bits: int = WIDTH_BITS, depth: int = DEPTH) -> Sketch:
    """Merges the partitions' sketches; only whether a cell holds two or more is kept."""
    parts = docs.mapInArrow(partition_cells(keys_of, width_bits, depth), "cell long, n byte")
    full = parts.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    return Sketch(docs.sparkSession.sparkContext.broadcast(bitmap(full, depth << width_bits)), width_bits, depth)
