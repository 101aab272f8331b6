"""Vectorised hashing over the units (words or bytes) of many documents at once.

A chunk is a flat array of bytes with the offsets of its documents. Hashes are polynomials modulo 2**64 of
mixed unit hashes; where two texts must be told apart, two independent ones (128 bits) are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
CHUNK = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random-looking 64-bit value for every byte value.
BYTE_HASH = mix(np.arange(1, 257, dtype=U) * U(BASES[0]))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = BASES[which]
        have = tuple(np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, b, U)))) for b in (base, pow(base, -1, 1 << 64)))
        _powers[which] = have
    return have[0][:n], have[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, text_col: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of the batches: whole documents, about limit bytes or one document each."""
    for batch in batches:
        data, offsets = utf8(batch.column(text_col))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


class Words(NamedTuple):
    start: np.ndarray  # byte at which each word starts
    end: np.ndarray
    first: np.ndarray  # word at which each document starts, and the end
    hash: np.ndarray


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first word of each document; inside: for each byte value, whether it belongs to words."""
    member = inside[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = member
    after = before.copy()
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(member & ~before[:-1])
    follows = np.zeros(len(data), bool)
    follows[:-1] = after[2:]
    follows[cut[cut > 0] - 1] = False
    end = np.flatnonzero(member & ~follows) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix hashes of a sequence of 64-bit values, of length n + 1."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), which)[0], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of each span, the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), which)[1][start]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    start, end, first = word_spans(data, offsets, inside)
    prefix = span_hashes(data.astype(U) + U(1))
    return Words(start, end, first, mix(between(prefix, start, end) ^ ((end - start).astype(U) << U(40))))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k units from each place on (places without k units after them are left out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    prefix, at = span_hashes(hashes), np.arange(n)
    return mix(between(prefix, at, at + k))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive keys."""
    least, have = keys, 1
    while have < width:
        step = min(have, width - have)
        if len(least) <= step:
            return keys[:0]
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Every place at which a window of width units fits into its document."""
    lengths = np.diff(first) - width + 1
    lengths = np.maximum(lengths, 0)
    total = int(lengths.sum())
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def anchors(hashes: np.ndarray, starts: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the place of its least k-gram (the leftmost of equal ones), and all k-gram hashes.

    Equal windows have the same least gram at the same relative place, whatever surrounds them.
    """
    gram = grams(hashes, k)
    if not len(starts):
        return np.zeros(0, np.int64), gram
    keys = (gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U)
    return (sliding_least(keys, width - k + 1)[starts] & U(0xFFFFFFFF)).astype(np.int64), gram


class Runs(NamedTuple):
    """Consecutive windows of one document that share an anchor."""

    anchor: np.ndarray  # hash of the anchor gram
    place: np.ndarray  # its place
    start: np.ndarray  # place of the first window
    count: np.ndarray  # windows
    key: np.ndarray  # 64 bits of the content from the first window to the last, with the anchor's relative place
    key2: np.ndarray  # 64 more


def runs(hashes: np.ndarray, first: np.ndarray, width: int, k: int) -> Runs:
    starts = window_starts(first, width)
    place, gram = anchors(hashes, starts, width, k)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Runs(none.astype(U), none, none, none, none.astype(U), none.astype(U))
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    begin, place = starts[at], place[at]
    end = begin + count - 1 + width
    shape = ((place - begin).astype(U) << U(32)) | count.astype(U)
    key = mix(between(span_hashes(hashes), begin, end) + shape)
    key2 = mix(between(span_hashes(mix(hashes + U(1)), 1), begin, end, 1) ^ shape)
    return Runs(gram[place], place, begin, count, key, key2)


def long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64, copy=False))
