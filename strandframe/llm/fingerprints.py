"""Document fingerprints from prefix polynomial hashes.

For a text of code points c_j, S_i = sum of c_j * B**j over j < i, modulo the prime 2**31 - 1, for two bases B. The hash
of any span is (S_end - S_start) * B**-start, so two prefix arrays tell whether any two spans are equal, and a binary
search over lengths gives the longest common extension of any two places (62 bits; the chance of a wrong answer for one
comparison is about text length / 2**62).

The fingerprint has the length, the hash of the whole text and a sketch: of the span hashes of all GRAM code points,
winnowed to the least of each WINNOW consecutive ones, the least in each of BINS bins. Likeness is the share of text
in common that the sketches tell (Dice: twice the shared over the sum), 1 for equal texts.

`edited_pairs` orders documents by a range partitioning, so only each partition's first and last document meet a
neighbour across partitions; the document texts are shuffled once.

Null text counts as empty. Documents come in ascending doc_id, null first, rows of one doc_id by text; repeated rows
are documents of their own. The next of the last document is the first (of a single one, itself). Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import extended, written

P = (1 << 31) - 1
BASES = (1_103_515_245, 69_621 * 25_111)
GRAM, WINNOW, BINS, BIN_BITS, EMPTY = 16, 8, 64, 6, 65535
CHUNK = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    m = u.U(P)
    x = (x & m) + (x >> u.U(31))
    x = (x & m) + (x >> u.U(31))
    return np.where(x >= m, x - m, x)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        out = []
        for base in (BASES[which] % P, pow(BASES[which], -1, P)):
            p, step = np.ones(1, u.U), base
            while len(p) < max(n, 1 << 16):
                p = np.concatenate((p, mod(p * u.U(step))))
                step = step * step % P
            out.append(p)
        have = _powers[which] = tuple(out)
    return have[0][:n], have[1][:n]


class Prefixes:
    """Prefix hashes of an array of code points."""

    def __init__(self, codes: np.ndarray):
        self.sums = []
        for which in range(2):
            terms = mod((codes.astype(u.U) + u.U(1)) * powers(len(codes), which)[0])
            self.sums.append(mod(np.concatenate((np.zeros(1, u.U), np.cumsum(terms)))))

    def span(self, start, end, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        return mod(mod(s[end] + u.U(P) - s[start]) * powers(len(s), which)[1][start])

    def equal(self, a, other: Prefixes, b, size) -> np.ndarray:
        """Whether size code points from a on are those of other from b on."""
        return (self.span(a, a + size) == other.span(b, b + size)) & (self.span(a, a + size, 1) == other.span(b, b + size, 1))

    def extension(self, a: np.ndarray, other: Prefixes, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """The longest common extension from each a and b on (of at most so many code points), by binary search."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(len(self.sums[0]) - 1 - a, len(other.sums[0]) - 1 - b)
        if most is not None:
            high = np.minimum(high, most)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, other, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prints(NamedTuple):
    size: np.ndarray
    whole: np.ndarray  # two columns
    bins: np.ndarray  # BINS columns
    first: np.ndarray  # where each text starts in the prefixes of all
    prefix: Prefixes

    def text(self, i: int) -> str:
        return f"{self.size[i]:x}-{int(self.whole[i, 0]):08x}{int(self.whole[i, 1]):08x}-{self.bins[i].astype('>u2').tobytes().hex()}"


def fingerprint(texts: list[str]) -> Prints:
    """The fingerprints of some texts, their code points in one array."""
    size = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    prefix = Prefixes(code_points("".join(texts)))
    whole = np.stack([prefix.span(first[:-1], first[1:], w) for w in range(2)], axis=1)
    starts = u.window_starts(first, GRAM)
    gram = u.mix(prefix.span(starts, starts + GRAM) + u.U(1))
    doc = np.searchsorted(first, starts, "right") - 1
    of_grams = np.searchsorted(doc, np.arange(len(texts) + 1))
    windows = u.window_starts(of_grams, WINNOW)
    least, owner = u.sliding_least(gram, WINNOW)[windows] if len(windows) else gram[:0], doc[windows]
    few = np.diff(of_grams) < WINNOW
    few_at = np.flatnonzero(few[doc]) if len(doc) else np.zeros(0, np.int64)
    tiny = np.flatnonzero((size > 0) & (size < GRAM))
    if len(least):
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        least, owner = least[new], owner[new]
    value = np.concatenate((least, gram[few_at], u.mix(whole[tiny, 0] + u.U(7))))
    owner = np.concatenate((owner, doc[few_at], tiny))
    bins = np.full(len(texts) * BINS, EMPTY, np.uint16)
    dealt = u.mix(value)  # winnowing leaves low values, whose leading bits would leave high bins empty
    np.minimum.at(bins, owner * BINS + (dealt >> u.U(64 - BIN_BITS)).astype(np.int64), np.minimum(dealt >> u.U(40) & u.U(0xFFFF), u.U(EMPTY - 1)).astype(np.uint16))
    return Prints(size, whole, bins.reshape(-1, BINS), first[:-1], prefix)


def likeness(a: Prints, i, b: Prints, j) -> np.ndarray:
    x, y = a.bins[i], b.bins[j]
    either = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    shared = ((x == y) & (x != EMPTY)).sum(axis=1) / np.maximum(either, 1)
    same = (a.size[i] == b.size[j]) & (a.whole[i] == b.whole[j]).all(axis=1)
    return np.where(same, 1.0, 2 * shared / (1 + shared))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many code points of the next text (or all it has)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _compared(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns _COLUMNS of texts and the texts that follow them."""
    out: list[list] = [[] for _ in _NAMES]
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low]) + len(following[low])
        while high < len(texts) and size < CHUNK:
            size += len(texts[high]) + len(following[high])
            high += 1
        now, then = texts[low:high], following[low:high]
        new = [edited(t, n) for t, n in zip(now, then, strict=True)]
        a, b, n = fingerprint(now), fingerprint(new), np.arange(len(now))
        chained = all(x is y for x, y in zip(now[1:], then, strict=False))
        c = fingerprint(then[-1:] if chained else then)
        near = likeness(a, n, b, n)
        common = a.prefix.extension(a.first, b.prefix, b.first, np.minimum(a.size, b.size))
        if chained:  # the next text is mostly the next row
            following_near = np.concatenate((likeness(a, n[:-1], a, n[1:]), likeness(a, n[-1:], c, n[:1])))
        else:
            following_near = likeness(a, n, c, n)
        for column, values in zip(out, (a.size.tolist(), [hashlib.sha256(t.encode()).hexdigest() for t in new], map(a.text, n), map(b.text, n), near.tolist(), following_near.tolist(), common.tolist()), strict=True):
            column += values
        low = high
    return [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)]


def _in_order(batches):
    """Rows of one partition, in order: all but the last compared with the next; the last's and first's texts (edge 1, 0)."""
    part = TaskContext.get().partitionId()
    first = last = None

    def row(edge, ids, texts):
        return pa.RecordBatch.from_arrays([pa.array([edge], pa.int32()), pa.array([part], pa.int32()), ids, pa.array([texts], pa.string()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names)

    names = ["edge", "part", "doc_id", "text", *_NAMES]
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text").to_pylist()
        if not texts:
            continue
        if first is None:
            first = (ids.slice(0, 1), texts[0])
        if last is not None:
            ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
        n = len(texts) - 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), ids.slice(0, n), pa.nulls(n, pa.string()), *_compared(texts[:-1], texts[1:])], names)
        last = (ids.slice(n, 1), texts[n])
    if last is not None:
        yield row(0, *first)
        yield row(1, *last)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_start (code points up to the first that
    differs in the edited text)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    seen = written(ordered.mapInArrow(_in_order, f"edge int, part int, doc_id {id_type}, text string, {_COLUMNS}"))
    inner = seen.where("edge is null").select("doc_id", *_NAMES)
    parts = sorted(r.part for r in seen.where("edge = 1").select("part").collect())  # a number a partition
    if not parts:
        return inner
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, next int")
    heads = seen.where("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    tails = seen.where("edge = 1").select("part", "doc_id", "text").join(following, "part").join(heads, "next").select("doc_id", "text", "next_text")

    def compare(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_compared(b.column("text").to_pylist(), b.column("next_text").to_pylist())], ["doc_id", *_NAMES])

    return inner.unionByName(tails.mapInArrow(compare, f"doc_id {id_type}, {_COLUMNS}"))


def longest_common_extensions(pairs: DataFrame, a: str = "text_a", at_a: str = "at_a", b: str = "text_b", at_b: str = "at_b", out: str = "lce") -> DataFrame:
    """pairs with the number of code points from at_a and at_b on that agree; null where an input is null or out of range."""

    def run(batches):
        for batch in batches:
            found = []
            for x, i, y, j in zip(*(batch.column(c).to_pylist() for c in (a, at_a, b, at_b)), strict=True):
                ok = None not in (x, i, y, j) and 0 <= i <= len(x) and 0 <= j <= len(y)
                found.append(int(Prefixes(code_points(x)).extension(np.array([i]), Prefixes(code_points(y)), np.array([j]))[0]) if ok else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, out])

    return pairs.mapInArrow(run, extended(pairs, {out: "bigint"}))
