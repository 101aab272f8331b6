"""SentencePiece encoding and decoding (BPE) with vectorised merge rounds.

A text is cut where no piece can reach across (before spaces, around characters that stand in no longer piece). Each
distinct chunk is encoded once: symbols of all chunks lie in one flat numpy array; a round looks up the rank of every
neighbouring pair, takes the least rank of each chunk by a segmented minimum, merges that rank's occurrences from the
left at once, compacts the array, and repeats until no pair remains. The library's queue takes them one by one, so a
round stops in a chunk behind the first merge that makes a pair of the same or a lesser rank: that pair is next. Words
of any length go this way; a round of a chunk costs its length, and there are about as many as the chunk has ranks.

Decoding gathers each id's bytes from one table; bytes that aren't UTF-8 become U+FFFD one by one.

Null or empty text: no ids, decoded to the empty string. Each row gets a row; other columns stay. The model file is
given by path and read on the driver (its size is checked); control, unused and user-defined pieces, and normalisers
other than identity with a dummy prefix, are refused rather than handled wrongly.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import extended

VOCABULARY, CHUNK, MODEL_MB = 300_000, 1 << 21, 64
SPACE = "▁"
NEVER = np.int32(2**31 - 1)


class Pairs:
    """Rank and product of a pair of symbols, by a table of slots with a bounded number of probes."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], symbols: int):
        self.symbols = symbols
        self.bits = max(8, (8 * len(pairs)).bit_length())
        keys = np.array([a * symbols + b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        size = 1 << self.bits
        self.key = np.full(size + 64, -1, np.int64)
        self.rank = np.full(size + 64, NEVER, np.int32)
        self.product = np.zeros(size + 64, np.int32)
        self.probes = 1
        for k, s, (rank, product) in zip(keys, self.slot(keys), values, strict=True):
            n = 0
            while self.key[s + n] != -1:
                n += 1
            self.probes = max(self.probes, n + 1)
            self.key[s + n], self.rank[s + n], self.product[s + n] = k, rank, product

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * u.U(u.BASES[0]) >> u.U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rank (NEVER if there is no such pair) and product."""
        keys = a.astype(np.int64) * self.symbols + b
        slots = self.slot(keys)
        at = slots.copy()
        left = np.flatnonzero(self.key[slots] != keys)
        for n in range(1, self.probes):
            if not len(left):
                break
            s = slots[left] + n
            at[left] = s
            left = left[(self.key[s] != keys[left]) & (self.key[s] != -1)]
        good = self.key[at] == keys
        return np.where(good, self.rank[at], NEVER), self.product[at]


class Model:
    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        norm, kinds = m.normalizer_spec, pb.ModelProto.SentencePiece
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.denormalizer_spec.precompiled_charsmap or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
            raise ValueError("a BPE model with identity normaliser and dummy prefix is needed")
        self.size = len(m.pieces)
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        bytes_at = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.byte_ids = np.array([bytes_at[i] for i in range(256)], np.int32) if len(bytes_at) == 256 else None
        score = {p.piece: (p.score, i) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
        longer = [p for p in score if len(p) > 1]
        self.symbol = {p: i for p, (_, i) in score.items()}
        for p in longer:  # characters that are no pieces themselves
            for c in p:
                self.symbol.setdefault(c, len(self.symbol) + self.size)
        self.other = len(self.symbol) + self.size + 1  # symbols of other characters count on from here
        scores = sorted({score[p][0] for p in longer}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        pairs = {}
        for p in longer:
            score_of, i = score[p]
            for k in range(1, len(p)):
                if p[:k] in self.symbol and p[k:] in self.symbol:
                    pairs[self.symbol[p[:k]], self.symbol[p[k:]]] = rank[score_of], i
        self.pairs = Pairs(pairs, 1 << 22)
        inner = {c for p in longer for c in p}
        edge = {c for p in longer for a, c in zip(p, p[1:], strict=False) if a != SPACE and c == SPACE}
        if edge:
            raise ValueError("pieces reach across the start of a word")
        walls = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in inner and chr(i) != SPACE)
        self.cut = re.compile(f"[{walls}]|{SPACE}+[^{SPACE}{walls}]*|[^{SPACE}{walls}]+")
        raw = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else m.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.text_table = Table(raw)
        self.number_table = Table([b"%d," % i for i in range(self.size)])
        self.is_byte = np.array([p.type == kinds.BYTE for p in m.pieces])
        self.is_control = np.array([p.type == kinds.CONTROL for p in m.pieces])
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in m.pieces])

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _symbols(self, chunk: str) -> list[int]:
        get, other = self.symbol.get, self.other
        return [s if (s := get(c)) is not None else other + ord(c) for c in chunk]

    def _ids(self, symbols: list[int]) -> np.ndarray:
        """Ids of final symbols: what is no piece becomes bytes."""
        names = None
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
                continue
            names = names or {i: c for c, i in self.symbol.items()}
            c = chr(s - self.other) if s >= self.other else names[s]
            out += [self.unknown] if self.byte_ids is None else self.byte_ids[list(c.encode())].tolist()
        return np.array(out, np.int32)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, flat, and where each chunk's ids start (and the end)."""
        lengths = np.array([len(c) for c in chunks])
        sym = np.array([s for c in chunks for s in self._symbols(c)], np.int64)
        owner = np.repeat(np.arange(len(chunks)), lengths)
        done_sym, done_owner = [], []
        rank, product = self._pairs_at(sym, owner, np.arange(len(sym)))
        while len(sym):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(sym)))
            live = np.repeat(least != NEVER, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                sym, owner, rank, product = sym[live], owner[live], rank[live], product[live]
                size, least = size[least != NEVER], least[least != NEVER]
                start = np.cumsum(size) - size
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            of = owner[hit]
            new_run = (np.diff(of, prepend=-1) != 0) | (np.diff(hit, prepend=-2) != 1)
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_at) & 1 == 0]  # of overlapping occurrences every other
            overtaken = self._overtaken(sym, owner, rank, product, hit)
            if overtaken.any():  # behind the first of a chunk that is overtaken, none
                before = np.cumsum(overtaken) - overtaken
                head = np.flatnonzero(np.diff(owner[hit], prepend=-1))
                hit = hit[before == np.repeat(before[head], np.diff(np.append(head, len(hit))))]
            sym[hit] = product[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, rank, product = sym[keep], owner[keep], rank[keep], product[keep]
            changed = moved[hit]
            changed = np.unique(np.concatenate((changed, changed[changed > 0] - 1)))
            rank[changed], product[changed] = self._pairs_at(sym, owner, changed)
        sym, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_owner))
        order = np.argsort(owner, kind="stable")
        sym, owner = sym[order], owner[order]
        if (odd := sym >= self.size).any():
            parts = [self._ids([s]) for s in sym[odd]]
            counts = np.ones(len(sym), np.int64)
            counts[odd] = [len(p) for p in parts]
            wide = np.repeat(sym, counts)
            wide[np.repeat(odd, counts)] = np.concatenate(parts)
            sym, owner = wide, np.repeat(owner, counts)
        return sym.astype(np.int32), np.searchsorted(owner, np.arange(len(chunks) + 1))

    def _pairs_at(self, sym, owner, at) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of the pair that starts at each place; NEVER across chunks."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, product = self.pairs.find(np.minimum(sym[at], (1 << 22) - 1), np.minimum(sym[nxt], (1 << 22) - 1))
        rank[(owner[nxt] != owner[at]) | (nxt == at)] = NEVER
        return rank, product.astype(np.int64)

    def _overtaken(self, sym, owner, rank, product, hit) -> np.ndarray:
        """Whether merging each hit, those to its left being merged, makes a pair of its rank or a lesser one."""
        made, last = product[hit], len(sym) - 1
        left, right = np.maximum(hit - 1, 0), np.minimum(hit + 2, last)
        joined = np.zeros(len(hit), bool)
        joined[1:] = (hit[1:] == hit[:-1] + 2) & (owner[hit[1:]] == owner[hit[:-1]])
        before = sym[left]
        before[joined] = made[np.flatnonzero(joined) - 1]
        out = np.zeros(len(hit), bool)
        for a, b, other, inside in ((before, made, left, hit > 0), (made, sym[right], right, hit + 2 <= last)):
            found, _ = self.pairs.find(np.minimum(a, (1 << 22) - 1), np.minimum(b, (1 << 22) - 1))
            out |= inside & (owner[other] == owner[hit]) & (found <= rank[hit])
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The UTF-8 of each sequence; one leading space, of the dummy prefix, goes."""
        data, ends = self.text_table.joined(ids)
        ends = np.concatenate(([0], ends))
        data = data.tobytes()
        shown = np.concatenate(([0], np.cumsum(~self.is_control[ids])))
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            i = int(np.searchsorted(shown, shown[a], "right")) - 1 if a < b else b  # the first that isn't control
            strip = i < b and bool(self.spaced[ids[i]])
            text = data[ends[a] + strip : ends[b]]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._repaired(ids[a:b], strip)
            out.append(text)
        return out

    def _repaired(self, ids: np.ndarray, strip: bool) -> bytes:
        """Byte pieces that don't make up UTF-8: U+FFFD for each byte at which no character starts."""
        out, held = [], b""

        def flush(run: bytes) -> bytes:
            done = b""
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        run[:n].decode()
                    except UnicodeDecodeError:
                        continue
                    done, run = done + run[:n], run[n:]
                    break
                else:
                    done, run = done + "�".encode(), run[1:]
            return done

        for i in ids:
            raw = self.text_table.one(i)
            if self.is_byte[i]:
                held += raw
            elif raw or not self.is_control[i]:
                out += [flush(held), raw]
                held = b""
        return b"".join([*out, flush(held)])[int(strip) :]


class Table:
    """A byte string for each id, and their concatenation for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def one(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and the end of each id's."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)], ends


class Encoder:
    """Encodes texts, remembering the ids of up to VOCABULARY distinct chunks."""

    def __init__(self, model: Model, limit: int = VOCABULARY):
        self.model, self.limit = model, limit
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, and where each text's ids start (and the end)."""
        if len(self.known) > self.limit:
            self._forget()
        known, cut, counts, at = self.known, self.model.chunks, [], []
        add = at.append
        before = len(known)
        for t in texts:
            n = len(at)
            for c in cut(t):
                i = known.get(c)
                if i is None:
                    i = known[c] = len(known)
                add(i)
            counts.append(len(at) - n)
        if len(known) > before:
            flat, first = self.model.encode_chunks(list(known)[before:])
            self.first = np.concatenate((self.first, first[1:] + self.first[-1]))
            self.ids = np.concatenate((self.ids, flat))
        at = np.array(at, np.int64)
        size = self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))
        return ids, bounds[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]


@cache
def _model(proto: bytes) -> Model:
    return Model(proto)


def _proto(spark, path: str):
    if Path(path).stat().st_size > MODEL_MB << 20:
        raise ValueError(f"a model file of over {MODEL_MB} MB")
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _pieces_of(batches, text_col, proto):
    model = _model(proto.value)
    encoder = Encoder(model)
    for rows, _, _ in u.chunks(batches, text_col, CHUNK):
        yield rows, model, *encoder([t or "" for t in rows.column(text_col).to_pylist()])


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of text_col, array<int>."""
    proto = _proto(docs.sparkSession, model_path)
    docs = docs.drop(ids_col)

    def run(batches):
        for rows, _, ids, first in _pieces_of(batches, text_col, proto):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], [*rows.schema.names, ids_col])

    return docs.mapInArrow(run, extended(docs, {ids_col: "array<int>"}))


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with the ids of text_col and the text that decoding these gives, in one pass over the texts."""
    proto = _proto(docs.sparkSession, model_path)
    docs = docs.drop(ids_col, decoded_col)

    def run(batches):
        for rows, model, ids, first in _pieces_of(batches, text_col, proto):
            texts = pa.array([t.decode() for t in model.decode(ids, first)], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), texts], [*rows.schema.names, ids_col, decoded_col])

    return docs.mapInArrow(run, extended(docs, {ids_col: "array<int>", decoded_col: "string"}))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of ids_col (null: the empty text); an id outside the model raises an error."""
    proto = _proto(docs.sparkSession, model_path)
    docs = docs.drop(text_col)

    def run(batches):
        model = _model(proto.value)
        for b in batches:
            listed = b.column(ids_col)
            ids = listed.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            first = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(listed), 0).to_numpy())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.decode() for t in model.decode(ids, first)], pa.string())], [*b.schema.names, text_col])

    return docs.mapInArrow(run, extended(docs, {text_col: "string"}))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """A row a document: encoded, its ids listed, decoded again from its ids."""
    proto = _proto(docs.sparkSession, model_path)
    docs = docs.select("doc_id", "text")

    def run(batches):
        for rows, model, ids, first in _pieces_of(batches, "text", proto):
            numbers, ends = model.number_table.joined(ids)
            numbers, ends = numbers.tobytes(), np.concatenate(([0], ends))[first]
            listed = [numbers[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), u.long(np.diff(first)), pa.array(listed, pa.binary()), pa.array(model.decode(ids, first), pa.binary())], ["doc_id", "n_tokens", "listed", "decoded"])

    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, listed binary, decoded binary")
    return out.select("doc_id", "n_tokens", F.sha2("listed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
