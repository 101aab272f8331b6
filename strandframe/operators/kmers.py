"""K-mer operators: similarity as equality joins on k-mers, never over pairs of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seq as sq
from . import graph, tables

#: coded() works through so many letters at a time; the longest k-mer of 26 letters that a long holds.
LETTERS, CODED_K = 1 << 21, 13
#: of_one_group() holds one of 2**BUCKET_BITS buckets of codes at a time.
BUCKET_BITS = 12
#: common_letters() has a bitmap of 2**CELL_BITS cells, 32 MB.
CELL_BITS = 28


def explode(df: DataFrame, id_cols: str | list[str], seq: str, k: int, tail: str = "keep", alphabet: str | None = None) -> DataFrame:
    """(ids, kmer), a row for each occurrence; tail="drop" leaves out a sequence's last one; alphabet: only k-mers of
    these letters."""
    ids = [id_cols] if isinstance(id_cols, str) else id_cols
    out = sq.places(df, ids, F.col(seq), k, 1, 0 if tail == "keep" else 1).select(*ids, F.col("piece").alias("kmer"))
    return out.where(F.col("kmer").rlike(f"^[{alphabet}]+$")) if alphabet else out


def _runs(held: list[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row, code, n) of some rows (ids, sequence): the ids' different rows, and each one's codes in order, with
    occurrences; of so many letters at a time."""
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.select(table.column_names[:-1])
    span = 26**k
    at_once = (2**63 - 1) // span
    text = table.column(table.num_columns - 1).combine_chunks().fill_null("").cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    ends, data = ends - ends[0], np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if len(data) and not (data.min() >= ord("a") and data.max() <= ord("z")):
        raise ValueError("only the letters a-z have a code")
    who = np.zeros(len(table), np.int64)
    for column in ids.columns:
        column = column.combine_chunks().dictionary_encode("encode")
        _, who = np.unique(who * len(column.dictionary) + column.indices.to_numpy(), return_inverse=True)
    _, first = np.unique(who, return_index=True)
    ids = ids.take(first)
    for low in range(0, len(data) - k + 1, LETTERS):
        part = data[low : low + LETTERS + k - 1].astype(np.int64) - ord("a")
        codes = np.zeros(len(part) - k + 1, np.int64)
        for i in range(k):
            codes = codes * 26 + part[i : i + len(codes)]
        row = np.repeat(np.arange(len(table)), np.diff(np.clip(ends, low, low + len(codes))))
        whole = np.arange(low + k, low + k + len(codes)) <= ends[row + 1]
        codes, group = codes[whole], who[row[whole]]
        blocks = np.array([0, len(codes)])
        if len(first) > at_once:  # an id and a code don't fit one number: ids by blocks
            order = np.argsort(group, kind="stable")
            codes, group = codes[order], group[order]
            blocks = np.searchsorted(group, np.arange(0, len(first) + at_once, at_once))
        for a, b in zip(blocks[:-1], blocks[1:], strict=True):
            base = group[a] // at_once * at_once if b > a else 0
            both, n = np.unique((group[a:b] - base) * span + codes[a:b], return_counts=True)
            yield ids, both // span + base, both % span, n


def _held(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """run over the batches, whose last column is a sequence, by LETTERS letters or one longer batch."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(b.num_columns - 1).nbytes
        if size >= LETTERS:
            yield from run(held)
            held, size = [], 0
    if held:
        yield from run(held)


def _letters(df: DataFrame, ids: list[str], seq: str, k: int) -> DataFrame:
    if not 0 < k <= CODED_K:
        raise ValueError(f"k-mers of 1 to {CODED_K} letters have a code")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # texts may be long
    return df.select(*ids, F.col(seq).alias("_seq")).where(F.length("_seq") >= k)


def coded(df: DataFrame, id_cols: str | list[str], seq: str, k: int) -> DataFrame:
    """(ids, kmer, n): the k-mers of sequences of the letters a-z as longs, in the order of the k-mers, with occurrences; k is
    at most 13. Occurrences of some millions of letters are counted together, so ids and a k-mer may have several rows."""
    ids = [id_cols] if isinstance(id_cols, str) else id_cols
    kept = _letters(df, ids, seq, k)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named, row, codes, n in _runs(held, k):
            for i in range(0, len(codes), 1 << 16):
                c = slice(i, i + (1 << 16))
                own = named.take(row[c]).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in own.columns), pa.array(codes[c]), pa.array(n[c].astype(np.int64))], names=[*ids, "kmer", "n"])

    return kept.mapInArrow(lambda batches: _held(batches, counted), T.StructType([*kept.schema.fields[:-1], T.StructField("kmer", T.LongType()), T.StructField("n", T.LongType())]))


def of_one_group(df: DataFrame, group: str, seq: str, k: int) -> DataFrame:
    """(kmer, group): the codes of the k-mers that stand in the sequences of one group only; group is a long, not null.

    Codes are dealt out to buckets by a one-to-one mixing, and a bucket's codes move together, as bytes: a row for a bucket and
    some millions of letters, with runs of codes of each group (gs, ns). A task holds one bucket at a time."""
    bits = (26**k - 1).bit_length()
    shift = max(0, bits - BUCKET_BITS)
    mask, odd = np.uint64((1 << bits) - 1), 0x9E3779B97F4A7C15 % (1 << bits) | 1
    back, width = np.uint64(pow(odd, -1, 1 << bits)), max(1, -(-shift // 8))
    kept = _letters(df, [group], seq, k)

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named, row, codes, _ in _runs(held, k):
            if not len(codes):
                continue
            names = named.column(0).combine_chunks().to_numpy()
            mixed = codes.astype(np.uint64) * np.uint64(odd) & mask
            bucket = (mixed >> np.uint64(shift)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")  # within a bucket by group
            bucket, row, low = bucket[order], row[order], mixed[order] & np.uint64((1 << shift) - 1)
            data = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
            starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            runs = np.flatnonzero((np.diff(bucket.astype(np.int64), prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            of = np.searchsorted(runs, [*starts, len(bucket)]).astype(np.int32)
            sizes = np.diff([*runs, len(bucket)]).astype(np.int32)
            ends = (np.array([*starts, len(bucket)]) * width).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            whole = pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.ListArray.from_arrays(pa.array(of), pa.array(names[row[runs]])), pa.ListArray.from_arrays(pa.array(of), pa.array(sizes)), blobs], names=["bucket", "gs", "ns", "codes"])
            for i in range(0, len(whole), 512):
                yield whole.slice(i, 512)

    def owned(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, width) for r in rows])
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :width] = low
        mixed = full.view("<u8").ravel() | np.uint64(bucket << shift)
        names, whose = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        whose = np.repeat(whose, np.concatenate([r[1] for r in rows]))
        order = np.lexsort((whose, mixed)) if len(names) > 1 else np.argsort(mixed)
        mixed, whose = mixed[order], whose[order]
        starts = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
        last = np.concatenate([starts[1:], [len(mixed)]]) - 1
        one = starts[whose[starts] == whose[last]]  # a code's groups are in order
        kmer, name = (mixed[one] * back & mask).astype(np.int64), names[whose[one]]
        for i in range(0, len(one), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(kmer[i : i + (1 << 16)]), pa.array(name[i : i + (1 << 16)])], names=["kmer", group])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and rows:
                    yield from owned(now, rows)
                    rows = []
                now = bucket
                rows.append((batch.column(1)[r].values.to_numpy(), batch.column(2)[r].values.to_numpy(), batch.column(3)[r].as_py()))
        if rows:
            yield from owned(now, rows)

    moved = kept.mapInArrow(lambda batches: _held(batches, packed), "bucket int, gs array<long>, ns array<int>, codes binary")
    return moved.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, f"kmer long, `{group}` long")


def _halves(df: DataFrame, id_col: str, seq: str, k: int, bitmap=None) -> DataFrame:
    """(id, k1, k2, cell) of each k-mer of 2 to 26 letters a-z: the codes of its first and last half, which tell it, and its
    cell of 2**CELL_BITS; bitmap: only those whose bit is set."""
    half = (k + 1) // 2
    kept = _letters(df, [id_col], seq, half).where(F.length("_seq") >= k)

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        text = table.column(1).combine_chunks().cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        ends, data = ends - ends[0], np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        if len(data) and not (data.min() >= ord("a") and data.max() <= ord("z")):
            raise ValueError("only the letters a-z have a code")
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for low in range(0, len(data) - k + 1, LETTERS):
            part = data[low : low + LETTERS + k - 1].astype(np.int64) - ord("a")
            codes = np.zeros(len(part) - half + 1, np.int64)
            for i in range(half):
                codes = codes * 26 + part[i : i + len(codes)]
            first, last = codes[: len(part) - k + 1], codes[k - half :]
            mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ last.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            cell = (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            row = np.repeat(np.arange(len(table)), np.diff(np.clip(ends, low, low + len(first))))
            keep = np.arange(low + k, low + k + len(first)) <= ends[row + 1]
            if bits is not None:
                keep &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            first, last, cell, row = first[keep], last[keep], cell[keep], row[keep]
            for i in range(0, len(row), 1 << 16):
                c = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(pa.array(row[c])), pa.array(first[c]), pa.array(last[c]), pa.array(cell[c])], names=[id_col, "k1", "k2", "cell"])

    return kept.mapInArrow(lambda batches: _held(batches, cut), T.StructType([kept.schema[0], *(T.StructField(c, T.LongType()) for c in ("k1", "k2", "cell"))]))


def _bitmap(cells: DataFrame):
    """A broadcast bit for each of 2**CELL_BITS cells (cell), set for those there; the driver reads parts of at most 4 MB."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            cell = b.column(0).to_numpy()
            for block in np.unique(cell >> 16):
                bits = blocks.setdefault(int(block), np.zeros(1 << 13, np.uint8))
                at = np.zeros(1 << 16, np.uint8)
                at[cell[cell >> 16 == block] & 0xFFFF] = 1
                bits |= np.packbits(at, bitorder="little")
        for block, bits in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bits.tobytes()])], names=["block", "bits"])

    out = bytearray(1 << CELL_BITS - 3)
    placed = cells.select("cell").distinct().repartition(F.shiftright("cell", 16)).sortWithinPartitions("cell")
    for r in placed.mapInArrow(packed, "block long, bits binary").repartition(1 << CELL_BITS - 25).toLocalIterator():
        out[r.block << 13 : (r.block + 1) << 13] = r.bits
    return cells.sparkSession.sparkContext.broadcast(bytes(out))


def common_letters(sets: DataFrame, df: DataFrame, a: str, b: str, seq: str, k: int) -> DataFrame:
    """common() of sequences (a, seq) and (b, seq) of the letters a-z and k-mers of 2 to 26 letters. K-mers of df that no bit
    of a bitmap of those of sets allows are left out before they are moved."""
    left = graph.written(_halves(sets, a, seq, k).distinct())
    bits = _bitmap(left)
    right = graph.written(_halves(df, b, seq, k, bits).groupBy(b, "k1", "k2").agg(F.count("*").alias("_n")))
    bits.destroy()
    left, right, on = tables.dealt(left.drop("cell"), right, "k1", a, b)
    return left.join(right, [*on, "k2"]).groupBy(a, b).agg(F.sum("_n").alias("score"))


def decoded(code: Column, k: int) -> Column:
    """The letters of a k-mer's code."""
    return F.concat(*(F.chr(F.call_function("div", code, F.lit(26**j)) % 26 + 97) for j in reversed(range(k))))


def occurrences(kmers: DataFrame) -> Column:
    """The number of occurrences in rows of a k-mer table, with a column n or a row for each."""
    return F.sum("n") if "n" in kmers.columns else F.count("*")


def explode_spaced(df: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """K-mers that skip every third base, of windows of 3 * (k // 2) bases of ACGT."""
    wide = explode(df, id_col, seq, 3 * (k // 2), alphabet="ACGT")
    return wide.withColumn("kmer", F.regexp_replace("kmer", "(..).", "$1"))


def common(a: DataFrame, b: DataFrame, a_id: str, b_id: str, mode: str = "occurrences") -> DataFrame:
    """(a_id, b_id, score) from two k-mer tables: occurrences in b of a's k-mer set, or (mode="set") shared k-mers.

    Both sides are written first, so that how they are joined goes by their real size and not by that of their texts; k-mers
    that stand in very many sequences are dealt out over several tasks."""
    right = b.select(b_id, "kmer")
    right = graph.written(right.distinct() if mode == "set" else right.groupBy(b_id, "kmer").agg(F.count("*").alias("_n")))
    left = graph.written(a.select(a_id, "kmer").join(right.select("kmer").distinct(), "kmer", "left_semi").distinct())  # most k-mers meet nothing
    score = F.count("*") if mode == "set" else F.sum("_n")
    left, right, on = tables.dealt(left, right, "kmer", a_id, b_id)
    return left.join(right, on).groupBy(a_id, b_id).agg(score.alias("score"))


def pair_similarity(queries: DataFrame, targets: DataFrame, q_id: str, t_id: str, seq: str, k: int, mode: str = "occurrences") -> DataFrame:
    return common(explode(queries, q_id, seq, k), explode(targets, t_id, seq, k), q_id, t_id, mode)


def all_pairs(df: DataFrame, id_col: str, seq: str, k: int, min_common: int = 4) -> DataFrame:
    """(a, b, score), a <> b: pairs with at least min_common shared k-mers, in both directions.

    Exact prefix filter: with each set's k-mers from the rarest to the most common, two sets that share t k-mers have
    one in common among the first n - t + 1 of each, so only those meet; candidates are then counted in full.
    """
    sets = graph.written(explode(df, id_col, seq, k).distinct())
    counts = sets.groupBy("kmer").agg(F.count("*").alias("_f")).where("_f > 1")
    shared = sets.join(counts, "kmer")  # a k-mer of one sequence alone shares nothing
    w = W.partitionBy(id_col)
    ranked = shared.withColumns({"_i": F.row_number().over(w.orderBy("_f", "kmer")), "_n": F.count("*").over(w)})
    prefix = ranked.where(F.col("_i") <= F.col("_n") - min_common + 1).select(id_col, "kmer")
    prefix = graph.written(prefix)
    left, right, on = tables.dealt(prefix.select(F.col(id_col).alias("a"), "kmer"), prefix.select(F.col(id_col).alias("b"), "kmer"), "kmer", "a", "b")
    candidates = left.join(right, on).where("a < b").select("a", "b").distinct()
    a, b = shared.select(F.col(id_col).alias("a"), "kmer"), shared.select(F.col(id_col).alias("b"), "kmer")
    half = candidates.join(a, "a").join(b, ["b", "kmer"]).groupBy("a", "b").agg(F.count("*").alias("score")).where(F.col("score") >= min_common)
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def all_pairs_occurrences(df: DataFrame, id_col: str, seq: str, k: int, least: int = 4, tail: str = "drop") -> DataFrame:
    """(a, b, score), a <> b: occurrences in b of a's k-mers, where there are at least `least`; not symmetric.

    Exact prefix filter, weighted: with b's k-mers from the rarest to the most common, those at the end that occur fewer
    than `least` times in all can't make a pair alone, so only the others look for partners; these are then counted in full.
    """
    sets = graph.written(explode(df, id_col, seq, k, tail).groupBy(id_col, "kmer").agg(F.count("*").alias("_c")))
    counts = sets.groupBy("kmer").agg(F.count("*").alias("_f")).where("_f > 1")
    shared = sets.join(counts, "kmer")  # a k-mer of one sequence alone shares nothing
    w = W.partitionBy(id_col).orderBy(F.desc("_f"), F.desc("kmer")).rowsBetween(W.unboundedPreceding, 0)
    prefix = shared.withColumn("_to_end", F.sum("_c").over(w)).where(F.col("_to_end") >= least).select(F.col(id_col).alias("b"), "kmer")
    a, b = shared.select(F.col(id_col).alias("a"), "kmer"), shared.select(F.col(id_col).alias("b"), "kmer", "_c")
    candidates = a.join(prefix, "kmer").where("a <> b").select("a", "b").distinct()
    return candidates.join(a, "a").join(b, ["b", "kmer"]).groupBy("a", "b").agg(F.sum("_c").alias("score")).where(F.col("score") >= least)


def top_matches(scores: DataFrame, query: str, target: str, n: int) -> DataFrame:
    """Each query's n best targets, ties by the smaller target."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), target))).where(F.col("rank") <= n)


def group_hits(reads: DataFrame, index: DataFrame, read_id: str, group: str, least: int = 5) -> DataFrame:
    """(read, group, hits) of at least `least`: k-mer occurrences of a read that the index (kmer, group) holds."""
    n = reads.groupBy(read_id, "kmer").agg(F.count("*").alias("_n"))
    return n.join(index.select("kmer", group).distinct(), "kmer").groupBy(read_id, group).agg(F.sum("_n").alias("hits")).where(F.col("hits") >= least)


def annotate(train: DataFrame, test: DataFrame, label: str, id_col: str, default: str, weighted: bool = False) -> DataFrame:
    """(id, label, votes): k-mers of a single label vote (weighted: by their count in training); the winner needs
    twice the runner-up's votes, else the default; ids without votes get the default."""
    own = train.groupBy("kmer").agg(F.min(label).alias("_l"), F.max(label).alias("_m"), occurrences(train).alias("_w")).where("_l = _m")
    return voted(own.select("kmer", F.col("_l").alias(label), *(["_w"] if weighted else [])), test, label, id_col, default)


def voted(own: DataFrame, test: DataFrame, label: str, id_col: str, default: str) -> DataFrame:
    """annotate() by k-mers of a single label (kmer, label), of which each occurrence in test counts 1, or the k-mer's _w."""
    times = F.col("n") if "n" in test.columns else F.lit(1)
    weight = F.col("_w") if "_w" in own.columns else F.lit(1)
    votes = test.hint("merge").join(own.withColumnRenamed(label, "_l"), "kmer").groupBy(id_col, "_l").agg(F.sum(times * weight).alias("_v"))
    w = W.partitionBy(id_col).orderBy(F.desc("_v"), "_l")
    best = votes.withColumns({"_i": F.row_number().over(w), "_next": F.coalesce(F.lead("_v").over(w), F.lit(0))}).where("_i = 1")
    named = best.select(id_col, F.when(F.col("_v") >= 2 * F.col("_next"), F.col("_l")).otherwise(default).alias(label), F.col("_v").alias("votes"))
    return test.select(id_col).distinct().join(named, id_col, "left").select(id_col, F.coalesce(label, F.lit(default)).alias(label), F.coalesce("votes", F.lit(0)).alias("votes"))


def connections(index: DataFrame, group: str, groups: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """(a, b, kmers): distinct k-mers that two groups share, a < b; groups: only pairs with one of these. Null groups share
    nothing. K-mers are told apart by two 64-bit hashes. source: a table that has all groups and is cheaper to read than
    the index.

    A k-mer's groups are kept as sets of bits, in blocks of 60 groups by name, and equal sets are counted before they are
    taken apart: however common a k-mer is, it has one row a block, and pairs are made from the different sets only."""
    wide = 60
    names = graph.written((source or index).where(F.col(group).isNotNull()).select(F.col(group).alias("name")).distinct())
    names = graph.written(tables.numbered(names, [F.col("name")], "_id").withColumn("_id", F.col("_id") - 1))
    n = names.count()
    own = index.select(F.col(group).alias("name"), F.xxhash64("kmer").alias("k1"), F.xxhash64(F.lit("kmer"), "kmer").alias("k2"))
    own = own.join(F.broadcast(names) if n <= 100_000 else names, "name")
    bits = own.groupBy("k1", "k2", F.floor(F.col("_id") / wide).alias("block")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_id % {wide} as int))")).alias("bits"))
    bits = graph.written(bits)
    member = lambda b: F.filter(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.getbit(b, i) == 1)
    inside = bits.where(F.bit_count("bits") > 1).groupBy("block", "bits").agg(F.count("*").alias("n"))
    one = inside.select("n", (F.col("block") * wide).alias("_from"), F.explode(member(F.col("bits"))).alias("x"), "bits").select("n", "_from", "x", F.explode(member(F.col("bits"))).alias("y")).where("x < y")
    pairs = one.select((F.col("_from") + F.col("x")).alias("_a"), (F.col("_from") + F.col("y")).alias("_b"), "n")
    if n > wide:
        left, right = bits.select("k1", "k2", F.col("block").alias("p"), F.col("bits").alias("u")), bits.select("k1", "k2", F.col("block").alias("q"), F.col("bits").alias("v"))
        across = left.join(right, ["k1", "k2"]).where("p < q").groupBy("p", "u", "q", "v").agg(F.count("*").alias("n"))
        two = across.select("n", "q", "v", "p", F.explode(member(F.col("u"))).alias("x")).select("n", "q", "p", "x", F.explode(member(F.col("v"))).alias("y"))
        pairs = pairs.unionByName(two.select((F.col("p") * wide + F.col("x")).alias("_a"), (F.col("q") * wide + F.col("y")).alias("_b"), "n"))
    pairs = pairs.groupBy("_a", "_b").agg(F.sum("n").alias("kmers"))
    for side in ("a", "b"):
        name = names.select(F.col("name").alias(side), F.col("_id").alias(f"_{side}"))
        pairs = pairs.join(name, f"_{side}")
    pairs = pairs.select("a", "b", "kmers")
    if groups is None:
        return pairs
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col(group).alias(side)).distinct().withColumn(f"_{side}", F.lit(True)), side, "left")
    return pairs.where("_a or _b").select("a", "b", "kmers")


def screen_reads(hits: DataFrame, reads: DataFrame, sample: str, read_id: str, least: int = 5, most: int = 10) -> DataFrame:
    """Reads of each sample whose best hit count is at least `most` (likely), at least `least` (distant), or less (none)."""
    best = hits.groupBy(sample, read_id).agg(F.max("hits").alias("_h"))
    h = F.coalesce("_h", F.lit(0))
    return reads.select(sample, read_id).distinct().join(best, [sample, read_id], "left").groupBy(sample).agg(F.count_if(h >= most).alias("likely"), F.count_if((h >= least) & (h < most)).alias("distant"), F.count_if(h < least).alias("none"))


def tails(df: DataFrame, id_col: str, seq: str, n: int) -> DataFrame:
    """(id, tail): the last n letters in lower case, of sequences that have them."""
    return df.where(F.length(seq) >= n).select(id_col, F.lower(F.substring(F.col(seq), F.length(seq) - n + 1, F.lit(n))).alias("tail"))
