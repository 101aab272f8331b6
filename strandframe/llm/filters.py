"""Audit of filter order: which of five document filters removes what, in every order, over a sparse document-term matrix."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import NO_ID, extended, small_batches, written
from ._skew import joined_by_count

FILTERS = "ABCDE"
#: A shard of the matrix is closed when its texts reach this many bytes; a row group of written shards when it does these.
SHARD_BYTES, GROUP_BYTES = 2 << 20, 8 << 20
LEAST_WORDS = 200


#: Classes of bytes that are counted in each text beside its words.
CAPITALS, SIGNS, INNER = "n_capitals", "n_signs", "n_inner"
CLASSES = {CAPITALS: list(range(0x41, 0x5B)), SIGNS: list(b"#$%&*|"), INNER: list(range(0x80, 0xC0))}  # INNER: but the first of a code point
MOST_CLASHES = 10_000


def _shard(text: pa.Array) -> dict:
    """The rows of some documents as a compressed sparse matrix whose columns are the shard's own words."""
    split = pc.ascii_split_whitespace(text)  # at 0x20 and 0x09 to 0x0D
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    cells = pc.list_parent_indices(split).filter(full).to_numpy().astype(np.int64)
    coded = words.filter(full).dictionary_encode()
    del split, words, full
    width = max(len(coded.dictionary), 1)
    cells *= width
    cells += coded.indices.to_numpy()
    cells, counts = np.unique(cells, return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(text) + 1) * width)
    return {"starts": starts.astype(np.int64), "columns": (cells % width).astype(np.int32), "counts": counts.astype(np.int32), "words": coded.dictionary}


def _classes(text: pa.Array) -> dict[str, pa.Array]:
    """For each text its number of bytes, and of those of each class."""
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    out = {"n_bytes": pa.array(np.diff(at).astype(np.int64))}
    data = np.frombuffer(text.buffers()[2], np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[members] = True
        found = np.flatnonzero(table[data])
        out[name] = pa.array(np.diff(np.searchsorted(found, at)))
    return out


def shards(docs: DataFrame, text_col: str) -> DataFrame:
    """(shard, docs, starts, columns, counts, words): documents by shards of SHARD_BYTES of text or one longer document. docs
    has the rows' other columns as structs, with n_bytes and the counts of CLASSES; row r's cells are starts[r] to
    starts[r + 1] of columns and counts; columns are numbered by the shard's words. The result must be written before use,
    as what a shard holds depends on how rows come."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    kind = "struct<" + ", ".join([*(f"`{f.name}`: {f.dataType.simpleString()}" for f in others), *(f"{c}: long" for c in ("n_bytes", *CLASSES))]) + ">"
    ddl = f"shard long, docs array<{kind}>, starts array<long>, columns array<int>, counts array<int>, words array<string>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, closed = TaskContext.get().partitionId() << 32, 0
        held, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            one = {"docs": pa.concat_arrays(held), **_shard(pa.concat_arrays(texts))}
            lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for k, v in one.items()}
            return pa.RecordBatch.from_pydict({"shard": pa.array([first + closed]), **lists})

        for b in batches:
            texts.append(t := b.column(b.schema.get_field_index(text_col)))
            own = {f.name: b.column(b.schema.get_field_index(f.name)) for f in others} | _classes(t)
            held.append(pa.StructArray.from_arrays(list(own.values()), list(own)))
            size += t.nbytes
            if size >= SHARD_BYTES:
                yield shard()
                held, texts, size, closed = [], [], 0, closed + 1
        if held:
            yield shard()

    return docs.mapInArrow(part, ddl)


def code(word: Column) -> Column:
    """A word's number unless another word has the same one: 63 bits of a hash, so that no shard needs to ask for it."""
    return F.shiftrightunsigned(F.xxhash64(word), 1)


def clashes(local: DataFrame) -> dict[str, int]:
    """Negative numbers for all words of local's shards whose code another word has too, told by a second hash. Of the square
    of the number of distinct words over 2^64 there are few; more than MOST_CLASHES raise an error."""
    word = local.select(F.explode("words").alias("word"))
    pairs = word.select(code(F.col("word")).alias("number"), F.xxhash64(F.lit("word"), "word").alias("check"))
    twice = pairs.groupBy("number").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("number")
    numbers = [r.number for r in twice.limit(MOST_CLASHES + 1).collect()]
    if not numbers:
        return {}
    words = sorted(r.word for r in word.where(code(F.col("word")).isin(numbers)).distinct().limit(MOST_CLASHES + 1).collect())
    if len(words) > MOST_CLASHES:
        raise ValueError(f"over {MOST_CLASHES} words whose numbers clash")
    return {w: -1 - i for i, w in enumerate(words)}


def document_terms(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written matrix (shard, docs, starts, columns, counts, numbers) and its dictionary (word, number), which numbers each
    distinct word of all texts once; numbers[c] is the dictionary's number of a shard's column c.

    Numbers are codes, so each shard encodes its own words; that no two words share a number is settled over all words, by a
    count with one row a distinct word and shard (the commonest word has one a shard), and the few that would are numbered
    by a list."""
    small_batches(docs.sparkSession)
    local = written(shards(docs, text_col), "zstd", GROUP_BYTES)
    own = clashes(local)
    number = code
    if own:
        listed = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))
        number = lambda w: F.coalesce(F.try_element_at(listed, w).cast("long"), code(w))
    numbers = F.transform("words", number)
    dictionary = local.select(F.explode(F.arrays_zip("words", numbers.alias("numbers"))).alias("one")).select(F.col("one.words").alias("word"), F.col("one.numbers").alias("number")).distinct()
    return local.select("shard", "docs", "starts", "columns", "counts", numbers.alias("numbers")), dictionary


def row_sums(matrix: DataFrame) -> DataFrame:
    """The documents' columns with n_words, the sum of a row, and n_distinct, its number of columns by the dictionary."""
    fields = matrix.schema["docs"].dataType.elementType

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                docs, starts, columns, counts, numbers = (b.column(i).slice(r, 1).flatten() for i in range(5))
                at, sums = starts.to_numpy(), np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
                known, rank = np.unique(numbers.to_numpy(), return_inverse=True)
                cells, row = rank[columns.to_numpy()].astype(np.int64), np.repeat(np.arange(len(docs)), np.diff(at))
                if len(known) < len(rank):  # columns of one number are one
                    row, cells = np.unique(np.stack([row, cells]), axis=1)
                distinct = np.bincount(row, minlength=len(docs))
                own = {f.name: docs.field(i) for i, f in enumerate(fields)}
                yield pa.RecordBatch.from_pydict(own | {"n_words": pa.array(np.diff(sums[at])), "n_distinct": pa.array(distinct.astype(np.int64))})

    empty = matrix.sparkSession.createDataFrame([], fields)
    return matrix.select("docs", "starts", "columns", "counts", "numbers").mapInArrow(part, extended(empty, {"n_words": "long", "n_distinct": "long"}))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, fails) for each document; fails has the bit 1, 2, 4, 8, 16 of each of the filters A to E that it fails.

    A null text is empty, a null part is an empty string. A null id counts as larger than all others, and rows of equal ids
    don't fail E by each other. Texts are the same if their SHA-256 is. Empty texts fail A alone of A to D (no word is 0 of
    0), and E where a smaller id has one. Other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"),
    )
    own = written(row_sums(document_terms(doc, "text")[0]))
    texts = own.groupBy("same").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.count("*").alias("n"))
    texts = written(texts.where("n > 1"))
    found = joined_by_count(own, texts, ["same"], "n", "left")
    bits = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col(CAPITALS) > 3 * (F.col("n_bytes") - F.col(INNER)),
        "D": F.col(SIGNS) > 0,
        "E": F.coalesce(F.col("first") < F.coalesce("doc_id", F.lit(NO_ID)), F.lit(False)),
    }
    fails = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(bits[f] for f in FILTERS)), F.lit(0))
    return found.select("doc_id", "part", fails.cast("int").alias("fails"))


def orders(spark: SparkSession) -> DataFrame:
    """(fails, filter_order, step, bit, fails_it, early): what each step of all orders does to documents that fail the filters
    of fails; 32 x 600 rows."""
    rows = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        for k, bit in enumerate(bits):
            rows += [("".join(order), k + 1, bit, fails, bool(fails & bit), bool(fails & sum(bits[:k]))) for fails in range(1 << len(FILTERS))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["filter_order", "step", "bit", "fails", "fails_it", "early"]), "filter_order string, step int, bit int, fails int, fails_it boolean, early boolean")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each part 600
    rows, the five steps of all 120 orders.

    Documents are counted by part, failed filters and labels first; the orders are applied to these counts, of which a part
    has 128 at most. labels has (doc_id, quality, toxic); repeated ids count as good or toxic if any row says so, null ids
    and documents without a label as neither. An empty table has no part and gives no rows. See failures() for odd rows."""
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    own = failures(docs, id_col, text_col, part_col)
    alone = own.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    each = own.where("doc_id is not null").join(said, "doc_id", "left").unionByName(alone)
    counts = each.groupBy("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count("*").alias("n"))
    long = counts.join(F.broadcast(orders(docs.sparkSession)), "fails")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    here = F.col("fails_it") & ~F.col("early")
    steps = long.groupBy("part", "filter_order", "step", "bit").agg(
        of(~F.col("early") & ~F.col("fails_it")).alias("kept"), of(here).alias("removed"), of(F.col("early") & F.col("fails_it")).alias("redundant"),
        of(F.col("fails") == F.col("bit")).alias("unique_fails"), of(here & (F.col("good") == 1)).alias("good_lost"), of(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    total = steps.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return steps.join(total, ["part", "bit"]).drop("bit")
