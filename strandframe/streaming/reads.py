"""Structured Streaming variants: binning of arriving reads, windowed counts, latest progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kmers, signatures


def assign_stream(reads: DataFrame, index: DataFrame, read_id: str, seq: str, group: str, k: int, out: str, checkpoint: str, least: int = 1):
    """Assigns each arriving read to the groups of most signature hits, appending (read, group, score) to a Parquet
    table. A read never spans batches, so every batch is scored on its own; batch folders make a retried batch
    overwrite itself. An index of codes (signatures.of_letters) is for reads of the letters a-z. Returns the started query;
    it ends when all that is available has been read."""
    cut = kmers.coded if dict(index.dtypes)["kmer"] == "bigint" else kmers.explode

    def batch(df: DataFrame, number: int) -> None:
        found = cut(df, read_id, seq, k)
        signatures.assign(found, index, read_id, group, least).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_hits(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, group, n) of tumbling windows; rows later than the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n")


def latest(lines: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The last value of each key so far, for update mode."""
    return lines.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("at"))
