import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import _sketch, decontam


@pytest.fixture
def many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("60", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def jobs(spark, f):
    group = f"bitmap-{f.__name__}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def set_bits(bits):
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).tolist()


def test_jobs_of_a_bitmap_follow_its_size(spark, many_partitions):
    cells = [i * 1_000_003 % (1 << 27) for i in range(500)]

    def whole():
        return _sketch.bitmap(spark.createDataFrame([(c,) for c in cells * 2], "cell long"), 1 << 27)

    bits, n = jobs(spark, whole)
    assert len(bits) == 1 << 24 and set_bits(bits) == sorted(cells)
    assert 4 <= n <= 8  # four parts


def test_jobs_of_a_fingerprint_bitmap(spark, many_partitions):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))

    def marked():
        return decontam._bitmap(fps)

    bits, n = jobs(spark, marked)
    want = sorted({(r.fp % (1 << 64)) >> 64 - decontam.BITS for r in fps.collect()})
    assert len(bits) == 1 << decontam.BITS - 3 and set_bits(bits) == want
    assert 1 <= n <= 8
