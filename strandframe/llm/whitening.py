"""Whitening of embeddings: distinct vectors with their multiplicities, a centred covariance as partial matrix products,
and one projection for each distinct vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import emptied, written
from ._skew import joined_by_count

#: x = floor(SCALE * entry) + SHIFT: fixed values of the contract.
SCALE, SHIFT = 64, 1_000_000
#: Largest |SCALE * entry| that still has an x; vectors with larger entries go as those with infinite ones do.
LARGEST = float(2**62)
#: The covariance (MOST_DIMENSIONS squared doubles) is decomposed on the driver.
MOST_DIMENSIONS = 2048
LOW = 32  # bits of the lower half of x, so that sums of halves fit in a long


def integers(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds null, NaN, infinite or larger than LARGEST entries."""
    whole = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return df.where(F.col(vector).isNotNull() & whole).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Sum of the weights, and of the weighted x in each dimension, exact. A row a dimension and task is shuffled."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, object), np.zeros(d, object)
        for b in batches:
            x, w = _matrix(b.column("x"), d), b.column("weight").to_numpy()
            n += sum(w.tolist())
            for k in range(0, len(x), 1024):  # halves of 30 and 32 bits, weights split likewise: no sum leaves a long
                for shift in (0, 20, 40):
                    v = (w[k : k + 1024] >> shift) & 0xFFFFF
                    if v.any():
                        high += (v[:, None] * (x[k : k + 1024] >> LOW)).sum(0).astype(object) << shift
                        low += (v[:, None] * (x[k : k + 1024] & ((1 << LOW) - 1))).sum(0).astype(object) << shift
        s = [str((int(h) << LOW) + int(v)) for h, v in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(s, pa.string())})

    total = fit.mapInArrow(part, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(total.collect())  # d rows
    return rows[0].n, [int(r.s) for r in rows]


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, in longs where they hold it and else in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, s)) < 2**63:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _deviation(c: np.ndarray) -> list[int | None]:
    """Row sums of squares, exact; None where a long can't hold it."""
    most = 0 if not c.size else max(int(c.max()), -int(c.min()))
    if c.dtype != object and c.shape[1] * most**2 < 2**63:
        return (c * c).sum(1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(y) ** 2 for y in row) for row in c)]


def _scatter(table: DataFrame, column: str, d: int, centre) -> np.ndarray:
    """The sum of w * centre(v) centre(v)^T over a table of (column, weight): a matrix product for each Arrow batch, a partial
    matrix for each task, whose rows are added by row number. Only the d x d result comes to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((d, d))
        for b in batches:
            v = centre(_matrix(b.column(column), d))
            m += (v * b.column("weight").to_numpy()[:, None]).T @ v
        if m.any():
            rows = pa.ListArray.from_arrays(np.arange(0, d * d + 1, d, dtype=np.int32), m.ravel())
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "row": rows})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(list(rows["row"])), axis=0)]})

    out = np.zeros((d, d))
    for r in table.select(column, "weight").mapInArrow(part, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect():
        out[r.i] = r.row
    return out


def _components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit vectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 16, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that has a whole vector, and for
    each of its first components.

    Identical x vectors are grouped; in the fit each weighs one (weights="one") or as often as it occurs ("count"); n is the
    sum of the weights. Sums of x are exact, the covariance is centred before it is multiplied, and every distinct vector is
    whitened once and joined back to its rows by two 64-bit hashes; the few vectors that hold a thousandth of the rows each
    are joined by broadcast, the rest by a shuffle.

    Rows whose vector is null or holds null, NaN, infinite or entries of 2^56 and more are left out; ids may be null or
    repeated, other columns are ignored. Vectors of different length are fitted apart, each length as a table of its own; an
    empty vector has no components and so no row. A component without variance (fewer distinct vectors than dimensions, a
    constant dimension) has whitened null and explained 0, or null where nothing varies, and no part in identity_error,
    which is null if no component varies. deviation is null where a long can't hold it. Vectors of over MOST_DIMENSIONS
    entries raise an error, as the covariance is decomposed on the driver. Ties of eigenvalues are in no fixed order."""
    if weights not in ("one", "count"):
        raise ValueError(weights)
    rows = integers(df, id_col, vector)
    spark = df.sparkSession
    distinct = written(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("weight", F.lit(1).cast("long") if weights == "one" else F.col("copies")))
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumn("vec_id", F.col("vec_id").cast(rows.schema["vec_id"].dataType))
    lengths = [r.d for r in distinct.select(F.size("x").alias("d")).distinct().where("d > 0").limit(MOST_DIMENSIONS + 1).collect()]
    if any(d > MOST_DIMENSIONS for d in lengths):
        raise ValueError(f"vectors of over {MOST_DIMENSIONS} dimensions")
    for d in sorted(lengths):
        fit = distinct.where(F.size("x") == d)
        out = out.unionByName(_whitened(rows.where(F.size("x") == d), fit, d, components))
    emptied(distinct)
    return out


def _whitened(rows: DataFrame, fit: DataFrame, d: int, components: int) -> DataFrame:
    n, s = _sums(fit, d)
    values, vectors = _components(covariance := _scatter(fit, "x", d, lambda x: _centred(x, n, s).astype(float) / n) / n, components)
    k, trace = len(values), float(np.trace(covariance))
    varies = values > trace * d * 1e-13
    scale = np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _centred(_matrix(b.column("x"), d), n, s)
            z = (c.astype(float) / n) @ vectors * scale
            z = pa.ListArray.from_arrays(np.arange(0, z.size + 1, k, dtype=np.int32), z.ravel())
            yield pa.RecordBatch.from_pydict({"h1": b.column("h1"), "h2": b.column("h2"), "copies": b.column("copies"), "weight": b.column("weight"), "deviation": pa.array(_deviation(c), pa.int64()), "z": z})

    keys = (F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("x"), "x").alias("h2"))
    each = written(fit.select("x", "copies", "weight", *keys).mapInArrow(project, "h1 long, h2 long, copies long, weight long, deviation long, z array<double>"))
    means = each.select("weight", F.posexplode("z").alias("i", "z")).groupBy("i").agg((F.sum(F.col("weight") * F.col("z")) / n).alias("m"))
    mean = np.array([r.m for r in sorted(means.collect())])
    identity = (_scatter(each, "z", k, lambda z: z - mean) / n - np.eye(k))[np.ix_(varies, varies)]
    error = float(np.abs(identity).max()) if varies.any() else None
    found = joined_by_count(rows.select("vec_id", *keys), each.drop("weight"), ["h1", "h2"], "copies")
    facts = F.array(*(F.struct(F.lit(bool(v)).alias("varies"), F.lit(max(0.0, float(e)) / trace if trace else None).cast("double").alias("explained")) for v, e in zip(varies, values, strict=True)))
    one = found.select("vec_id", "deviation", "z", F.posexplode(facts).alias("i", "fact"))
    return one.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("fact.varies"), F.col("z")[F.col("i")]).alias("whitened"),
        F.when(F.col("fact.varies"), F.col("fact.explained")).otherwise(F.lit(0.0 if trace else None).cast("double")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
