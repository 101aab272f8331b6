"""What the operators of this package share on the Spark side."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null doc_id in keys; it sorts after every other id.
NO_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none (tests on one machine), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, compression: str | None = None, row_group: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors. row_group: the bytes of a row
    group, looked at with every row; otherwise a hundred rows at least are held in memory, however large they are."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    every = {f"parquet.page.size.row.check.{end}": "1" for end in ("min", "max")}  # tells when row groups are measured, too
    df.write.options(**({"parquet.block.size": str(row_group), **every} if row_group else {})).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def emptied(*tables: DataFrame) -> None:
    """Overwrites tables from written() that nothing reads any more with no rows, which frees their space."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(_paths.pop(df))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and the non-null key (_id, _k): rows that agree in id and text are one document."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(id_col, text_col).alias("_k"),
    )


def extended(df: DataFrame, fields: dict[str, str]) -> T.StructType:
    """The schema of df with more fields, whatever its columns are called."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items())).fields])


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs, all columns, whose (_id, _k) is (left_semi) or isn't (left_anti) among the keys; docs may have columns of
    these names."""
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64("doc_id", "text").alias("_k"),
    )
    kept = whole.join(keys, ["_id", "_k"], how)
    return (kept if how == "left_anti" else kept.dropDuplicates(["_id", "_k"])).select("_doc.*")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, as texts may be long: a task then holds a few MB of them, not 10,000 texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
