"""Count matrices in long form: (row, col, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables


def role_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(F.count("*").alias("n"))


def cooccurrence(matrix: DataFrame, percent: float = 80, least: int = 5) -> DataFrame:
    """(a, b, both, percent): of the rows with column a, how many also have b; a <> b, at least `least` rows with both
    and the given percentage."""
    cells = matrix.where("n > 0").select("row", F.col("col").alias("a")).distinct()
    size = cells.groupBy("a").agg(F.count("*").alias("_a"))
    both = cells.join(cells.select("row", F.col("a").alias("b")), "row").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    return both.join(size, "a").select("a", "b", "both", F.round(100 * F.col("both") / F.col("_a"), 2).alias("percent")).where(F.col("percent") >= percent)


def partition(matrix: DataFrame, target) -> tuple[DataFrame, DataFrame]:
    """(row, y) with y the target column's value, 0 where it has none; and the other columns."""
    y = matrix.groupBy("row").agg(F.coalesce(F.sum(F.when(F.col("col") == target, F.col("n"))), F.lit(0)).alias("y"))
    return y, matrix.where(F.col("col") != target)


def split(matrix: DataFrame, fraction: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, by the hash of the row."""
    train = tables.share(seed, "row") < int(fraction * 10_000)
    return matrix.where(train), matrix.where(~train)


def profile_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, diff): roles that only one of two profiles has - new in b, missing in b."""
    x, y = a.select(*keys, "role").distinct().withColumn("_x", F.lit(1)), b.select(*keys, "role").distinct().withColumn("_y", F.lit(1))
    return x.join(y, [*keys, "role"], "full").where("_x is null or _y is null").select(*keys, "role", F.when(F.col("_x").isNull(), "new").otherwise("missing").alias("diff"))


def kfold(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with fold: consecutive test blocks of a fixed size in order of the key's hash, the last one shorter.

    Rows are numbered by buckets: a bucket's rows count up within it, after those of the buckets before.
    """
    hashed = df.withColumns({"_h": F.xxhash64(key), "_b": F.shiftright(F.xxhash64(key), 54)})
    before = hashed.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # at most 1024 rows
    at = F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_before")
    return hashed.join(F.broadcast(before), "_b").withColumn("fold", F.floor(at / size)).drop("_h", "_b", "_n", "_before")


def to_directory(matrix: DataFrame, columns: list, path: str) -> None:
    """row.h, col.h and X: ids with positions, and the dense rows in the order of the columns given."""
    spark = matrix.sparkSession
    wide = matrix.groupBy("row").pivot("col", columns).agg(F.sum("n")).na.fill(0)
    at = wide.orderBy("row").select("row", *(F.col(f"`{c}`").cast("string") for c in columns))
    lines = at.select(F.col("row").cast("string"), F.concat_ws("\t", *(F.col(f"`{c}`") for c in columns)).alias("x"))
    lines.select(F.concat_ws("\t", "row", "x").alias("value")).write.mode("overwrite").text(f"{path}/X")
    spark.createDataFrame([(f"{i}\t{c}",) for i, c in enumerate(columns)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/col.h")


def from_directory(spark, path: str) -> DataFrame:
    """The long form of what to_directory wrote; rows carry their ids, so their order doesn't matter."""
    heads = spark.read.text(f"{path}/col.h").select(F.split("value", "\t")[0].cast("int").alias("i"), F.split("value", "\t")[1].alias("col"))
    cells = spark.read.text(f"{path}/X").select(F.split("value", "\t").alias("v")).select(F.col("v")[0].alias("row"), F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("i", "n"))
    return cells.join(heads, "i").select("row", "col", F.col("n").cast("long").alias("n"))


def compare(pred: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """Predicted against actual counts: exact, presence agreed on, over, under, and the median excess of those over."""
    p, a = F.col(predicted), F.col(actual)
    return pred.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(p == a).alias("exact"), F.count_if((p > 0) == (a > 0)).alias("presence"), F.count_if(p > a).alias("over"), F.count_if(p < a).alias("under"), F.median(F.when(p > a, p - a)).alias("median_over"))


def significant(pred: DataFrame, role: str, genome: str, predicted: str, actual: str) -> DataFrame:
    """Roles that differ from prediction: in how many genomes, and in what percentage of all."""
    all_ = pred.agg(F.count_distinct(genome).alias("_g"))
    return pred.where(F.col(predicted) != F.col(actual)).groupBy(role).agg(F.count_distinct(genome).alias("genomes")).crossJoin(F.broadcast(all_)).select(role, "genomes", (100 * F.col("genomes") / F.col("_g")).alias("percent"))


def universal(matrix: DataFrame, least: int) -> DataFrame:
    """(row, roles) of rows with at least that many columns of count exactly one."""
    return matrix.where("n = 1").groupBy("row").agg(F.count("*").alias("n_roles"), F.array_sort(F.collect_list("col")).alias("roles")).where(F.col("n_roles") >= least)


def interleave(df: DataFrame, is_positive: Column, order: str, ratio: int = 2) -> DataFrame:
    """df with seat: one positive, then up to `ratio` negatives, from the end of the order given; negatives beyond
    are left out."""
    flagged = df.withColumn("_p", is_positive)
    seated = tables.numbered(flagged, [F.desc("_p"), F.desc(order)], "_i").crossJoin(F.broadcast(flagged.agg(F.count_if("_p").alias("_first"))))
    seated = seated.withColumn("_i", F.col("_i") - 1 - F.when(F.col("_p"), 0).otherwise(F.col("_first"))).drop("_first").withColumn("_round", F.when(F.col("_p"), F.col("_i")).otherwise(F.floor(F.col("_i") / ratio)))
    rounds = flagged.where("_p").agg(F.count("*").alias("_rounds"))
    return seated.crossJoin(F.broadcast(rounds)).where("_round < _rounds").withColumn("seat", F.col("_round") * (ratio + 1) + F.when(F.col("_p"), 0).otherwise(F.col("_i") % ratio + 1)).drop("_p", "_i", "_round", "_rounds")
