"""Relational shapes: sets, ranks, neighbours, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph


def unnest_set(df: DataFrame, col: str, key: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """Distinct comma sets with a key (a hash of the set, so no global numbering is needed), and their members."""
    with_key = df.withColumn(key, F.xxhash64(col))
    members = with_key.where(F.col(col).isNotNull()).select(key, col).distinct().select(key, F.explode(F.array_distinct(F.transform(F.split(col, ","), F.trim))).alias("member"))
    return with_key.drop(col), members


def param_grid(spark, values: dict[str, list]) -> DataFrame:
    """Every combination of the parameters' values (small lists given by the caller)."""
    parts = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def within_sigma(df: DataFrame, domain: str, value: str, k: float = 3) -> DataFrame:
    """Rows within k sample deviations of their domain's mean."""
    range_ = df.groupBy(domain).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    return df.join(range_, domain).where(F.abs(F.col(value) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")


def complete_in_all(df: DataFrame, key: str, set_id: str) -> DataFrame:
    """Rows whose key occurs in every set."""
    sets = df.agg(F.count_distinct(set_id).alias("_sets"))
    full = df.groupBy(key).agg(F.count_distinct(set_id).alias("_n")).crossJoin(sets).where("_n = _sets").select(key)
    return df.join(full, key, "left_semi")


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return top_k(df, keys, 1, *order)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key in the order given, which should be total."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of all in an order that should be total: each task keeps its own first n, which are then merged."""
    return df.orderBy(*order).limit(n)


def rank_compare(df: DataFrame, keys: list[str], id_col: str, a: str, b: str) -> DataFrame:
    """Ranks by two scores, descending, and their difference."""
    w = W.partitionBy(*keys)
    ranks = {"rank_a": F.row_number().over(w.orderBy(F.desc(a), id_col)), "rank_b": F.row_number().over(w.orderBy(F.desc(b), id_col))}
    return df.withColumns(ranks).withColumn("rank_diff", F.col("rank_a") - F.col("rank_b"))


def weighted_best(df: DataFrame, query: str, target: str, weight: str, *order: Column) -> DataFrame:
    """Each query's best hit takes its whole weight: the sum for each target."""
    return best_per_key(df, [query], *order).groupBy(target).agg(F.sum(weight).alias("total"), F.count("*").alias("queries"))


def split(df: DataFrame, key: str, fraction: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A repeatable split by the hash of a key: about fraction of the keys, and the rest."""
    first = share(seed, key) < int(fraction * 10_000)
    return df.where(first), df.where(~first)


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    return best_per_key(df, [key], F.col(order))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def merge(*dfs: DataFrame) -> DataFrame:
    """Union of inputs with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common_prefix(df: DataFrame, key: str, items: str) -> DataFrame:
    """The longest prefix that all of a key's lists share, and its length."""
    long = df.select(key, F.posexplode(items).alias("_i", "_x"))
    lists = df.groupBy(key).agg(F.count("*").alias("_lists"))
    same = long.groupBy(key, "_i").agg(F.count("*").alias("_n"), F.min("_x").alias("_x"), F.max("_x").alias("_y")).join(lists, key).where("_n = _lists and _x = _y")
    w = W.partitionBy(key).orderBy("_i")
    kept = same.withColumn("_row", F.row_number().over(w) - 1).where("_row = _i")
    found = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("prefix"))
    return lists.join(found, key, "left").select(key, F.coalesce("prefix", F.array().cast("array<string>")).alias("prefix"), F.coalesce(F.size("prefix"), F.lit(0)).alias("n_prefix"))


def set_ops(a: Column, b: Column) -> dict[str, Column]:
    return {"union": F.array_sort(F.array_union(a, b)), "intersection": F.array_sort(F.array_intersect(a, b)), "difference": F.array_sort(F.array_except(a, b))}


def pivot_fixed(df: DataFrame, row: str, col: str, columns: list[str], value: Column) -> DataFrame:
    """Counts or sums in long form to one column each, in the order given, 0 where there is none."""
    return df.groupBy(row).pivot(col, columns).agg(value).na.fill(0)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the number of each row, from 1 on, in an order over all rows: sorted by ranges, numbered within each, and
    moved on by the sizes of the ranges before. The sorted rows are written, so both readings see the same ranges."""
    placed = graph.written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1).drop("_at", "_part", "_before")


def running(df: DataFrame, keys: list[str], order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """df with, for each name of weights, the sum of its weight over the rows of the same keys that come before in order
    (name), and over all rows of the keys (name_all). The order should be total; null weights add nothing.

    Rows are sorted by ranges over keys and order, so that a key of any size is dealt out over many tasks; sums run within
    a range and are moved on by those of the key's ranges before, of which there is one row a range."""
    sums = {f"_w{i}": w for i, w in enumerate(weights.values())}
    by = [F.col(f"`{k}`") for k in keys]
    sorted_ = df.withColumns(sums).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = graph.written(sorted_.withColumn("_order_at", F.monotonically_increasing_id())).withColumn("_order_part", F.shiftright("_order_at", 33))
    each = placed.groupBy(*keys, "_order_part").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_s{c}") for c in sums))
    w = W.partitionBy(*keys)
    earlier = w.orderBy("_order_part").rowsBetween(W.unboundedPreceding, -1)
    moved = each.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_order_part").alias("_p"), *(F.coalesce(F.sum(f"_s{c}").over(earlier), F.lit(0)).alias(f"_b{c}") for c in sums), *(F.sum(f"_s{c}").over(w).alias(f"_t{c}") for c in sums))
    here = W.partitionBy(*keys, "_order_part").orderBy("_order_at").rowsBetween(W.unboundedPreceding, -1)
    within = placed.withColumns({f"_r{c}": F.coalesce(F.sum(c).over(here), F.lit(0)) for c in sums})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = within.join(moved, reduce(lambda a, b: a & b, same, F.col("_order_part") == F.col("_p")))
    out = {}
    for c, name in zip(sums, weights, strict=True):
        out |= {name: (F.col(f"_r{c}") + F.col(f"_b{c}")).alias(name), f"{name}_all": F.col(f"_t{c}").alias(f"{name}_all")}
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in out), *out.values())


def carried(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """df with value replaced by the last one of the same keys, up to the row itself in order, that isn't null. As in
    running(), rows are sorted by ranges, so a key or position of any size is dealt out if the order tells its rows apart."""
    by = [F.col(f"`{k}`") for k in keys]
    placed = graph.written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_order_at", F.monotonically_increasing_id())).withColumn("_order_part", F.shiftright("_order_at", 33))
    each = placed.groupBy(*keys, "_order_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_order_at"))).alias("_last"))
    before = each.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_order_part").alias("_p"), F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_order_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    here = placed.withColumn("_here", F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "_order_part").orderBy("_order_at").rowsBetween(W.unboundedPreceding, 0)))
    on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_order_part") == F.col("_p"))
    return here.join(before, on).select(*(F.coalesce("_here", "_before").alias(c) if c == value else F.col(f"`{c}`") for c in df.columns))


def grid_counts(df: DataFrame, grid: dict[str, list]) -> DataFrame:
    """For every combination of the grid's values, the rows whose columns all are at least the values: (columns, n).

    A row goes to the highest values that it reaches, rows of one corner are counted, and each corner's count is added to
    the combinations below it; so rows never meet the grid. Nulls reach no value."""
    values = {c: sorted(set(vs)) for c, vs in grid.items()}
    reached = {f"_{c}": sum((F.when(F.col(c) >= v, 1).otherwise(0) for v in vs), F.lit(0)) for c, vs in values.items()}
    cells = df.select(*(r.alias(c) for c, r in reached.items())).groupBy(*reached).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    none = reduce(lambda d, c: d.withColumn(c, F.lit(len(values[c[1:]]))), reached, spark.range(1).select(F.lit(0).cast("long").alias("n")))
    out = cells.unionByName(none)  # combinations without rows are there with 0
    for c, vs in values.items():
        out = out.withColumn(c, F.explode(F.slice(F.array(*map(F.lit, vs)), 1, F.col(f"_{c}"))))
    return out.groupBy(*values).agg(F.sum("n").alias("n"))


def dealt(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, fine: int | None = None, least: int = 20_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equality join on key, and the columns to join on, such that a key with very many rows is dealt out:
    its rows of each side are split by their ids, and each split meets all splits of the other side.

    Keys with over 1/fine of a side's rows are split (fine: four times the number of shuffle partitions, at least 1000), if
    that is over `least` rows, into parts of that size; they are told by a count over one row in 16, which only decides about
    the plan, not the result. So fewer than 2 * fine keys are broadcast, whatever the input's size. Both sides should be
    written tables."""
    fine = fine or max(1000, 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def heavy(df: DataFrame, by: str, name: str) -> DataFrame:
        n = df.where(F.pmod(F.xxhash64(key, by), F.lit(16)) == 0).groupBy(key).agg(F.count("*").alias("_n"))
        part = max((n.agg(F.sum("_n")).first()[0] or 0) / fine, least / 16)
        return n.where(F.col("_n") > part).select(key, F.ceil(F.col("_n") / F.lit(part)).cast("int").alias(name))

    hot = graph.written(heavy(left, left_id, "_l").join(heavy(right, right_id, "_r"), key, "full").na.fill(1, ["_l", "_r"]))
    if hot.isEmpty():
        return left, right, [key]

    def split(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        n = df.join(F.broadcast(hot), key, "left")
        own_part = F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1))).cast("int")
        return n.withColumns({f"{own}_part": own_part, f"{other}_part": F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("_l", "_r")

    return split(left, left_id, "_l", "_r"), split(right, right_id, "_r", "_l"), [key, "_l_part", "_r_part"]


def share(seed: int, *cols, parts: int | Column = 10_000) -> Column:
    """A number below parts for each row, told by an md5 of the seed and the columns: the same in any engine and run."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % parts


def group_rows(df: DataFrame, partition: str, order: list[str], key: str, name: str = "run") -> DataFrame:
    """df with the number of the run each row is in: a new run begins where the key changes in the order given."""
    w = W.partitionBy(partition).orderBy(*order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
