"""Predictors of matrix columns, and classifiers on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, stats, tables


#: Columns of a matrix; each row's predictions are made from a broadcast list of them.
MOST_COLUMNS = 200_000


def column_predictors(matrix: DataFrame, folds: int = 5, smoothing: float = 1.0) -> DataFrame:
    """(col, fold, n, accuracy): naive Bayes predictors of each column's presence from the presence of the others.

    A row's fold is its hash; what a fold is tested with is learned from the rows outside it. The odds of y are its smoothed
    share of rows, times, for each other column x, the smoothed share of y's rows with x over the share of all rows with x
    if the row has x, and the shares without x if not. y is predicted where the odds are over 1.

    For columns that never come together these terms are a number of y and one of x, so all columns start from sums, and
    only pairs that do come together are corrected: there is no table of columns by columns. Rows without such a pair are
    judged by the sums alone, from a list of all columns that goes to every task (MOST_COLUMNS at most)."""
    s = F.lit(float(smoothing))
    cells = matrix.where("n > 0").select("row", "col").distinct()
    placed = graph.written(cells.withColumn("fold", tables.share(1, "row", parts=folds).cast("int")))
    rows = placed.select("row", "fold").distinct()
    each = F.sequence(F.lit(0), F.lit(folds - 1))

    def outside(by: DataFrame, keys: list[str]) -> DataFrame:
        """For each key and fold the count of the rows outside the fold; by: (keys, fold, c)."""
        spread = by.groupBy(*keys).agg(F.sum("c").alias("_all"), F.map_from_entries(F.collect_list(F.struct("fold", "c"))).alias("_by"))  # an entry a fold
        one = spread.select(*keys, "_all", "_by", F.explode(each).alias("fold"))
        return one.select(*keys, "fold", (F.col("_all") - F.coalesce(F.try_element_at("_by", F.col("fold")), F.lit(0))).alias("c"))

    n = outside(rows.groupBy("fold").agg(F.count("*").alias("c")).withColumn("_k", F.lit(1)), ["_k"]).select("fold", F.col("c").alias("n"))
    single = graph.written(outside(placed.groupBy("col", "fold").agg(F.count("*").alias("c")), ["col"]).join(F.broadcast(n), "fold"))
    ny = F.col("c") + s
    q = (F.col("c") + s) / (F.col("n") + 2 * s)
    terms = single.select(
        "fold", "col", F.col("c").alias("ny"), F.log(ny / (F.col("n") - F.col("c") + s)).alias("prior"), F.log(ny / (F.col("c") + 2 * s)).alias("none"), F.log(s / ny).alias("u"),
        F.log(q / (1 - q)).alias("v"), F.log(1 - q).alias("l"),
    )
    sums = terms.groupBy("fold").agg(F.count("*").alias("_m"), F.sum("l").alias("_l"))
    pairs = placed.select("row", "fold", F.col("col").alias("y")).join(placed.select("row", F.col("col").alias("x")), "row").where("x <> y").groupBy("y", "x", "fold").agg(F.count("*").alias("c"))
    seen = graph.written(outside(pairs, ["y", "x"]).where("c > 0").join(terms.select("fold", F.col("col").alias("y"), "ny"), ["fold", "y"]))
    absent = F.log((F.col("ny") + s - F.col("c")) / (F.col("ny") + s))
    present = F.log((F.col("c") + s) / (F.col("ny") + s - F.col("c"))) - F.log(s / (F.col("ny") + s))
    base = terms.join(F.broadcast(sums), "fold").join(seen.groupBy("fold", F.col("y").alias("col")).agg(F.sum(absent).alias("_seen")), ["fold", "col"], "left")
    base = base.select("fold", "col", "u", "v", (F.col("prior") + (F.col("_m") - 1) * F.col("none") - (F.col("_l") - F.col("l")) + F.coalesce("_seen", F.lit(0.0))).alias("base"))
    base = graph.written(base)
    if base.count() > folds * MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    # what a row has by its own columns: k, the number, and t, the sum of their v
    own = graph.written(placed.join(base.select("fold", "col", "v"), ["fold", "col"]).groupBy("row", "fold").agg(F.count("*").alias("k"), F.sum("v").alias("t")))
    lists = base.groupBy("fold").agg(F.collect_list(F.struct("col", "u", "base")).alias("_cols"))
    by_sums = own.join(F.broadcast(lists), "fold").select("fold", "k", "t", F.explode("_cols").alias("y"))
    wrong_alone = (F.col("y.base") + F.col("k") * F.col("y.u") - F.col("t") > 0).cast("long")
    alone = by_sums.groupBy("fold", F.col("y.col").alias("col")).agg(F.count("*").alias("n"), F.sum(1 - wrong_alone).alias("hits"))
    # pairs of row and column that sums don't settle: the column is there, or comes with one of the row's
    votes = placed.select("row", "fold", F.col("col").alias("x")).join(seen.select("fold", "x", "y", present.alias("w")), ["fold", "x"]).groupBy("row", "fold", F.col("y").alias("col")).agg(F.sum("w").alias("w"))
    odd = votes.join(placed.withColumn("has", F.lit(True)), ["row", "fold", "col"], "full").join(own, ["row", "fold"]).join(base, ["fold", "col"])
    has = F.coalesce("has", F.lit(False))
    plain = F.col("base") + F.col("k") * F.col("u") - F.col("t")
    full = plain - F.when(has, F.col("u") - F.col("v")).otherwise(0.0) + F.coalesce("w", F.lit(0.0))
    change = odd.select("fold", "col", (((full > 0) == has).cast("long") - (plain <= 0).cast("long")).alias("d")).groupBy("fold", "col").agg(F.sum("d").alias("d"))
    hits = F.col("hits") + F.coalesce("d", F.lit(0))
    return alone.join(change, ["fold", "col"], "left").select("col", "fold", "n", (100 * hits / F.col("n")).alias("accuracy"))


def accuracy_summary(folds: DataFrame) -> DataFrame:
    """Mean, quartiles, trimean and interquartile range of each column's fold accuracies."""
    return stats.summary5(folds, ["col"], "accuracy").join(folds.groupBy("col").agg(F.avg("accuracy").alias("mean")), "col")


def sweep_summary(sweeps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, q0 to q4, trimean, iqr) of the accuracies of repeated hold-outs, in percent with two decimals: the
    quartiles are the values at n/4, n/2 and n/4 from the end of the sorted ones. Sweeps are few, so each key sorts its own."""
    acc = sweeps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.round("accuracy", 2))).alias("_a"), F.round(F.avg(F.round("accuracy", 2)), 2).alias("mean"))
    quarter, n = F.floor(F.size("_a") / 4).cast("int"), F.size("_a")
    q = {"q0": F.lit(0), "q1": quarter, "q2": F.floor(n / 2).cast("int"), "q3": n - 1 - quarter, "q4": n - 1}
    out = acc.select(*keys, "mean", *(F.get("_a", i).alias(name) for name, i in q.items()))
    return out.withColumns({"trimean": (F.col("q1") + 2 * F.col("q2") + F.col("q3")) / 4, "iqr": F.col("q3") - F.col("q1")})


def select_roles(summary: DataFrame, least: float = 93, iqr: float = 5) -> DataFrame:
    return summary.where((F.col("trimean") >= least) & (F.col("iqr") <= iqr))


def train(df: DataFrame, features: list[str], label: str, kind: str = "logistic"):
    """A fitted pyspark.ml pipeline: logistic regression, random forest or decision tree."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    learner = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "tree": DecisionTreeClassifier}[kind]
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), learner(featuresCol="_features", labelCol=label)]).fit(df)


def apply(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("_features", "rawPrediction", "probability")


def holdout(df: DataFrame, features: list[str], label: str, key: str, sweeps: int = 3, fraction: float = 0.2, kind: str = "logistic") -> DataFrame:
    """(sweep, n, accuracy): repeated hold-outs, the rows of each chosen by the key's hash."""
    out = []
    for sweep in range(sweeps):
        test, rest = tables.split(df, key, fraction, seed=sweep)
        done = apply(train(rest, features, label, kind), test)
        out.append(done.agg(F.lit(sweep).alias("sweep"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")))
    return tables.merge(*out)


