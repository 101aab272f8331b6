"""Quality gates and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, tables

#: Cut-offs in use: fine consistency, completeness, contamination. They differ by source, so all are offered.
PRESETS = {"package": (85, 80, 15), "reps": (85, 80, 10), "good": (87, 80, 10)}


def gate(fine: Column, complete: Column, contamination: Column, seed: Column, preset: str = "package") -> Column:
    f, c, x = PRESETS[preset]
    return (fine >= f) & (complete >= c) & (contamination <= x) & seed


def tier(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "H").when(value >= medium, "M").otherwise("L")


def reasons(fine: Column, complete: Column, contamination: Column, good: Column, preset: str = "package") -> dict[str, Column]:
    """Why a row isn't good; `other` where no figure says so."""
    f, c, x = PRESETS[preset]
    flags = {"inconsistent": fine < f, "incomplete": complete < c, "contaminated": contamination > x}
    return {k: ~good & v for k, v in flags.items()} | {"other": ~good & ~(flags["inconsistent"] | flags["incomplete"] | flags["contaminated"])}


def sample_gate(df: DataFrame, spots: str, bases: str, least_spots: float, least_bases: float, ratio: tuple[float, float]) -> DataFrame:
    """df with reason: ok, or the first test a sample fails."""
    r = F.col(bases) / F.col(spots)
    return df.withColumn("reason", F.when(F.col(spots) < least_spots, "spots").when(F.col(bases) < least_bases, "bases").when((r < ratio[0]) | (r > ratio[1]), "ratio").otherwise("ok"))


def seed_gate(df: DataFrame, genome: str, length: str, low: float, high: float) -> DataFrame:
    """Genomes with exactly one seed sequence, of a length in range."""
    return df.groupBy(genome).agg(F.count("*").alias("_n"), F.min(length).alias(length)).where((F.col("_n") == 1) & F.col(length).between(low, high)).drop("_n")


def consistency(features: DataFrame, evaluation: DataFrame, contig: str, feature: str, role: str) -> DataFrame:
    """For each contig: features with a problem role (predicted <> actual), with a good one, and without any."""
    state = evaluation.select(role, (F.col("predicted") == F.col("actual")).alias("_good"))
    return features.join(state, role, "left").groupBy(contig).agg(*(F.count_distinct(F.when(c, F.col(feature))).alias(n) for n, c in (("good", F.col("_good")), ("bad", ~F.col("_good")), ("unrated", F.col("_good").isNull()))))


def clean_contigs(contigs: DataFrame, features: DataFrame, evaluation: DataFrame, contig: str, role: str, coarse: bool = False) -> DataFrame:
    """Contigs with at least one good role; coarse: present where predicted is enough."""
    ok = ((F.col("predicted") > 0) & (F.col("actual") > 0)) if coarse else F.col("predicted") == F.col("actual")
    return contigs.join(features.join(evaluation.where(ok), role, "left_semi"), contig, "left_semi")


def thin_features(df: DataFrame, key: str, percent: float, seed: int = 1) -> DataFrame:
    """Without about that percentage of the rows, chosen by the key's hash."""
    return df.where(tables.share(seed, key) >= int(percent * 100))


def merge(base: DataFrame, scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns of scores where it has a row, else its own; scores above 100 are no scores."""
    new = scores.where(" and ".join(f"coalesce({c}, 0) <= 100" for c in columns)).select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that both have, with the change."""
    return old.where(F.col(value).isNotNull()).select(key, F.col(value).alias("old")).join(new.where(F.col(value).isNotNull()).select(key, F.col(value).alias("new")), key).withColumn("change", F.col("new") - F.col("old"))


def relabel(report: DataFrame, log: DataFrame, order: str, line: str, bin_col: str, sample: str, name: str, ref_name: str, kind: str = "fine") -> DataFrame:
    """report with the sample and reference name of bins that a log says were derived from others: a bin in a line "Creating
    new GenomePackage <bin>" gets the sample of the bin in the last "Processing <bin>" before it, as it is by then, and that
    bin's name with the kind of trimming. Of several such lines of a bin the last holds. Lines are in order, which must
    tell them apart; bins that the report doesn't have change nothing, bins may be derived from derived ones."""
    at = F.col(order).alias("_at")
    source = F.nullif(F.regexp_extract(line, r"^Processing (\d+\.\d+)", 1), F.lit(""))
    made = F.nullif(F.regexp_extract(line, r"^Creating new GenomePackage (\d+\.\d+)", 1), F.lit(""))
    lines = log.select(at, source.alias("_source"), made.alias("_new")).where("_source is not null or _new is not null")
    events = graph.written(tables.carried(lines, [], [F.col("_at")], "_source").where("_new is not null and _source is not null"))
    bins = report.select(F.col(bin_col).cast("string").alias("_b"))
    events = events.join(bins.withColumnRenamed("_b", "_new"), "_new", "left_semi").join(bins.withColumnRenamed("_b", "_source"), "_source", "left_semi")
    # what each event found: the last event before it that had made its source
    asked = events.select(F.col("_source").alias("_bin"), "_at", F.lit(0).alias("_q"), F.lit(None).cast("long").alias("_up"))
    given = events.select(F.col("_new").alias("_bin"), "_at", F.lit(1).alias("_q"), F.col("_at").cast("long").alias("_up"))
    found = tables.carried(asked.unionByName(given), ["_bin"], [F.col("_at"), F.col("_q")], "_up").where("_q = 0").select("_at", "_up")
    state = graph.written(events.join(found, "_at").select(F.col("_at").cast("long").alias("_at"), "_new", "_source", "_up", F.col("_source").alias("_root")))
    while not state.where("_up is not null").isEmpty():  # doubling: the root is the source of the first event of a chain
        above = state.select(F.col("_at").alias("_up"), F.col("_up").alias("_next"), F.col("_root").alias("_top"))
        state = graph.written(state.join(above, "_up", "left").select("_at", "_new", "_source", F.col("_next").alias("_up"), F.coalesce("_top", "_root").alias("_root")))
    last = state.groupBy("_new").agg(F.max_by(F.struct("_source", "_root"), "_at").alias("_e")).select("_new", "_e._source", "_e._root")
    names = report.select(F.col(bin_col).cast("string").alias("_source"), F.col(name).alias("_name"))
    samples = report.select(F.col(bin_col).cast("string").alias("_root"), F.col(sample).alias("_sample"))
    fixes = last.join(names, "_source").join(samples, "_root").select("_new", F.concat("_name", F.lit(f" ({kind}-trimmed)")).alias("_name"), "_sample", F.lit(True).alias("_hit"))
    out = report.join(fixes, report[bin_col].cast("string") == fixes["_new"], "left")
    new = {sample: F.when(F.col("_hit"), F.col("_sample")).otherwise(F.col(sample)), ref_name: F.when(F.col("_hit"), F.col("_name")).otherwise(F.col(ref_name))}
    return out.withColumns(new).select(*report.columns)
