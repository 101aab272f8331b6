"""Readers and writers of sequence files and reports. All are ordinary Spark file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph

HITS = "qid string, sid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"

GENOME = """id string, scientific_name string, domain string, genetic_code int,
contigs array<struct<id string, dna string, genetic_code int>>,
features array<struct<id string, type string, function string, protein_translation string,
location array<array<string>>, family_assignments array<array<string>>>>"""


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, comment, seq): the header's first word, the rest of it, and the sequence without white space."""
    record = F.regexp_replace("value", "^>|\r", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    out = spark.read.option("lineSep", "\n>").text(path).select(record.alias("r"), head.alias("h"))
    return out.where(F.trim("r") != "").select(F.regexp_extract("h", r"^\s*(\S*)", 1).alias("id"), F.trim(F.regexp_replace("h", r"^\s*\S*", "")).alias("comment"), F.regexp_replace(F.substring(F.col("r"), F.length("h") + 1, F.length("r")), r"\s", "").alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value), lines counted from 0 in each file, also where a file is read in several blocks.

    Rows of a block come in order, so their number is the row id's distance from the block's first, after the lines
    of the file's blocks before it. Only block counts are gathered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.withColumn("_before", before), ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def read_fastq(spark: SparkSession, left: str, right: str | None = None, interlaced: bool = False) -> DataFrame:
    """(read_id, mate, seq, qual): four lines a record; mates from a second file, or every other record."""
    def records(path: str) -> DataFrame:
        rows = numbered_lines(spark, path).withColumns({"record": F.floor(F.col("line") / 4), "_k": F.col("line") % 4})
        one = {n: F.max(F.when(F.col("_k") == k, F.col("value"))) for k, n in ((0, "head"), (1, "seq"), (3, "qual"))}
        return rows.groupBy("file", "record").agg(*(c.alias(n) for n, c in one.items())).where("seq is not null and qual is not null").withColumn("read_id", F.regexp_extract("head", r"^@?(\S+?)(?:/[12])?(?:\s|$)", 1))

    first = records(left)
    if interlaced:
        return first.select("read_id", (F.col("record") % 2 + 1).cast("int").alias("mate"), "seq", "qual")
    out = first.select("read_id", F.lit(1).alias("mate"), "seq", "qual")
    return out if right is None else out.unionByName(records(right).select("read_id", F.lit(2).alias("mate"), "seq", "qual"))


def read_table(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, sep=sep, schema=schema, header=header, quote="", escape="")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, contig, strand, segments, attributes): lines of one id become one feature, their segments in order
    and values of each key together; features whose lines disagree in contig or strand are left out."""
    cols = "contig string, source string, type string, left long, right long, score string, strand string, frame string, attributes string"
    lines = spark.read.csv(path, sep="\t", schema=cols, comment="#", quote="", escape="").where("left is not null")
    pairs = F.filter(F.split("attributes", ";"), lambda x: F.contains(x, F.lit("=")))
    named = lines.withColumn("_p", pairs).withColumn("id", F.url_decode(F.regexp_extract("attributes", r"(?:^|;)\s*ID=([^;]*)", 1)))
    whole = named.groupBy("type", "id").agg(F.count_distinct("contig", "strand").alias("_n"), F.min("contig").alias("contig"), F.min("strand").alias("strand"), F.array_sort(F.collect_list(F.struct("left", "right"))).alias("segments")).where("_n = 1").drop("_n")
    values = named.select("type", "id", F.explode("_p").alias("p")).select("type", "id", F.trim(F.substring_index("p", "=", 1)).alias("key"), F.explode(F.split(F.expr("substring(p, instr(p, '=') + 1)"), ",")).alias("v"))
    kept = values.groupBy("type", "id", "key").agg(F.array_sort(F.collect_set(F.url_decode("v"))).alias("v")).groupBy("type", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("attributes"))
    return whole.join(kept, ["type", "id"])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular hits of twelve columns."""
    return spark.read.csv(path, sep="\t", schema=HITS, comment="#")


def read_genomes(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genome objects (one JSON document a file, or one a line) as genomes, contigs and features."""
    objects = spark.read.schema(GENOME).json(path, multiLine=multi_line)
    genomes = objects.select(F.col("id").alias("genome_id"), F.col("scientific_name").alias("name"), "domain", "genetic_code")
    contigs = objects.select(F.col("id").alias("genome_id"), F.explode("contigs").alias("c")).select("genome_id", F.col("c.id").alias("contig_id"), "c.dna", F.length("c.dna").cast("long").alias("len"))
    location = F.transform("f.location", lambda r: F.struct(r[0].alias("contig"), r[1].cast("long").alias("begin"), r[2].alias("strand"), r[3].cast("long").alias("len")))
    family = F.transform("f.family_assignments", lambda r: F.struct(r[0].alias("db"), r[1].alias("id"), r[2].alias("function"), r[3].alias("version")))
    features = objects.select(F.col("id").alias("genome_id"), F.explode("features").alias("f")).select("genome_id", F.col("f.id").alias("fid"), "f.type", "f.function", "f.protein_translation", location.alias("location"), family.alias("family"))
    return genomes, contigs, features


def read_blocks(spark: SparkSession, path: str, sep: str = "//") -> DataFrame:
    """(block, pos, line): records that end with a line of the separator. A block is named by a hash of its file and of its
    place among the records that a task reads, so equal records are blocks of their own; the names hold for one reading,
    which is written, as a second one may be split otherwise."""
    read = spark.read.option("lineSep", f"\n{sep}\n").text(path)
    named = read.select(F.regexp_replace("value", f"\n?{sep}\n?$", "").alias("b"), F.xxhash64(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("block"))
    blocks = graph.written(named.where(F.trim("b") != ""))
    return blocks.select("block", F.posexplode(F.split("b", "\n")).alias("pos", "line"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(role, predicted, actual) of evaluation reports: lines of a name and two counts set apart by white space; headings
    and other lines are passed over."""
    pattern = r"^\s*(\S+)\s+(\d+)\s+(\d+)\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("role"), *(F.regexp_extract("value", pattern, i).cast("long").alias(n) for i, n in ((2, "predicted"), (3, "actual"))))


def extract_lines(df: DataFrame, line: str, pattern: str, names: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """The groups of a pattern in matching lines; of a key's lines the last in the order given."""
    found = df.where(F.col(line).rlike(pattern)).withColumns({n: F.regexp_extract(line, pattern, i + 1) for i, n in enumerate(names)})
    rest = [n for n in names if n not in keys]
    return found.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(*keys, *(F.col(f"_m.{n}").alias(n) for n in rest))


def write_by(df: DataFrame, key: str, path: str) -> None:
    """One folder for each value of the key."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def write_fasta(df: DataFrame, path: str, id_col: str = "id", comment: str | None = "comment", seq: str = "seq", width: int = 60) -> None:
    """Records of a header and the sequence in lines of a fixed width, as text files."""
    head = F.concat(F.lit(">"), F.col(id_col).cast("string"), F.when(F.col(comment) != "", F.concat(F.lit(" "), comment)).otherwise("") if comment else F.lit(""))
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat_ws("\n", head, body).alias("value")).write.mode("overwrite").text(path)


def annotate_fasta(seqs: DataFrame, names: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """Sequences with the master table's name as comment, and whether it knows the id."""
    known = names.select(F.col(id_col), F.col(name).alias("_name"), F.lit(True).alias("_known")).dropDuplicates([id_col])
    return seqs.join(known, id_col, "left").withColumns({"comment": F.coalesce("_name", "comment"), "found": F.coalesce("_known", F.lit(False))}).drop("_name", "_known")


def save_reps(path: str, reps: DataFrame, members: DataFrame, k: int, score: int) -> None:
    """A representative database: reps (id, name, seq), members (genome_id, rep_id, score), and its parameters."""
    spark = reps.sparkSession
    reps.where("name is not null").write.mode("overwrite").parquet(f"{path}/reps")  # sequences without a name are left out
    members.write.mode("overwrite").parquet(f"{path}/members")
    spark.createDataFrame([(k, score)], "k int, score int").write.mode("overwrite").parquet(f"{path}/parameters")


def load_reps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int, int]:
    """What save_reps wrote."""
    p = spark.read.parquet(f"{path}/parameters").first()
    return spark.read.parquet(f"{path}/reps"), spark.read.parquet(f"{path}/members"), p.k, p.score

