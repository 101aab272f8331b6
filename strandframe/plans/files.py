"""Round trips of the given tables through the file formats, and streaming queries over them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import features, graph, kmers, matrix, signatures
from ..sources import files
from ..streaming import reads as streams
from .registry import QUERIES, SQL, query

LETTERS = "lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def folder(spark) -> str:
    """A new path in the shared folder."""
    return f"{graph.shared_folder(spark)}/files/{uuid.uuid4().hex}"


@query(f"SELECT doc_id::VARCHAR AS id, source || ' ' || lang AS comment, {LETTERS} AS seq FROM documents")
def s1_s14_fasta(t):
    d = t("documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("comment"), seq.normalize(F.col("text"), "letters").alias("seq"))
    path = folder(d.sparkSession)
    files.write_fasta(d, path)
    return files.read_fasta(d.sparkSession, path)


@query(f"SELECT conv_id || '.' || turn AS read_id, 1 AS mate, {LETTERS} AS seq, repeat('I', length({LETTERS})) AS qual FROM conversations WHERE {LETTERS} <> ''")
def s2_fastq(t):
    c = t("conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), seq.normalize(F.col("text"), "letters").alias("seq")).where("seq <> ''")
    path = folder(c.sparkSession)
    c.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(path)
    return files.read_fastq(c.sparkSession, path)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s3_table(t):
    c = t("customer").select("c_custkey", "c_name", "c_acctbal")
    path = folder(c.sparkSession)
    c.write.csv(path, sep="\t", header=True)
    return files.read_table(c.sparkSession, path, "c_custkey long, c_name string, c_acctbal double", header=True)


@query("""SELECT event_type AS type, user_id::VARCHAR AS id, 'c' || user_id % 7 AS contig, '+' AS strand, count(*) AS segments, min(event_id) AS first, array_to_string(list_sort(list(DISTINCT (event_id % 3)::VARCHAR)), ',') AS notes FROM events GROUP BY event_type, user_id""")
def s5_gff(t):
    e = t("events")
    path = folder(e.sparkSession)
    e.select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("user_id") % 7), F.lit("x"), "event_type", "event_id", F.col("event_id") + 5, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "user_id", F.lit(";Note="), F.col("event_id") % 3)).alias("value")).write.text(path)
    g = files.read_gff(e.sparkSession, path)
    return g.select("type", "id", "contig", "strand", F.size("segments").cast("long").alias("segments"), F.col("segments")[0]["left"].alias("first"), F.array_join(F.col("attributes")["Note"], ",").alias("notes"))


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS sid, round(o_totalprice / 10000, 3) AS pident, (o_orderkey % 100)::INT AS length FROM orders")
def s6_hits(t):
    o = t("orders")
    path = folder(o.sparkSession)
    o.select(F.concat_ws("\t", "o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 10000, 3), F.col("o_orderkey") % 100, *[F.lit("0")] * 8).alias("value")).write.text(path)
    return files.read_hits(o.sparkSession, path).select("qid", "sid", "pident", "length")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("SELECT l_suppkey::VARCHAR AS row, p_type AS col, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('" + "', '".join(TYPES) + "') GROUP BY ALL")
def s8_matrix_directory(t):
    m = matrix.role_counts(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "p_type").where(F.col("col").isin(TYPES))
    path = folder(m.sparkSession)
    matrix.to_directory(m, TYPES, path)
    return matrix.from_directory(m.sparkSession, path).where("n > 0")


@query(f"SELECT doc_id::VARCHAR AS genome_id, source AS name, lang AS domain, length({LETTERS})::BIGINT AS len, n_chars AS begin, 'PGF' || lang AS family FROM documents")
def s7_genome_objects(t):
    """A genome object for each document: a contig of its letters and a feature on it."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("id"), "source", "lang", "n_chars", seq.normalize(F.col("text"), "letters").alias("dna"))
    contig = F.struct(F.concat("id", F.lit("c")).alias("id"), "dna", F.lit(11).alias("genetic_code"))
    place = F.array(F.array(F.concat("id", F.lit("c")), F.col("n_chars").cast("string"), F.lit("+"), F.lit("9")))
    feature = F.struct(F.concat("id", F.lit("f")).alias("id"), F.lit("CDS").alias("type"), F.lit("role").alias("function"), F.lit("M").alias("protein_translation"), place.alias("location"), F.array(F.array(F.lit("PGF"), F.concat(F.lit("PGF"), "lang"), F.lit("role"), F.lit("1"))).alias("family_assignments"))
    path = folder(d.sparkSession)
    d.select("id", F.col("source").alias("scientific_name"), F.col("lang").alias("domain"), F.lit(11).alias("genetic_code"), F.array(contig).alias("contigs"), F.array(feature).alias("features")).write.json(path)
    genomes, contigs, found = files.read_genomes(d.sparkSession, path, multi_line=False)
    one = found.select("genome_id", F.col("location")[0]["begin"].alias("begin"), F.col("family")[0]["id"].alias("family"))
    return genomes.select("genome_id", "name", "domain").join(contigs.select("genome_id", "len"), "genome_id").join(one, "genome_id")


@query("SELECT i.item_id AS rep_id, length(i.text) AS seq_length, count(l.doc_id) AS members, sum(l.quality)::BIGINT AS score, 8 AS k, 100 AS threshold FROM benchmark i LEFT JOIN labels l ON l.doc_id = i.item_id GROUP BY ALL")
def s9_representative_db(t):
    """Saved and loaded again: items as representatives, the labels as members of the item with their number."""
    b = t("benchmark").select(F.col("item_id").alias("id"), F.lit("item").alias("name"), F.col("text").alias("seq"))
    path = folder(b.sparkSession)
    files.save_reps(path, b, t("labels").select(F.col("doc_id").alias("genome_id"), F.col("doc_id").alias("rep_id"), F.col("quality").alias("score")), 8, 100)
    reps, members, k, score = files.load_reps(b.sparkSession, path)
    sums = members.groupBy("rep_id").agg(F.count("*").alias("members"), F.sum("score").cast("long").alias("score"))
    return reps.select(F.col("id").alias("rep_id"), F.length("seq").alias("seq_length")).join(sums, "rep_id", "left").na.fill(0, ["members"]).withColumns({"k": F.lit(k), "threshold": F.lit(score)})


@query("SELECT replace(p_type, ' ', '_') AS role, count(*) FILTER (l_returnflag = 'R') AS predicted, count(*) FILTER (l_linestatus = 'F') AS actual FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def s12_report(t):
    """Reports written as aligned text with a heading, and read again."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.replace("p_type", F.lit(" "), F.lit("_")).alias("role")).agg(F.count_if(F.col("l_returnflag") == "R").alias("p"), F.count_if(F.col("l_linestatus") == "F").alias("a"))
    path = folder(rows.sparkSession)
    lines = rows.select(F.concat(F.lit("Role table\n"), F.rpad("role", 40, " "), F.lpad(F.col("p").cast("string"), 9, " "), F.lit("\t"), F.col("a").cast("string")).alias("value"))
    lines.write.text(path)
    return files.read_report(rows.sparkSession, path)


@query("SELECT conv_id::VARCHAR AS conv, count(*) AS turns, max(turn)::VARCHAR AS last FROM conversations GROUP BY conv_id")
def s10_s11_blocks(t):
    c = t("conversations")
    path = folder(c.sparkSession)
    lines = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("turn "), x.cast("string"))), "\n").alias("b"))
    lines.select(F.concat(F.lit("conv "), "conv_id", F.lit("\n"), "b", F.lit("\n//")).alias("value")).write.text(path)
    blocks = files.read_blocks(c.sparkSession, path)
    heads = files.extract_lines(blocks, "line", r"^conv (\d+)$", ["conv"], ["block"], ["pos"])
    last = files.extract_lines(blocks, "line", r"^turn (\d+)$", ["last"], ["block"], ["pos"])
    return heads.join(last, "block").join(blocks.where("line like 'turn%'").groupBy("block").agg(F.count("*").alias("turns")), "block").select("conv", "turns", "last")


@query("SELECT event_id, user_id::VARCHAR AS id, event_id AS \"left\", event_id + value::BIGINT AS \"right\" FROM events")
def s15_intervals(t):
    e = t("events").select("event_id", F.concat("user_id", F.when(F.col("event_id") % 2 == 0, F.concat_ws("-", F.concat(F.lit(":"), "event_id"), F.col("event_id") + F.rint("value").cast("long"))).otherwise(F.concat_ws("_", F.lit(""), F.col("event_id") + F.rint("value").cast("long"), "event_id"))).alias("text"))
    return e.select("event_id", *(c.alias(k) for k, c in features.parse_intervals(F.col("text")).items()))


@query("SELECT p_brand AS bin, count(*) AS n FROM part GROUP BY p_brand")
def s13_write_by_bin(t):
    p = t("part")
    path = folder(p.sparkSession)
    files.write_by(p.withColumn("bin", F.col("p_brand")), "bin", path)
    return p.sparkSession.read.parquet(path).groupBy("bin").agg(F.count("*").alias("n"))


def stream(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir): streams are opened by path."""
    def wrap(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return wrap


def opened(spark, sf_dir, table):
    """The table as a stream of files; a source must be a folder, so a table of one file is named by a pattern."""
    path = f"{sf_dir}/{table}.parquet"
    batch = spark.read.parquet(path)
    files_ = batch.select("_metadata.file_path").limit(1).collect()
    one = not files_ or files_[0].file_path.rstrip("/").endswith(f"/{table}.parquet")
    source = spark.readStream.schema(batch.schema)
    return source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if one else source.parquet(path)


@stream("x6_streaming_assignment", f"""WITH d AS (SELECT lang, {LETTERS} AS seq FROM documents), dk AS (SELECT lang, substr(seq, i::INT, 10) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 8)) AS i FROM d)), sig AS (SELECT kmer, min(lang) AS lang FROM dk GROUP BY kmer HAVING count(DISTINCT lang) = 1),
t AS (SELECT conv_id * 1000 + turn AS read_id, {LETTERS} AS seq FROM conversations), tk AS (SELECT read_id, substr(seq, i::INT, 10) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 8)) AS i FROM t)), h AS (SELECT read_id, lang, count(*) AS score FROM tk JOIN sig USING (kmer) GROUP BY ALL) SELECT * FROM h QUALIFY rank() OVER (PARTITION BY read_id ORDER BY score DESC) = 1""")
def x6_streaming_assignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", seq.normalize(F.col("text"), "letters").alias("seq"))
    index = graph.written(signatures.of_letters(docs, "lang", "seq", 10))
    turns = opened(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), seq.normalize(F.col("text"), "letters").alias("seq"))
    path = folder(spark)
    streams.assign_stream(turns, index, "read_id", "seq", "lang", 10, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("read_id", "lang", "score")


@stream("x7_streaming_windows", """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def x7_streaming_windows(spark, sf_dir):
    path = folder(spark)
    counts = streams.windowed_hits(opened(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(f"{path}/out").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@stream("x8_streaming_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS last FROM events GROUP BY user_id")
def x8_streaming_latest(spark, sf_dir):
    path = folder(spark)
    last = streams.latest(opened(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])

    def keep(df, number):
        df.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    last.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{path}/out")
    best = every.groupBy("user_id").agg(F.max_by(F.struct("event_type", "at"), F.col("batch")).alias("m"))
    return best.select("user_id", "m.event_type", F.col("m.at.event_id").alias("last"))
