"""Further operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import align, features, kmers, ml, reads, reps, tables
from ..sources import files
from . import similarity as sim
from .matrices import lines
from .registry import query
from .sequences import turns

BEST = sim.BEST


def members(t):
    return reps.find(sim.doc_scores(t), "doc_id", "item_id")


BEST_OF = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1"
REFINE = f"""WITH RECURSIVE {sim.SCORES[5:]}, {sim.PAIRS[len("WITH " + sim.ITEMS + ", ") :]}, o AS (SELECT item_id AS node, row_number() OVER (ORDER BY -length(text), item_id) AS i FROM benchmark),
n AS (SELECT i, node, list(b) FILTER (b IS NOT NULL) AS near FROM o LEFT JOIN (FROM p WHERE score >= 8) ON a = node GROUP BY ALL),
w AS (SELECT 0::BIGINT AS i, [NULL::BIGINT] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, coalesce(n.near, [])) THEN w.kept ELSE list_append(w.kept, n.node) END FROM w JOIN n ON n.i = w.i + 1),
b0 AS (SELECT s.* FROM s WHERE item_id IN (SELECT unnest(kept) FROM w WHERE i = (SELECT max(i) FROM w)) {BEST_OF}),
b1 AS (SELECT s.* FROM s JOIN (SELECT doc_id, item_id FROM b0 UNION SELECT doc_id, p.b FROM b0 JOIN p ON p.a = item_id WHERE p.score >= 8) USING (doc_id, item_id) {BEST_OF}),
b2 AS (SELECT s.* FROM s JOIN (SELECT doc_id, item_id FROM b1 UNION SELECT doc_id, p.b FROM b1 JOIN p ON p.a = item_id WHERE p.score >= 16) USING (doc_id, item_id) {BEST_OF})"""


@query(f"{REFINE} SELECT doc_id, item_id, score FROM b2")
def k11_closest_refine(t):
    scores = sim.doc_scores(t)
    return reps.closest_refine(scores, sim.item_pairs(t), sim.item_nodes(t), "doc_id", "item_id", [8, 16])


@query(f"{sim.SCORES}, {BEST} SELECT doc_id, item_id, score FROM b WHERE score >= 20 AND (score >= 60 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def r6_update(t):
    found = members(t)
    return reps.update(found.where("score >= 60"), sim.doc_scores(t), "doc_id", "item_id", least=20, skip=t("labels").where("toxic = 1"))


@query(f"{sim.SCORES}, {BEST}, c AS (SELECT s.item_id AS query, b.item_id AS rep, b.doc_id AS member, s2.score FROM (SELECT DISTINCT item_id FROM s) s JOIN b ON b.item_id = s.item_id JOIN s s2 ON s2.item_id = s.item_id AND s2.doc_id = b.doc_id) SELECT query, member, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, member) AS rank FROM c QUALIFY rank <= 3")
def r8_closest_members(t):
    m = members(t).select(F.col("item_id").alias("rep"), F.col("doc_id").alias("member"))
    close = m.select(F.col("rep").alias("query"), "rep", F.lit(99).alias("score")).distinct()
    scores = sim.doc_scores(t).select(F.col("item_id").alias("query"), F.col("doc_id").alias("member"), "score")
    return reps.closest_members(close, m, scores, "query", "rep", "member", 3).select("query", "member", "score", "rank")


@query(f"{sim.SCORES}, {BEST}, r AS (SELECT item_id AS rep, -item_id - 1 AS member, NULL::BIGINT AS score, 0 AS position FROM benchmark UNION ALL SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) FROM b) SELECT rep, member, score, position, coalesce(source, '<unknown>') AS name FROM r LEFT JOIN documents ON doc_id = member")
def r9_listing(t):
    m = members(t).select(F.col("item_id").alias("rep"), F.col("doc_id").alias("member"), "score")
    names = t("documents").select(F.col("doc_id").alias("member"), F.col("source").alias("name"))
    r = t("benchmark").select((-F.col("item_id") - 1).alias("rep"))  # so that representatives aren't documents
    out = reps.listing(r, m.withColumn("rep", -F.col("rep") - 1), names, "rep", "member", "name")
    return out.select((-F.col("rep") - 1).alias("rep"), "member", "score", "position", "name")


@query(f"{sim.SCORES}, {BEST} SELECT item_id, coalesce(lang, '<unknown>') AS lang, count(*) AS members, count(DISTINCT source) AS species FROM b JOIN documents USING (doc_id) GROUP BY ALL")
def r13_taxonomy_breakdown(t):
    return reps.taxonomy_breakdown(members(t).join(t("documents").select("doc_id", "lang", "source"), "doc_id"), "item_id", "lang", "source")


@query(f"WITH {sim.ITEMS}, {sim.cut('k0', 'items', 'item_id', 5)}, k AS (SELECT DISTINCT * FROM k0), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS s FROM k x JOIN k y USING (kmer) WHERE x.item_id < y.item_id GROUP BY ALL) SELECT a, b, round(1 - s / (x.n + y.n - s), 9) AS distance FROM p JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b")
def r14_distances(t):
    k = kmers.explode(sim.items(t), "item_id", "seq", 5)
    return reps.distances(k.withColumnRenamed("item_id", "a"), k.withColumnRenamed("item_id", "b"), "a", "b").where("a < b").withColumn("distance", F.round("distance", 9))


@query(f"""{sim.PAIRS}, w AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), f AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS score FROM w x JOIN w y USING (w) WHERE x.item_id < y.item_id GROUP BY ALL) SELECT coalesce(p.a, f.a) AS a, coalesce(p.b, f.b) AS b, p.score AS seed_score, f.score AS profile_score FROM (FROM p WHERE a < b) p FULL JOIN f ON p.a = f.a AND p.b = f.b""")
def r16_pair_check(t):
    w = t("benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("kmer"))
    profile = kmers.common(w.withColumnRenamed("item_id", "a"), w.withColumnRenamed("item_id", "b"), "a", "b", "set").where("a < b")
    return reps.pair_check(sim.item_pairs(t).where("a < b"), profile)


@query(f"{sim.SCORES}, {BEST} SELECT doc_id, item_id, coalesce(score, 0) AS score, CASE WHEN score >= 60 THEN '' WHEN score >= 15 THEN 'outlier' ELSE 'extreme' END AS class FROM documents LEFT JOIN b USING (doc_id)")
def r20_classify(t):
    return reps.classify(sim.doc_scores(t), t("documents"), "doc_id", "item_id", 60, 15)


@query("SELECT n_name, s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j1_inner(t):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name", "s_acctbal")


@query("SELECT c_custkey, c_name, i AS ordinal FROM customer JOIN (SELECT o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS i FROM orders) USING (c_custkey)")
def j9_by_ordinals(t):
    placed = tables.running(t("orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey"), ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], {"before": F.lit(1)})
    keys = placed.select(F.col("o_custkey").alias("c_custkey"), (F.col("before") + 1).alias("ordinal"))
    return t("customer").join(keys, "c_custkey").select("c_custkey", "c_name", "ordinal")


@query("SELECT p.p_brand AS a, q.p_brand AS b, count(*) AS n FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber JOIN part p ON p.p_partkey = x.l_partkey JOIN part q ON q.p_partkey = y.l_partkey GROUP BY ALL")
def j11_pairs_within_group(t):
    l = lines(t).select("l_orderkey", "l_linenumber", "p_brand")  # noqa: E741
    x, y = l.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("p_brand").alias("a")), l.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("p_brand").alias("b"))
    return x.join(y, "l_orderkey").where("i < j").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN ('0x' || left(md5(concat_ws(':', '5', o_orderkey)), 8))::BIGINT % 10000 < 2500 THEN 'first' ELSE 'rest' END AS part, count(*) AS n FROM orders GROUP BY 1")
def o3_split(t):
    a, b = tables.split(t("orders"), "o_orderkey", 0.25, seed=5)
    return a.agg(F.lit("first").alias("part"), F.count("*").alias("n")).unionByName(b.agg(F.lit("rest").alias("part"), F.count("*").alias("n")))


@query("SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents")
def p1_normalize(t):
    return t("documents").select("doc_id", seq.normalize(F.col("text"), "letters").alias("letters"))


@query()
def m8_train_and_apply(t):
    """Whether a line was returned, from its figures: predictions counted against the truth."""
    rows = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    model = ml.train(rows, ["l_quantity", "l_extendedprice", "l_discount"], "label", "tree")
    return ml.apply(model, rows).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def m9_holdout(t):
    rows = t("documents").join(t("labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("x"), (F.length("text") - F.length(F.regexp_replace("text", "[#$%&*|!]", ""))).cast("double").alias("y"), F.col("quality").alias("label"))
    return ml.holdout(rows, ["x", "y"], "label", "doc_id", sweeps=2)


@query("SELECT p_type AS role, l_suppkey AS genome, l_partkey AS feature FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 48)")
def m14_occurrences(t):
    wanted = t("part").where("p_size > 48").select(F.col("p_type").alias("role"))
    return lines(t).select(F.col("p_type").alias("role"), F.col("l_suppkey").alias("genome"), F.col("l_partkey").alias("feature")).join(wanted, "role", "left_semi")


@query("""WITH e AS (SELECT user_id, event_type, event_id * 40 AS l, event_id * 40 + 25 AS r FROM events), m AS (SELECT *, max(r) OVER (PARTITION BY user_id, event_type ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), g AS (SELECT *, sum(CASE WHEN b IS NULL OR l > b + 1 + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, event_type, min(l) AS "left", max(r) AS "right" FROM g GROUP BY user_id, event_type, g.g HAVING max(r) - min(l) + 1 >= 50""")
def b11_merge_hits(t):
    hits = t("events").select("user_id", "event_type", (F.col("event_id") * 40).alias("left"), (F.col("event_id") * 40 + 25).alias("right"))
    return features.merge_hits(hits, ["user_id", "event_type"], "left", "right", F.lit(100))


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS l, greatest(l_partkey, l_suppkey) AS r, CASE WHEN l_partkey > l_suppkey THEN '-' ELSE '+' END AS strand FROM lineitem")
def f1_standardize(t):
    return features.standardize(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r")), "l", "r")


def mates(t):
    """Overlapping mates cut from turns: the left one leaves out the last third, the reversed right one the first."""
    d, third = turns(t), "floor(length(dna) / 3)"
    return d.select("conv_id", "turn", F.expr(f"left(dna, length(dna) - {third})").alias("l"), seq.revcomp(F.expr(f"substring(dna, cast({third} as int) + 1)")).alias("r"))


DNA = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
MATES = f"""d AS (SELECT conv_id, turn, {DNA} AS dna FROM conversations), m AS (SELECT conv_id, turn, left(dna, (length(dna) - length(dna) // 3)::INT) AS l, substr(dna, (length(dna) // 3)::INT + 1) AS r FROM d),
o AS (SELECT *, CASE WHEN length(l) < 25 OR length(r) < 25 THEN NULL WHEN strpos(l, left(r, 25)) > 0 THEN CASE WHEN length(l) - strpos(l, left(r, 25)) + 1 <= length(r) THEN length(l) - strpos(l, left(r, 25)) + 1 END
  WHEN strpos(r, right(l, 25)) > 0 AND strpos(r, right(l, 25)) + 24 <= length(l) THEN strpos(r, right(l, 25)) + 24 END AS size FROM m),
g AS (SELECT conv_id, turn, CASE WHEN right(l, size::INT) = left(r, size::INT) THEN l || substr(r, size::INT + 1) END AS merged FROM o)"""


@query(f"WITH {MATES} SELECT * FROM g")
def f9_merge_pairs(t):
    return reads.merge_pairs(mates(t), "l", "r", strict=True).select("conv_id", "turn", "merged")


@query(f"""WITH {MATES}, k AS (SELECT conv_id % 5 AS sample, merged AS seq FROM g WHERE merged IS NOT NULL), c AS (SELECT sample, seq, count(*) AS reads FROM k GROUP BY ALL),
h AS (SELECT {DNA} AS seq, role AS target, count(*) AS score FROM conversations GROUP BY ALL), b AS (SELECT seq, target FROM h QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, target) = 1)
SELECT sample, target, sum(reads)::BIGINT AS reads FROM c JOIN b USING (seq) GROUP BY ALL""")
def f10_amplicon_profile(t):
    """Merged mates of the turns, as amplicons; a hit is a role that such turns have."""
    merged = reads.merge_pairs(mates(t), "l", "r", strict=True).select((F.col("conv_id") % 5).alias("sample"), F.col("merged").alias("seq"))
    hits = t("conversations").select(seq.as_dna(F.col("text")).alias("dna"), F.col("role").alias("target")).groupBy(F.col("dna").alias("seq"), "target").agg(F.count("*").alias("score"))
    return reads.amplicon_profile(merged, hits, "sample", "seq", "target", 1)


@query("SELECT d.doc_id AS id, coalesce(l.quality::VARCHAR, d.lang) AS comment, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)")
def f12_annotate(t):
    d = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("comment"))
    return files.annotate_fasta(d, t("labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("name")))


@query("SELECT a.s_suppkey AS b FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier r WHERE r.s_nationkey = a.s_nationkey AND r.s_suppkey < a.s_suppkey AND (SELECT count(*) FILTER (substr(a.s_name, i::INT, 1) = substr(r.s_name, i::INT, 1)) / count(*) FROM range(1, 19) t(i)) >= 0.9)")
def c13_filter_similar(t):
    return align.like_earlier(t("supplier"), "s_nationkey", "s_suppkey", "s_name", 0.9)


@query("SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM orders WHERE o_orderkey > 1000")
def w7_resume(t):
    return t("orders").where("o_orderkey > 1000").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL""")
def w5_group_rows(t):
    return tables.group_rows(t("events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey) AS place FROM orders")
def o1_multi_key_order(t):
    return tables.numbered(t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.desc("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_suppkey, least(l_partkey, l_orderkey), greatest(l_partkey, l_orderkey), l_linenumber) AS place FROM lineitem")
def o2_location_order(t):
    """Locations (contig, ends in either order) in their natural order."""
    at = features.standardize(t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("l"), F.col("l_orderkey").alias("r")), "l", "r")
    return tables.numbered(at, [F.col(c) for c in ("l_suppkey", "l", "r", "l_linenumber")], "place").select("l_orderkey", "l_linenumber", "place")


@query("""WITH f AS (SELECT l_orderkey AS genome, l_linenumber AS feature, 'c' || l_suppkey || '_' || l_partkey || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END || l_quantity::BIGINT AS location, CASE WHEN l_linestatus = 'F' THEN l_shipdate::DATE::VARCHAR END AS family FROM lineitem) SELECT * FROM f""")
def f5_feature_table(t):
    l = t("lineitem")  # noqa: E741
    place = F.array(F.struct(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("contig"), F.col("l_partkey").alias("begin"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), F.col("l_quantity").cast("long").alias("len")))
    families = F.array(F.struct(F.lit("other").alias("db"), F.lit("x").alias("id")), F.struct(F.when(F.col("l_linestatus") == "F", "wanted").otherwise("none").alias("db"), F.col("l_shipdate").cast("date").cast("string").alias("id")))
    rows = l.select(F.col("l_orderkey").alias("genome"), F.col("l_linenumber").alias("feature"), place.alias("place"), families.alias("families"))
    return features.table(rows, "genome", "feature", F.col("place"), F.col("families"), "wanted")
