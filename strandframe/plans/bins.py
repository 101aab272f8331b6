"""Scores of contigs and reports on bins. Contigs are orders; bins come from their customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bins, clusters, features, match
from .registry import query
from .similarity import cover_sql

HITS = "h AS (SELECT o_custkey AS contig, o_orderpriority AS ref, (o_orderkey % 90 + 10)::DOUBLE AS identity, o_orderkey AS b2, o_orderkey + floor(o_totalprice / 1000) AS e2 FROM orders)"
VEC = f"WITH {HITS}, s AS (SELECT contig, ref, max(identity) AS score FROM h GROUP BY ALL)"


def hits(t):
    return t("orders").select(F.col("o_custkey").alias("contig"), F.col("o_orderpriority").alias("ref"), (F.col("o_orderkey") % 90 + 10).cast("double").alias("identity"), F.col("o_orderkey").alias("b2"), (F.col("o_orderkey") + F.floor(F.col("o_totalprice") / 1000)).alias("e2"))


def vector(t):
    return bins.score(hits(t), "contig", "ref", "vector")


@query(f"WITH {HITS} SELECT contig, ref, max(identity) AS vector, round(sum(identity * abs(e2 - b2) / 100), 6) AS signal, round(avg(identity * abs(e2 - b2) / 100), 6) AS signalavg FROM h GROUP BY ALL")
def b1_scores(t):
    out = vector(t).withColumnRenamed("score", "vector")
    for m in ("signal", "signalavg"):
        out = out.join(bins.score(hits(t), "contig", "ref", m).withColumn(m, F.round("score", 6)).drop("score"), ["contig", "ref"])
    return out


@query(f"{VEC} SELECT * FROM s WHERE contig IN (SELECT contig FROM s GROUP BY contig HAVING sum(score) > 200 AND sum(score) < 400)")
def b2_screen(t):
    return bins.screen(vector(t), "contig", 200, 400)


@query(f"{VEC} SELECT contig, arg_min(ref, (-score, ref)) AS best, round(max(score) / sqrt(sum(score ^ 2)), 6) AS score FROM s GROUP BY contig")
def b3_best_coordinate(t):
    return bins.best_coordinate(vector(t), "contig", "ref", normalize=True).withColumn("score", F.round("score", 6))


NV = "WITH s AS (SELECT n_nationkey AS contig, o_orderpriority AS ref, count(*)::DOUBLE AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def nations(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("contig"), F.col("o_orderpriority").alias("ref")).agg(F.count("*").cast("double").alias("score"))


@query(f"{NV} SELECT x.contig AS a, y.contig AS b, sum(x.score * y.score) AS dot FROM s x JOIN s y USING (ref) WHERE x.contig < y.contig GROUP BY ALL")
def b4_dot_product(t):
    return bins.dot_products(nations(t), "contig", "ref")


def arrays(t):
    """Each nation's vector of order counts over all priorities; a missing priority is a coordinate that all have at zero."""
    s = t("nation").select(F.col("n_nationkey").alias("contig")).join(nations(t), "contig")
    counts = F.map_from_entries(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("ref", "score"))))
    missing = F.when(F.max(F.col("ref").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    refs = s.agg(F.concat(F.array_sort(F.collect_set("ref")), missing).alias("refs"))
    own = s.groupBy("contig").agg(counts.alias("own")).join(F.broadcast(refs))  # refs is one row
    return own.select("contig", F.transform("refs", lambda r: F.coalesce(F.col("own")[r], F.lit(0.0))).alias("v"))


def pairs(t):
    """All pairs of nations, with their vectors."""
    return bins.all_pairs(arrays(t), "contig", "v")


FULL = f"{NV}, r AS (SELECT DISTINCT ref FROM s), c AS (SELECT DISTINCT contig FROM s), f AS (SELECT contig, ref, coalesce(score, 0) AS score FROM c CROSS JOIN r LEFT JOIN s USING (contig, ref))"


@query(f"{FULL} SELECT x.contig AS a, y.contig AS b, round(sum(CASE WHEN greatest(x.score, y.score) > 0 THEN 1 / (1 + abs(x.score - y.score) / greatest(x.score, y.score)) ELSE 0 END), 6) AS likeness FROM f x JOIN f y USING (ref) WHERE x.contig < y.contig GROUP BY ALL")
def b5_distance(t):
    """The likeness of every pair of nations; one without a common reference has half a point for each coordinate."""
    return pairs(t).select("a", "b", F.round(bins.compare_dist(F.col("x"), F.col("y")), 6).alias("likeness"))


@query(f"{NV}, b AS (SELECT contig, arg_min(ref, (-score, ref)) AS best, max(score) AS score FROM s GROUP BY contig) SELECT x.contig AS a, y.contig AS b, round(1 / (1 + abs(x.score - y.score) / greatest(x.score, y.score)), 6) AS likeness FROM b x JOIN b y USING (best) WHERE x.contig < y.contig")
def b6_best(t):
    return bins.compare_best(bins.best_coordinate(nations(t), "contig", "ref"), "contig").withColumn("likeness", F.round("likeness", 6))


@query(f"""{NV}, z AS (SELECT x.contig AS a, y.contig AS b, ref, x.score AS xs, y.score AS ys FROM s x JOIN s y USING (ref) WHERE x.contig < y.contig AND x.score <> 0 AND y.score <> 0),
p AS (SELECT p.a, p.b, sum(CASE WHEN p.ys >= q.ys THEN 1 ELSE -2 END) AS n FROM z p JOIN z q ON p.a = q.a AND p.b = q.b AND (p.xs > q.xs OR p.xs = q.xs AND p.ref < q.ref) GROUP BY ALL), c AS (SELECT DISTINCT contig FROM s),
l AS (SELECT x.contig AS a, y.contig AS b, 1 + coalesce(n, 0) AS score FROM c x JOIN c y ON x.contig < y.contig LEFT JOIN p ON p.a = x.contig AND p.b = y.contig)
SELECT a, b, score::INT AS score FROM l""")
def b7_rank(t):
    """The rank score of every pair of nations; one without a common reference has 1."""
    return pairs(t).select("a", "b", bins.compare_rank(F.col("x"), F.col("y")).alias("score"))


@query(f"{VEC}, k AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY score DESC, ref) AS i FROM s WHERE score > 0 QUALIFY i <= 3), o AS (SELECT contig, array_to_string(list(ref ORDER BY i), ',') AS key FROM k GROUP BY contig) SELECT key, count(*) AS contigs, min(contig) AS first FROM o GROUP BY key")
def b8_binning(t):
    return bins.order_key(vector(t), "contig", "ref", 3).groupBy("key").agg(F.count("*").alias("contigs"), F.min("contig").alias("first"))


@query(f"""{FULL}, z AS (SELECT contig, min(score) = 0 AS zero FROM f GROUP BY contig), m AS (SELECT x.contig AS a, y.contig AS b FROM c x JOIN c y ON x.contig < y.contig),
o AS (SELECT a, b, row_number() OVER w AS i, y.score AS here, lead(y.score) OVER w AS after FROM m JOIN f x ON x.contig = a JOIN f y ON y.contig = b AND y.ref = x.ref WINDOW w AS (PARTITION BY a, b ORDER BY x.score DESC, x.ref)),
d AS (SELECT a, b, count(*) FILTER (i <= 2 AND after > here) = 0 AS same FROM o GROUP BY ALL),
l AS (SELECT a, b, (CASE WHEN p.zero OR q.zero THEN p.zero AND q.zero ELSE same END)::INT AS same FROM d JOIN z p ON p.contig = a JOIN z q ON q.contig = b)
SELECT a, b, same FROM l""")
def b8_compare_order(t):
    """Whether each pair of nations is in order; of those without a common reference, if both have zeros."""
    return pairs(t).select("a", "b", bins.compare_order(F.col("x"), F.col("y"), top=2, strict=True).alias("same"))


@query(f"""WITH RECURSIVE s AS (SELECT l_suppkey, p_brand, sum(l_quantity) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), top AS (FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, p_brand) <= 2),
nd AS (SELECT DISTINCT p_brand AS node FROM top), ed AS (SELECT DISTINCT x.p_brand AS a, y.p_brand AS b FROM top x JOIN top y USING (l_suppkey) WHERE x.p_brand <> y.p_brand), {cover_sql('nd', 'ed', 'VARCHAR', 1)} SELECT rep, unnest(members) AS member FROM cv WHERE rep IS NOT NULL""")
def b9_basis(t):
    scores = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("score"))
    return bins.basis(scores, "l_suppkey", "p_brand", 2)


CON = "c AS (SELECT o_orderkey AS contig, c_nationkey AS bin, c_mktsegment AS seg, o_orderpriority AS role, floor(o_totalprice)::BIGINT AS length, c_acctbal AS coverage, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey)"


def contigs(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("contig"), F.col("c_nationkey").alias("bin"), F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("role"), F.floor("o_totalprice").alias("length"), F.col("c_acctbal").alias("coverage"), "o_orderstatus")


@query(f"""WITH {CON}, ok AS (SELECT * FROM c WHERE length >= 20000 AND coverage >= 100), h AS (SELECT l_orderkey AS contig, l_suppkey AS ref, sum(l_quantity) AS score, l_returnflag = 'R' AS f FROM lineitem GROUP BY ALL),
p AS (SELECT contig, arg_min(ref, (-score, ref)) AS bin, 'seed' AS how FROM h JOIN ok USING (contig) WHERE f GROUP BY contig), q AS (SELECT contig, arg_min(ref, (-score, ref)) AS bin, 'second' AS how FROM h JOIN ok USING (contig) WHERE NOT f AND contig NOT IN (SELECT contig FROM p) GROUP BY contig)
SELECT * FROM p UNION ALL SELECT * FROM q WHERE bin IN (SELECT bin FROM p)""")
def b10_seed_binning(t):
    h = t("lineitem").groupBy(F.col("l_orderkey").alias("contig"), F.col("l_suppkey").alias("ref"), (F.col("l_returnflag") == "R").alias("f")).agg(F.sum("l_quantity").alias("score"))
    return bins.seed(contigs(t), h.where("f"), h.where("not f"), "contig", "ref", 20_000, 100).select("contig", "bin", "how")


@query(f"WITH {CON} SELECT length >= 100000 AS long, coverage >= 5000 AS covered, count(*) AS contigs, sum(length)::BIGINT AS bases FROM c GROUP BY ALL")
def b12_filter_effect(t):
    return bins.filter_effect(contigs(t), 100_000, 5_000)


@query(f"WITH {CON}, u AS (SELECT bin, count(*) - 5.0 * count(*) FILTER (n > 1) AS uni_score FROM (SELECT bin, role, count(*) AS n FROM c GROUP BY ALL) GROUP BY bin) SELECT bin, count(*) AS contigs, sum(length)::BIGINT AS bases, round(sum(length * coverage) / sum(length), 4) AS coverage, any_value(uni_score)::DOUBLE AS uni_score FROM c JOIN u USING (bin) GROUP BY bin")
def b13_summary(t):
    return bins.summarize(contigs(t), "bin", "role").withColumns({"coverage": F.round("coverage", 4), "uni_score": F.col("uni_score").cast("double")})


@query(f"WITH {CON}, n AS (SELECT bin, o_custkey AS ref, count(*) AS contigs, sum(length)::BIGINT AS bases FROM c JOIN orders ON o_orderkey = contig GROUP BY ALL) SELECT bin, ref, row_number() OVER (PARTITION BY bin ORDER BY bases DESC, ref)::INT AS rank, contigs, bases FROM n QUALIFY rank <= 10")
def b13_references(t):
    refs = t("orders").select(F.col("o_orderkey").alias("contig"), F.col("o_custkey").alias("ref"))
    return bins.references(contigs(t).join(refs, "contig"), "bin", "ref", "length")


@query(f"""WITH {CON}, s AS (SELECT seg AS expected, bin, count(*) AS n FROM c WHERE length > 50000 GROUP BY ALL), b AS (SELECT expected, arg_min(bin, (-n, bin)) AS bin, max(n) AS shared FROM s GROUP BY expected),
z AS (SELECT bin, count(*) AS size FROM c WHERE length > 50000 GROUP BY bin), w AS (SELECT seg AS expected, count(*) AS wanted FROM c GROUP BY 1) SELECT expected, coalesce(bin::VARCHAR, 'MISSING') AS bin, coalesce(shared, 0) AS shared, coalesce(size, 0) - coalesce(shared, 0) AS extra, wanted - coalesce(shared, 0) AS missed FROM w LEFT JOIN b USING (expected) LEFT JOIN z USING (bin)""")
def b14_match_expected(t):
    c = contigs(t)
    return bins.match_expected(c.where("length > 50000").select("contig", "bin"), c.select("contig", F.col("seg").alias("expected")), "contig")


@query(f"WITH {CON}, x AS (SELECT bin, count(*) AS n FROM c GROUP BY bin), y AS (SELECT seg, count(*) AS n FROM c GROUP BY seg) SELECT c.bin AS bin_a, c.seg AS bin_b, any_value(x.n) - count(*) AS only_a, count(*) AS both, any_value(y.n) - count(*) AS only_b FROM c JOIN x ON x.bin = c.bin JOIN y ON y.seg = c.seg GROUP BY ALL")
def b15_overlap(t):
    c = contigs(t)
    return bins.overlap(c.select("contig", "bin"), c.select("contig", F.col("seg").alias("bin")), "contig")


@query(f"WITH {CON}, a AS (SELECT * FROM c WHERE o_orderstatus <> 'P'), b AS (SELECT * FROM c WHERE o_orderstatus <> 'F') SELECT coalesce(a.seg, 'unused') AS source, coalesce(b.role, 'unbinned') AS target, count(*) AS contigs, sum(coalesce(a.length, b.length))::BIGINT AS bases FROM a FULL JOIN b ON a.contig = b.contig GROUP BY ALL")
def b16_flows(t):
    c = contigs(t)
    return bins.flows(c.where("o_orderstatus <> 'P'").withColumn("bin", F.col("seg")), c.where("o_orderstatus <> 'F'").withColumn("bin", F.col("role")), "contig")


@query(f"WITH {CON}, r AS (SELECT contig, 'one' AS run, role AS bin FROM c UNION ALL SELECT contig, 'two', CASE WHEN length > 499000 THEN contig::VARCHAR ELSE role END FROM c WHERE length > 100000), l AS (SELECT contig, run, CASE WHEN count(*) OVER (PARTITION BY run, bin) = 1 THEN 'X' ELSE bin END AS l FROM r), w AS (SELECT contig, min(l) FILTER (run = 'one') AS one, min(l) FILTER (run = 'two') AS two FROM l GROUP BY contig) SELECT *, CASE WHEN coalesce(one, '') = coalesce(two, '') THEN 2 ELSE 1 END::INT AS agreement FROM w")
def b17_side_by_side(t):
    c = contigs(t)
    two = c.where("length > 100000").select("contig", F.lit("two").alias("run"), F.when(F.col("length") > 499_000, F.col("contig").cast("string")).otherwise(F.col("role")).alias("bin"))
    return bins.side_by_side(c.select("contig", F.lit("one").alias("run"), F.col("role").alias("bin")).unionByName(two), "contig", ["one", "two"])


@query(f"WITH {CON}, b AS (SELECT contig, bin FROM c QUALIFY count(*) OVER (PARTITION BY bin) > 1) SELECT role AS cluster, count(DISTINCT b.bin) AS bins, count(*) AS contigs FROM c JOIN b USING (contig) GROUP BY role HAVING count(DISTINCT b.bin) >= 2")
def b18_crosstab(t):
    c = contigs(t)
    return bins.crosstab(c.select("contig", F.col("role").alias("cluster")), c.select("contig", "bin"), "contig")


@query("""WITH n AS (SELECT l_orderkey AS contig, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1), k AS (SELECT o_orderkey AS contig FROM orders WHERE o_orderstatus <> 'P') SELECT coalesce(k.contig, n.contig) AS contig, CASE WHEN k.contig IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'unplaced' WHEN n > 1 THEN 'multiple' ELSE 'once' END AS placed FROM k FULL JOIN n ON k.contig = n.contig""")
def b19_placement(t):
    return bins.placement(t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("contig")), t("lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("contig")), "contig")


@query(f"WITH {CON} SELECT bin, round(avg(coverage), 4) AS coverage, round(avg(coverage) FILTER (role = '1-URGENT'), 4) AS seed_coverage FROM c GROUP BY bin HAVING avg(coverage) >= 4500 OR avg(coverage) FILTER (role = '1-URGENT') >= 4500")
def b20_coverage(t):
    out = bins.coverage(contigs(t), "bin", F.col("role") == "1-URGENT", 4500)
    return out.withColumns({"coverage": F.round("coverage", 4), "seed_coverage": F.round("seed_coverage", 4)})


@query(f"WITH {CON} SELECT seg, bin, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus <> 'F') AS bad, coalesce(sum(length) FILTER (role <> '5-LOW'), 0)::BIGINT AS bases_binned, coalesce(sum(length) FILTER (role = '5-LOW'), 0)::BIGINT AS bases_unbinned, round(sum(length * coverage) / sum(length), 4) AS coverage FROM c GROUP BY ALL")
def b21_site_report(t):
    return bins.site_report(contigs(t), ["seg", "bin"], F.col("o_orderstatus") == "F", F.col("role") != "5-LOW").withColumn("coverage", F.round("coverage", 4))


@query(f"WITH {CON} SELECT seg, role, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (length > 300000) AS large FROM c GROUP BY ALL")
def b22_audit(t):
    return bins.audit(contigs(t), ["seg", "role"], {"done": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O", "large": F.col("length") > 300_000})


@query(f"WITH {CON}, g AS (SELECT bin, o_orderstatus = 'F' AS good, role IN ('1-URGENT', '2-HIGH') AS one FROM c) SELECT bin, count(*) FILTER (one AND good) AS good_a, count(*) FILTER (one AND NOT good) AS bad_a, count(*) FILTER (NOT one AND good) AS good_b, count(*) FILTER (NOT one AND NOT good) AS bad_b FROM g GROUP BY bin HAVING count(*) FILTER (one) > 0 AND count(*) FILTER (NOT one) > 0")
def b23_compare_good(t):
    c = contigs(t).withColumn("good", F.col("o_orderstatus") == "F")
    return bins.compare_good(c.where("role in ('1-URGENT', '2-HIGH')"), c.where("role not in ('1-URGENT', '2-HIGH')"), "bin", "good")


@query("""WITH e AS (SELECT c_nationkey AS n, count(*) AS expected FROM customer WHERE c_acctbal >= 9000 GROUP BY 1), f AS (SELECT s_nationkey AS n, count(*) AS found FROM supplier GROUP BY 1) SELECT coalesce(e.n, f.n) AS category, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, CASE WHEN expected IS NULL THEN 'unexpected' WHEN found IS NULL THEN 'missed' ELSE 'found' END AS state FROM e FULL JOIN f ON e.n = f.n""")
def b24_expectations(t):
    return bins.expectations(t("customer").select(F.col("c_nationkey").alias("category"), F.col("c_acctbal").alias("depth")), t("supplier").select(F.col("s_nationkey").alias("category")), "category", 9000)


@query(f"WITH {CON} SELECT bin, seg, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY bin), 6) AS percent FROM c GROUP BY bin, seg")
def b25_composition(t):
    return bins.composition(contigs(t), "bin", "seg").withColumn("percent", F.round("percent", 6))


@query("""WITH f AS (SELECT l_suppkey AS genome, l_orderkey AS fragment, l_partkey AS sid, l_linenumber AS ord, l_quantity AS length, 100 * (1 - l_discount * 8) AS identity, 100 - l_tax * 400 AS coverage FROM lineitem),
b AS (SELECT * FROM f WHERE length >= 10 QUALIFY row_number() OVER (PARTITION BY genome, fragment ORDER BY ord, sid, length, identity, coverage) = 1) SELECT genome, count(*) AS fragments, round(avg(identity), 6) AS ani FROM b WHERE identity > 30 AND coverage >= 70 GROUP BY genome""")
def b29_ani(t):
    f = t("lineitem").select(F.col("l_suppkey").alias("genome"), F.col("l_orderkey").alias("fragment"), F.col("l_partkey").alias("sid"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("length"), (100 * (1 - F.col("l_discount") * 8)).alias("identity"), (100 - F.col("l_tax") * 400).alias("coverage"))
    return match.ani(f, ["genome"], "fragment", [F.col(c) for c in ("ord", "sid", "length", "identity", "coverage")], 10).withColumn("ani", F.round("ani", 6))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*)::DOUBLE AS total FROM l x JOIN l y USING (l_orderkey) WHERE x.p_brand < y.p_brand GROUP BY ALL),
s AS (SELECT 0 AS step, NULL::STRUCT(a VARCHAR, b VARCHAR, total DOUBLE, average DOUBLE) AS m, (SELECT list({'a': a, 'b': b, 't': total, 'na': 1, 'nb': 1}) FROM e) AS edges
UNION ALL SELECT step + 1, {'a': x.a, 'b': x.b, 'total': x.t, 'average': x.t / (x.na * x.nb)},
 (SELECT list({'a': a, 'b': b, 't': t, 'na': na, 'nb': nb}) FROM (SELECT least(p, q) AS a, greatest(p, q) AS b, sum(t) AS t, max(CASE WHEN p < q THEN np ELSE nq END) AS na, max(CASE WHEN p < q THEN nq ELSE np END) AS nb FROM
  (SELECT CASE WHEN u.a = x.b THEN x.a ELSE u.a END AS p, CASE WHEN u.b = x.b THEN x.a ELSE u.b END AS q, u.t AS t, CASE WHEN u.a IN (x.a, x.b) THEN x.na + x.nb ELSE u.na END AS np, CASE WHEN u.b IN (x.a, x.b) THEN x.na + x.nb ELSE u.nb END AS nq
   FROM (SELECT unnest(edges) AS u)) WHERE p <> q GROUP BY ALL))
FROM (SELECT step, edges, list_reduce(edges, lambda v, w: CASE WHEN w.t > v.t OR w.t = v.t AND (w.a < v.a OR w.a = v.a AND w.b < v.b) THEN w ELSE v END) AS x FROM s WHERE len(edges) > 0))
SELECT min(m.a) OVER () AS component, step, m.a AS a, m.b AS b, m.total AS total, m.average AS average FROM s WHERE step > 0""")
def b27_merge_list(t):
    """Brands that come in the same orders; every pair of the 25 does, so it takes about as many rounds as merges."""
    shared = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("a")).distinct()
    edges = shared.join(shared.withColumnRenamed("a", "b"), "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("score"))
    return clusters.merge_list(edges)


EVT = "e AS (SELECT user_id, epoch(ts)::BIGINT AS l, epoch(ts)::BIGINT + 600 + event_id % 3000 AS r FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))"


def intervals(t):
    s = F.unix_timestamp(F.date_trunc("second", "ts"))
    return t("events").select("event_id", "user_id", "event_type", s.alias("left"), (s + 600 + F.col("event_id") % 3000).alias("right"))


@query(f"WITH {EVT}, m AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), g AS (SELECT *, sum(CASE WHEN before IS NULL OR l > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(l) AS \"left\", max(r) AS \"right\" FROM g GROUP BY user_id, g.g")
def f2_merge_intervals(t):
    return features.merge(intervals(t), "user_id", "left", "right").select("user_id", "left", "right")


@query("SELECT user_id, event_id, lead(event_id) OVER w AS next1, lead(event_id, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w4_adjacent(t):
    return features.adjacent(t("events"), "user_id", ["ts", "event_id"], "event_id", 2).select("user_id", "event_id", "next1", "next2")


@query("WITH x AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT array_to_string(list_sort([a, b, c]), ',') AS triple, count(*) AS n FROM x WHERE c IS NOT NULL GROUP BY 1")
def f4_role_triples(t):
    roles = t("events").select("user_id", "ts", "event_id", F.array("event_type").alias("roles"))
    return features.role_triples(roles, "user_id", ["ts", "event_id"], "roles").select(F.array_join("triple", ",").alias("triple"), "n")


@query(f"WITH {EVT}, o AS (SELECT o_orderkey, o_custkey % 50 AS user_id, epoch(date_trunc('second', TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (o_orderkey % 40000)))::BIGINT AS p FROM orders) SELECT o_orderkey, EXISTS (SELECT 1 FROM e WHERE e.user_id = o.user_id AND p BETWEEN l AND r) AS inside FROM o")
def f7_label_points(t):
    points = t("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("user_id"), (F.lit(1704067200) + 60 * (F.col("o_orderkey") % 40000)).alias("p"))
    return features.label_points(points, intervals(t), "user_id", "p", "left", "right", width=4096, id_col="o_orderkey").select("o_orderkey", "inside")


@query("WITH s AS (SELECT c_nationkey AS k, c_custkey AS seg, sum(1 + floor(c_acctbal / 1000)::BIGINT) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS hi, 1 + floor(c_acctbal / 1000)::BIGINT AS len FROM customer) SELECT s_suppkey, (SELECT seg FROM s WHERE k = s_nationkey AND s_suppkey % 20 > hi - len AND s_suppkey % 20 <= hi) AS segment FROM supplier")
def f8_locate(t):
    segments = t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("segment"), (1 + F.floor(F.col("c_acctbal") / 1000)).alias("length"))
    coords = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 20).alias("at"))
    return features.locate(coords, segments, "k", "at", "segment", "length").select("s_suppkey", "segment")


@query("""WITH e AS (SELECT event_id, user_id, event_type AS s, epoch(date_trunc('second', ts))::BIGINT AS mid FROM events), g AS (SELECT *, CASE WHEN s = lag(s) OVER w AND mid - lag(mid) OVER w <= 200000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY mid, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY mid, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT any_value(s) AS subsystem, min(event_id) AS cluster, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) > 1""")
def f3_feature_clusters(t):
    f = t("events").select("event_id", "user_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("mid"), F.array("event_type").alias("subsystems"))
    return features.clusters(f, "user_id", "event_id", "mid", "subsystems", 200_000).groupBy("subsystem", "cluster").agg(F.count("*").alias("n"))
