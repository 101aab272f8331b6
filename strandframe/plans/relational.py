"""Statistics, table shapes, joins and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import stats, tables
from .registry import query

A1 = "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL"


@query(A1)
def a1_count_by_key(t):
    return t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 20) AS large,
count(DISTINCT event_type) AS types FROM events GROUP BY user_id""")
def a2_conditional_counts(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 20).alias("large"), F.count_distinct("event_type").alias("types"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS coverage FROM lineitem GROUP BY l_suppkey")
def a4_weighted_mean(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.round(stats.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("coverage"))


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY l_suppkey")
def a5_mean_population_sd(t):
    return stats.mean_sd(t("lineitem"), ["l_suppkey"], "l_quantity", population=True).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_orderkey")
def a6_mean_sample_sd(t):
    return stats.mean_sd(t("lineitem"), ["l_orderkey"], "l_quantity").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("""SELECT l_suppkey, n, round(r, 6) AS r, round(CASE WHEN abs(r) < 1 THEN 0.5 * ln((1 + r) / (1 - r)) END, 6) AS z FROM (
SELECT l_suppkey, count(*) AS n, CASE WHEN count(*) > 2 AND min(l_quantity) < max(l_quantity) AND min(l_tax) < max(l_tax) THEN corr(l_quantity, l_tax) END AS r
FROM lineitem GROUP BY l_suppkey)""")
def a7_correlation(t):
    return stats.correlation(t("lineitem"), ["l_suppkey"], "l_quantity", "l_tax", z=True).withColumns({"r": F.round("r", 6), "z": F.round("z", 6)})


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
f AS (SELECT *, greatest(0.0, least(n * 0.25 - 0.5, n - 1.0)) AS p25, greatest(0.0, least(n * 0.5 - 0.5, n - 1.0)) AS p50, greatest(0.0, least(n * 0.9 - 0.5, n - 1.0)) AS p90 FROM r)
SELECT l_suppkey, round(sum(v * greatest(0.0, 1 - abs(i - p25))::DOUBLE), 6) AS q25, round(sum(v * greatest(0.0, 1 - abs(i - p50))::DOUBLE), 6) AS q50, round(sum(v * greatest(0.0, 1 - abs(i - p90))::DOUBLE), 6) AS q90
FROM f GROUP BY l_suppkey""")
def a8_quantile(t):
    out = stats.quantile(t("lineitem"), ["l_suppkey"], "l_extendedprice", [0.25, 0.5, 0.9])
    return out.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q90")))


@query("""SELECT l_returnflag, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2, round(q[4], 6) AS q3, round(q[5], 6) AS q4, round((q[2] + 2 * q[3] + q[4]) / 4, 6) AS trimean, round(q[4] - q[2], 6) AS iqr
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM lineitem GROUP BY l_returnflag)""")
def a9_summary5(t):
    out = stats.summary5(t("lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS o, sum(l_quantity) AS e FROM lineitem GROUP BY ALL), s AS (SELECT l_suppkey, sum(o) / sum(e) AS scale FROM c GROUP BY l_suppkey)
SELECT l_suppkey, round(sum((o - e * scale) ^ 2 / (e * scale)), 6) AS chi_square, count(*) - 1 AS df FROM c JOIN s USING (l_suppkey) WHERE e > 0 GROUP BY l_suppkey""")
def a10_chi_square(t):
    counts = t("lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("o"), F.sum("l_quantity").alias("e"))
    return stats.chi_square(counts, ["l_suppkey"], "e", "o").withColumn("chi_square", F.round("chi_square", 6))


@query("""WITH c AS (SELECT n_regionkey AS region, c_mktsegment AS s, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT region, s, sum(n) AS r FROM c GROUP BY ALL), k AS (SELECT region, p, sum(n) AS k FROM c GROUP BY ALL), g AS (SELECT region, sum(n) AS t FROM c GROUP BY region),
e AS (SELECT r.region, coalesce(n, 0) AS n, r * k / t AS e FROM r JOIN k USING (region) JOIN g USING (region) LEFT JOIN c ON c.region = r.region AND c.s = r.s AND c.p = k.p),
d AS (SELECT region, (count(DISTINCT s) - 1) * (count(DISTINCT p) - 1) AS df FROM c GROUP BY region)
SELECT region, round(sum((n - e) ^ 2 / e), 6) AS chi_square, any_value(df) AS df FROM e JOIN d USING (region) GROUP BY region""")
def a11_contingency(t):
    cells = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = cells.groupBy(F.col("n_regionkey").alias("region"), "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    return stats.contingency(counts, ["region"], "c_mktsegment", "o_orderpriority", "n").withColumn("chi_square", F.round("chi_square", 6))


@query("""WITH s AS (SELECT user_id, avg(value) AS m, coalesce(stddev_samp(value), 0) AS d FROM events GROUP BY user_id)
SELECT event_id, user_id, value FROM events JOIN s USING (user_id) WHERE abs(value - m) <= 2 * d""")
def a12_within_sigma(t):
    return tables.within_sigma(t("events"), "user_id", "value", 2).select("event_id", "user_id", "value")


@query("""WITH f AS (SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM lineitem))
SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN (FROM f) GROUP BY p_brand""")
def a13_complete_in_all(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey")
    return tables.complete_in_all(rows, "p_brand", "l_suppkey").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, round(sum(o_totalprice), 2) AS total, count(*) AS queries FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders JOIN customer ON o_custkey = c_custkey) WHERE i = 1 GROUP BY c_nationkey""")
def a15_weighted_best(t):
    hits = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tables.weighted_best(hits, "o_custkey", "c_nationkey", "o_totalprice", F.desc("o_totalprice"), F.col("o_orderkey")).withColumn("total", F.round("total", 2))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT x.p AS a, y.p AS b, count(*) AS n, round(avg(x.v / y.v), 6) AS ratio FROM v x JOIN v y USING (o_custkey) WHERE x.p < y.p AND x.v > 0 AND y.v > 0 GROUP BY ALL""")
def a16_ratio_means(t):
    v = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return stats.ratio_means(v, "o_custkey", "o_orderpriority", "v").withColumn("ratio", F.round("ratio", 6))


TYPES = ["click", "error", "purchase", "view", "signup"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{c}') AS {c}" for c in TYPES) + " FROM events GROUP BY user_id")
def a17_pivot_fixed(t):
    return tables.pivot_fixed(t("events"), "user_id", "event_type", TYPES, F.count(F.lit(1)))


@query("""SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def a18_rollup(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w1_best_per_key(t):
    return tables.best_per_key(t("orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 5")
def w2_top_k_per_key(t):
    return tables.top_k(t("lineitem"), ["l_suppkey"], 5, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT *, rank_a - rank_b AS rank_diff FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY bal DESC, s_suppkey) AS rank_a, row_number() OVER (PARTITION BY s_nationkey ORDER BY q DESC, s_suppkey) AS rank_b
FROM (SELECT s_nationkey, s_suppkey, s_acctbal AS bal, sum(l_quantity) AS q FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL))""")
def w3_rank_compare(t):
    both = t("supplier").join(t("lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("bal")).agg(F.sum("l_quantity").alias("q"))
    return tables.rank_compare(both, ["s_nationkey"], "s_suppkey", "bal", "q").select("s_nationkey", "s_suppkey", "rank_a", "rank_b", "rank_diff")


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, sum(l_quantity) OVER w AS run, row_number() OVER w AS i, sum(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM lineitem
WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity DESC ROWS UNBOUNDED PRECEDING))
SELECT l_returnflag, l_linestatus, max(v) FILTER (run * 100 >= total * 50) AS n50, min(i) FILTER (run * 100 >= total * 50) AS l50, max(v) FILTER (run * 100 >= total * 90) AS n90, min(i) FILTER (run * 100 >= total * 90) AS l90 FROM r GROUP BY ALL""")
def w6_nx(t):
    return stats.nx(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", [50, 90])


@query("SELECT text, count(*) AS count FROM documents GROUP BY text HAVING count(*) > 1")
def u2_duplicates(t):
    return tables.duplicates(t("documents"), "text")


@query("""WITH s AS (SELECT c_custkey AS k, list_distinct(list(l_linenumber)) AS a, list_distinct(list(CASE WHEN l_returnflag = 'R' THEN l_linenumber END)) AS b FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both_sets, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a FROM s""")
def u1_set_operations(t):
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sets = rows.groupBy(F.col("c_custkey").alias("k")).agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("b"))
    ops = tables.set_ops(F.col("a"), F.col("b"))
    return sets.select("k", *(F.array_join(ops[o].cast("array<string>"), ",").alias(n) for o, n in (("union", "both_sets"), ("intersection", "shared"), ("difference", "only_a"))))


@query("""WITH w AS (SELECT string_split(split_part(url, '//', 2), '/')[1] AS host, string_split(url, '/') AS parts FROM pages),
l AS (SELECT host, count(*) AS lists FROM w GROUP BY host),
x AS (SELECT host, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM w),
s AS (SELECT host, i FROM x JOIN l USING (host) GROUP BY host, i, lists HAVING count(*) = lists AND min(x) = max(x)),
k AS (SELECT host, i, row_number() OVER (PARTITION BY host ORDER BY i) AS r FROM s)
SELECT host, count(*) FILTER (i = r) AS n_prefix FROM l LEFT JOIN k USING (host) GROUP BY host""")
def u3_common_prefix(t):
    lists = t("pages").select(F.split(F.element_at(F.split("url", "//"), 2), "/")[0].alias("host"), F.split("url", "/").alias("parts"))
    return tables.common_prefix(lists, "host", "parts").select("host", F.col("n_prefix").cast("long").alias("n_prefix"))


@query("""SELECT kind, count(*) AS n, count(balance) AS balances, count(price) AS prices FROM (
SELECT 'c' AS kind, c_acctbal AS balance, NULL AS price FROM customer UNION ALL SELECT 's', s_acctbal, NULL FROM supplier UNION ALL SELECT 'p', NULL, p_retailprice FROM part) GROUP BY kind""")
def u4_merge(t):
    both = tables.merge(t("customer").select(F.lit("c").alias("kind"), F.col("c_acctbal").alias("balance")), t("supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("balance")), t("part").select(F.lit("p").alias("kind"), F.col("p_retailprice").alias("price")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.count("balance").alias("balances"), F.count("price").alias("prices"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def r19_first_per_species(t):
    return tables.first_per_key(t("documents"), "source", "doc_id").select("doc_id", "source")


@query("""WITH k AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS m FROM part), e AS (SELECT p_partkey, unnest(m) AS member FROM k) SELECT member, count(DISTINCT p_partkey) AS n FROM e GROUP BY member""")
def p11_unnest_set(t):
    rows, members = tables.unnest_set(t("part").select("p_partkey", F.translate(F.concat_ws(" ", "p_name", "p_type"), " ", ",").alias("words")), "words")
    return rows.join(members, "set_id").groupBy("member").agg(F.count_distinct("p_partkey").alias("n"))


@query("""SELECT array_to_string(regexp_split_to_array(trim(p_name), '\\s+')[1:1], ' ') AS genus, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY ALL""")
def p12_first_words(t):
    return t("part").groupBy(text.first_words(F.col("p_name"), 1).alias("genus")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("""SELECT c_nationkey, floor(o_totalprice / 50000) * 50000 AS bucket, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def p21_histogram(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", stats.bucket(F.col("o_totalprice"), 50000.0).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT * FROM (VALUES (0.02), (0.05)) a (d), (VALUES (10.0), (25.0), (40.0)) b (q)) SELECT d, q, count(l_orderkey) AS n FROM g LEFT JOIN lineitem ON l_discount >= d AND l_quantity >= q GROUP BY ALL""")
def p22_param_grid(t):
    counts = tables.grid_counts(t("lineitem"), {"l_discount": [0.02, 0.05], "l_quantity": [10.0, 25.0, 40.0]})
    return counts.select(F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"), "n")


RULES = [text.Rule("secure", "^https://([^/]+).*$", "$1"), text.Rule("mobile", r"^http://m\.([^/]+).*$", "$1"), text.Rule("plain", "^http://([^/]+).*$", "$1")]


@query(r"""SELECT id_type, id_form, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '^http://m\.') THEN 'mobile' WHEN regexp_matches(url, '^http://') THEN 'plain' END AS id_type,
CASE WHEN regexp_matches(url, '^https://') THEN regexp_extract(url, '^https://([^/]+)', 1) WHEN regexp_matches(url, '^http://m\.') THEN regexp_extract(url, '^http://m\.([^/]+)', 1) WHEN regexp_matches(url, '^http://') THEN regexp_extract(url, '^http://([^/]+)', 1) END AS id_form FROM pages) GROUP BY ALL""")
def p7_classify_ids(t):
    return text.classify(t("pages"), "url", RULES).groupBy("id_type", "id_form").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last_status, '-') AS last_status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def j2_left_with_default(t):
    last = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("last_status", F.lit("-")).alias("last_status"))


@query("""SELECT coalesce(s, c) AS nation, CASE WHEN s IS NULL THEN 'right' WHEN c IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT s_nationkey AS s FROM supplier) FULL JOIN (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY') ON s = c""")
def j3_full_outer(t):
    s, c = t("supplier").select(F.col("s_nationkey").alias("s")).distinct(), t("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("c")).distinct()
    return s.join(c, F.col("s") == F.col("c"), "full").select(F.coalesce("s", "c").alias("nation"), F.when(F.col("s").isNull(), "right").when(F.col("c").isNull(), "left").otherwise("both").alias("side"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j4_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j5_anti(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""SELECT r_name, n_name, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(l_extendedprice), 2) AS price FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def j12_path_join(t):
    path = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("customer"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return path.groupBy("r_name", "n_name").agg(F.count_distinct("o_orderkey").alias("orders"), F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""WITH c AS (SELECT count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') AS n FROM lineitem)
SELECT p_brand, round(count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') / any_value(r), 6) AS resistant, round(count(DISTINCT l_orderkey) FILTER (l_returnflag = 'N') / any_value(n), 6) AS susceptible FROM lineitem JOIN part ON l_partkey = p_partkey, c GROUP BY p_brand""")
def j13_two_cohorts(t):
    lines = t("lineitem")
    sizes = lines.agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("r"), F.count_distinct(F.when(F.col("l_returnflag") == "N", F.col("l_orderkey"))).alias("n"))
    counts = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("a"), F.count_distinct(F.when(F.col("l_returnflag") == "N", F.col("l_orderkey"))).alias("b"))
    return counts.crossJoin(F.broadcast(sizes)).select("p_brand", F.round(F.col("a") / F.col("r"), 6).alias("resistant"), F.round(F.col("b") / F.col("n"), 6).alias("susceptible"))
