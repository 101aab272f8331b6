"""Count matrices, predictors, roles and quality. Rows of matrices are orders, columns part types or brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrix, ml, quality, roles
from .registry import query

LP = "lp AS (SELECT l_orderkey AS row, p_type AS col, p_brand AS brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"
M = f"WITH {LP}, m AS (SELECT row, col, count(*) AS n FROM lp GROUP BY ALL)"


def lines(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))


def types(t):
    return matrix.role_counts(lines(t), "l_orderkey", "p_type")


def brands(t):
    return matrix.role_counts(lines(t), "l_suppkey", "p_brand")


@query(f"{M} SELECT * FROM m")
def m1_role_counts(t):
    return types(t)


@query(f"{M}, s AS (SELECT col, count(*) AS c FROM m GROUP BY col) SELECT x.col AS a, y.col AS b, count(*) AS both, round(100 * count(*) / any_value(c), 2) AS percent FROM m x JOIN m y ON x.row = y.row AND x.col <> y.col JOIN s ON s.col = x.col GROUP BY ALL HAVING count(*) >= 5 AND round(100 * count(*) / any_value(c), 2) >= 30")
def m2_cooccurrence(t):
    return matrix.cooccurrence(types(t), percent=30)


@query(f"{M} SELECT row, coalesce(sum(n) FILTER (col = 'ECONOMY'), 0)::BIGINT AS y, count(*) FILTER (col <> 'ECONOMY') AS others FROM m GROUP BY row")
def m3_partition(t):
    y, rest = matrix.partition(types(t), "ECONOMY")
    return y.join(rest.groupBy("row").agg(F.count("*").alias("others")), "row", "left").na.fill(0, ["others"])


@query("""WITH m AS (SELECT l_orderkey AS row, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE WHEN ('0x' || left(md5(concat_ws(':', '1', row)), 8))::BIGINT % 10000 < 8000 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, sum(n)::BIGINT AS n FROM m GROUP BY 1""")
def m4_split(t):
    train, test = matrix.split(types(t), 0.8)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count_distinct("row").alias("rows"), F.sum("n").alias("n"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS nation, l_partkey AS role, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.role, b.role) AS role, CASE WHEN a.role IS NULL THEN 'new' ELSE 'missing' END AS diff FROM (FROM p WHERE f = 'A') a FULL JOIN (FROM p WHERE f = 'R') b ON a.nation = b.nation AND a.role = b.role WHERE a.role IS NULL OR b.role IS NULL""")
def m5_profile_diff(t):
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), F.col("l_partkey").alias("role"), "l_returnflag")
    return matrix.profile_diff(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"), ["nation"])


@query("SELECT floor(i / 100)::BIGINT AS fold, count(*) AS n FROM range((SELECT count(*) FROM customer)) r(i) GROUP BY 1")
def m6_kfold_sizes(t):
    return matrix.kfold(t("customer"), "c_custkey", 100).groupBy("fold").agg(F.count("*").alias("n"))


NB = """r AS (SELECT DISTINCT l_orderkey AS row, p_type AS col FROM lineitem JOIN part ON l_partkey = p_partkey), p AS (SELECT *, ('0x' || left(md5(concat_ws(':', '1', row)), 8))::BIGINT % 5 AS fold FROM r),
rows AS (SELECT DISTINCT row, fold FROM p), f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), cols AS (SELECT DISTINCT col FROM p), n AS (SELECT f.fold, count(*) AS n FROM f JOIN rows ON rows.fold <> f.fold GROUP BY 1),
one AS (SELECT f.fold, cols.col, count(p.row) AS c FROM f CROSS JOIN cols LEFT JOIN p ON p.col = cols.col AND p.fold <> f.fold GROUP BY ALL),
two AS (SELECT f.fold, a.col AS y, b.col AS x, count(*) AS c FROM f JOIN p a ON a.fold <> f.fold JOIN p b ON a.row = b.row AND a.col <> b.col GROUP BY ALL),
w AS (SELECT fold, y, x, ny, n, (coalesce(c, 0) + 1) / (ny + 2) AS p1, (nx + 1) / (n + 2) AS q FROM (SELECT a.fold, a.col AS y, b.col AS x, a.c AS ny, b.c AS nx, n.n, two.c FROM one a JOIN one b ON a.fold = b.fold AND a.col <> b.col JOIN n ON n.fold = a.fold LEFT JOIN two ON two.fold = a.fold AND two.y = a.col AND two.x = b.col)),
base AS (SELECT fold, y, ln((any_value(ny) + 1) / (any_value(n) - any_value(ny) + 1)) + sum(ln((1 - p1) / (1 - q))) AS b FROM w GROUP BY ALL),
v AS (SELECT p.row, w.y, sum(ln(p1 / q) - ln((1 - p1) / (1 - q))) AS v FROM p JOIN w ON w.fold = p.fold AND w.x = p.col GROUP BY ALL),
s AS (SELECT base.y AS col, rows.fold, (b + coalesce(v, 0) > 0) = (p.row IS NOT NULL) AS hit FROM rows JOIN base USING (fold) LEFT JOIN v ON v.row = rows.row AND v.y = base.y LEFT JOIN p ON p.row = rows.row AND p.col = base.y),
acc AS (SELECT col, fold::INT AS fold, count(*) AS n, 100.0 * count(*) FILTER (hit) / count(*) AS accuracy FROM s GROUP BY ALL)"""


@query(f"WITH {NB} SELECT col, fold, n, round(accuracy, 6) AS accuracy FROM acc")
def m7_column_predictors(t):
    return ml.column_predictors(types(t)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {NB}, q AS (SELECT col, quantile_cont(accuracy, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q, avg(accuracy) AS mean FROM acc GROUP BY col)
SELECT col, round(q[1], 6) AS q0, round(q[2], 6) AS q1, round(q[3], 6) AS q2, round(q[4], 6) AS q3, round(q[5], 6) AS q4, round((q[2] + 2 * q[3] + q[4]) / 4, 6) AS trimean, round(q[4] - q[2], 6) AS iqr, round(mean, 6) AS mean
FROM q WHERE (q[2] + 2 * q[3] + q[4]) / 4 >= 50 AND q[4] - q[2] <= 10""")
def m10_select_roles(t):
    kept = ml.select_roles(ml.accuracy_summary(ml.column_predictors(types(t))), 50, 10)
    return kept.select("col", *(F.round(c, 6).alias(c) for c in ("q0", "q1", "q2", "q3", "q4", "trimean", "iqr", "mean")))


def predicted(t):
    """Counts of a supplier's brands (actual) and twice the returned ones (predicted)."""
    return lines(t).groupBy(F.col("l_suppkey").alias("genome"), F.col("p_brand").alias("role")).agg(F.count("*").alias("actual"), (2 * F.count_if(F.col("l_returnflag") == "R")).alias("predicted"))


PRED = "p AS (SELECT l_suppkey AS genome, p_brand AS role, count(*) AS actual, 2 * count(*) FILTER (l_returnflag = 'R') AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"WITH {PRED} SELECT role, count(*) AS n, count(*) FILTER (predicted = actual) AS exact, count(*) FILTER ((predicted > 0) = (actual > 0)) AS presence, count(*) FILTER (predicted > actual) AS over, count(*) FILTER (predicted < actual) AS under, median(predicted - actual) FILTER (predicted > actual) AS median_over FROM p GROUP BY role")
def m11_compare(t):
    return matrix.compare(predicted(t), ["role"], "predicted", "actual")


@query(f"WITH {PRED} SELECT role, count(DISTINCT genome) AS genomes, round(100 * count(DISTINCT genome) / (SELECT count(DISTINCT genome) FROM p), 6) AS percent FROM p WHERE predicted <> actual GROUP BY role")
def m12_significant(t):
    return matrix.significant(predicted(t), "role", "genome", "predicted", "actual").withColumn("percent", F.round("percent", 6))


@query(f"{M} SELECT row, count(*) AS n_roles, array_to_string(list(col ORDER BY col), ',') AS roles FROM m WHERE n = 1 GROUP BY row HAVING count(*) >= 3")
def m13_universal(t):
    return matrix.universal(types(t), 3).withColumn("roles", F.array_join("roles", ","))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type = 'purchase' ORDER BY event_id DESC) - 1 AS i FROM events), s AS (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN i * 3 ELSE i // 2 * 3 + i % 2 + 1 END AS seat FROM p)
SELECT * FROM s WHERE seat // 3 < (SELECT count(*) FROM events WHERE event_type = 'purchase')""")
def m15_interleave(t):
    return matrix.interleave(t("events").select("event_id", "event_type"), F.col("event_type") == "purchase", "event_id")


SPLIT = r"list_filter(list_transform(regexp_split_to_array(f, '\s+[/@]\s+|;\s+'), lambda r: trim(r)), lambda r: r <> '')"


def functions(t):
    """Function texts from part names, some with two roles."""
    return t("part").select("p_partkey", F.concat_ws(" / ", "p_name", "p_type").alias("function"))


@query(f"""WITH f AS (SELECT p_partkey, p_name || ' / ' || p_type AS f FROM part), r AS (SELECT p_partkey, unnest({SPLIT}) AS role FROM f), k AS (SELECT DISTINCT lower(p_name) AS n FROM part)
SELECT 'known' AS kind, role, count(*) AS n FROM r JOIN k ON n = lower(role) GROUP BY ALL UNION ALL SELECT DISTINCT 'unknown', role, NULL FROM r WHERE lower(role) NOT IN (FROM k)""")
def p8_map_roles(t):
    dictionary = t("part").select(F.lower("p_name").alias("role_id")).distinct().withColumn("checksum", roles.checksum(F.col("role_id")))
    known, unknown = roles.map_roles(functions(t), dictionary, "function")
    return known.groupBy(F.lit("known").alias("kind"), "role").agg(F.count("*").alias("n")).unionByName(unknown.select(F.lit("unknown").alias("kind"), "role", F.lit(None).cast("long").alias("n")))


@query("""SELECT p_brand AS role_id, coalesce(bool_or(p_type = 'ECONOMY'), false) AS subsystem, coalesce(bool_or(p_size > 48), false) AS experimental FROM part GROUP BY p_brand""")
def p9_role_flags(t):
    p = t("part").withColumn("role_id", F.col("p_brand"))
    return roles.flags(p.select("role_id").distinct(), p.where("p_type = 'ECONOMY'"), p.where("p_size > 48"))


@query("""WITH d AS (SELECT n_name AS role_id, n_nationkey AS ord FROM nation), a AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey),
m AS (SELECT b AS role_id, arg_min(a, ord) AS u FROM a JOIN d ON d.role_id = a GROUP BY b) SELECT role_id, ord, coalesce(u, role_id) AS unified FROM d LEFT JOIN m USING (role_id)""")
def p10_unify_roles(t):
    n = t("nation")
    d = n.select(F.col("n_name").alias("role_id"), F.col("n_nationkey").alias("ord"))
    x, y = n.select("n_regionkey", F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")), n.select("n_regionkey", F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))
    return roles.unify(d, x.join(y, "n_regionkey").where("i < j").select("a", "b"))


@query(f"""WITH {LP}, z AS (SELECT s_nationkey AS nation, count(DISTINCT l_suppkey) AS members FROM lp JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2),
r AS (SELECT s_nationkey AS nation, brand AS role, count(DISTINCT l_suppkey) AS n FROM lp JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT nation, role, n, members FROM r JOIN z USING (nation) WHERE n * 100 >= members * 90 QUALIFY count(*) OVER (PARTITION BY nation) >= 3""")
def r17_common_roles(t):
    rows = lines(t).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nation"), "l_suppkey", F.col("p_brand").alias("role"))
    return roles.common(rows, "nation", "l_suppkey", "role", 90, 2, 3)


FIG = "q AS (SELECT doc_id, n_chars, quality, toxic, 60 + n_chars % 41 AS fine, 50 + n_chars % 51 AS complete, n_chars % 21 AS contamination FROM documents JOIN labels USING (doc_id))"


def figures(t):
    n = F.col("n_chars")
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "n_chars", "quality", "toxic", (60 + n % 41).alias("fine"), (50 + n % 51).alias("complete"), (n % 21).alias("contamination"))


@query(f"WITH {FIG} SELECT doc_id, fine >= 85 AND complete >= 80 AND contamination <= 15 AND quality = 1 AS package, fine >= 85 AND complete >= 80 AND contamination <= 10 AND quality = 1 AS reps, CASE WHEN fine >= 90 THEN 'H' WHEN fine >= 75 THEN 'M' ELSE 'L' END AS tier FROM q")
def p14_gate_and_tier(t):
    args = F.col("fine"), F.col("complete"), F.col("contamination"), F.col("quality") == 1
    return figures(t).select("doc_id", quality.gate(*args).alias("package"), quality.gate(*args, preset="reps").alias("reps"), quality.tier(F.col("fine"), 90, 75).alias("tier"))


@query(f"WITH {FIG}, g AS (SELECT *, fine < 85 AS i, complete < 80 AS c, contamination > 15 AS x, quality = 1 AND NOT (fine < 85 OR complete < 80 OR contamination > 15) AS good FROM q) SELECT count(*) FILTER (NOT good AND i) AS inconsistent, count(*) FILTER (NOT good AND c) AS incomplete, count(*) FILTER (NOT good AND x) AS contaminated, count(*) FILTER (NOT good AND NOT (i OR c OR x)) AS other, toxic FROM g GROUP BY toxic")
def p16_reasons(t):
    args = F.col("fine"), F.col("complete"), F.col("contamination")
    why = quality.reasons(*args, quality.gate(*args, F.col("quality") == 1))
    return figures(t).groupBy("toxic").agg(*(F.count_if(c).alias(k) for k, c in why.items()))


@query("""WITH s AS (SELECT c_custkey, count(*) AS spots, sum(o_totalprice) AS bases FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) SELECT c_custkey, CASE WHEN spots < 5 THEN 'spots' WHEN bases < 1000000 THEN 'bases' WHEN bases / spots NOT BETWEEN 150000 AND 300000 THEN 'ratio' ELSE 'ok' END AS reason FROM s""")
def p17_sample_gate(t):
    s = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("spots"), F.sum("o_totalprice").alias("bases"))
    return quality.sample_gate(s, "spots", "bases", 5, 1_000_000, (150_000, 300_000)).select("c_custkey", "reason")


@query("SELECT l_orderkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1 AND min(l_quantity) BETWEEN 10 AND 40")
def p18_seed_gate(t):
    return quality.seed_gate(t("lineitem"), "l_orderkey", "l_quantity", 10, 40)


EV = "e AS (SELECT p_brand AS role, count(*) FILTER (l_returnflag = 'R') % 3 AS predicted, count(*) FILTER (l_linestatus = 'F') % 3 AS actual FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def evaluation(t):
    return lines(t).groupBy(F.col("p_brand").alias("role")).agg((F.count_if(F.col("l_returnflag") == "R") % 3).alias("predicted"), (F.count_if(F.col("l_linestatus") == "F") % 3).alias("actual"))


def features(t):
    return lines(t).select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("feature"), F.col("p_brand").alias("role"))


@query(f"WITH {EV} SELECT l_suppkey AS contig, count(DISTINCT l_partkey) FILTER (predicted = actual) AS good, count(DISTINCT l_partkey) FILTER (predicted <> actual) AS bad, count(DISTINCT l_partkey) FILTER (predicted IS NULL) AS unrated FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN e ON role = p_brand GROUP BY 1")
def m16_consistency(t):
    return quality.consistency(features(t), evaluation(t), "contig", "feature", "role")


@query(f"WITH {EV} SELECT s_suppkey AS contig FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN e ON role = p_brand WHERE predicted > 0 AND actual > 0)")
def m17_clean_contigs(t):
    return quality.clean_contigs(t("supplier").select(F.col("s_suppkey").alias("contig")), features(t), evaluation(t), "contig", "role", coarse=True)


@query("SELECT event_type, count(*) AS n FROM events WHERE ('0x' || left(md5(concat_ws(':', '1', event_id)), 8))::BIGINT % 10000 >= 2500 GROUP BY 1")
def m18_thin_features(t):
    return quality.thin_features(t("events"), "event_id", 25).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey AS c, max(o_orderkey) % 120 AS fine FROM orders GROUP BY 1) SELECT c_custkey, coalesce(CASE WHEN fine <= 100 THEN fine END, c_nationkey)::BIGINT AS fine FROM customer LEFT JOIN s ON c_custkey = c""")
def b26_merge_quality(t):
    scores = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderkey") % 120).alias("fine"))
    return quality.merge(t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("fine")), scores, "c_custkey", ["fine"])


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS old, count(*) FILTER (o_orderstatus = 'O') AS new, count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F') AS change FROM orders GROUP BY o_custkey HAVING old > 0 AND new > 0""")
def b26_compare_quality(t):
    n = lambda s: t("orders").where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return quality.compare(n("F"), n("O"), "o_custkey", "n")


@query(f"""WITH {NB}, a AS (SELECT col, list_sort(list(round(accuracy, 2))) AS a, round(avg(round(accuracy, 2)), 2) AS mean FROM acc GROUP BY col)
SELECT col, mean, a[1] AS q0, a[len(a) // 4 + 1] AS q1, a[len(a) // 2 + 1] AS q2, a[len(a) - len(a) // 4] AS q3, a[len(a)] AS q4, round((a[len(a) // 4 + 1] + 2 * a[len(a) // 2 + 1] + a[len(a) - len(a) // 4]) / 4, 6) AS trimean, round(a[len(a) - len(a) // 4] - a[len(a) // 4 + 1], 6) AS iqr FROM a""")
def m9_quartiles(t):
    """Quartiles over the folds that each column's predictor was held out on."""
    return ml.sweep_summary(ml.column_predictors(types(t)), ["col"]).withColumns({"trimean": F.round("trimean", 6), "iqr": F.round("iqr", 6)})


LOG = """l AS (SELECT o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS source, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS made FROM orders),
e AS (SELECT pos, made, last_value(source IGNORE NULLS) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS source FROM l), v AS (FROM e WHERE made IS NOT NULL AND source IS NOT NULL),
u AS (SELECT v.pos, v.made, v.source, (SELECT max(w.pos) FROM v w WHERE w.made = v.source AND w.pos < v.pos) AS up FROM v),
r AS (SELECT pos, made, source, source AS root FROM u WHERE up IS NULL UNION ALL SELECT u.pos, u.made, u.source, r.root FROM u JOIN r ON u.up = r.pos),
z AS (FROM r QUALIFY row_number() OVER (PARTITION BY made ORDER BY pos DESC) = 1)"""


@query(f"""WITH RECURSIVE {LOG} SELECT c.c_custkey || '.1' AS bin, coalesce(p.c_mktsegment, c.c_mktsegment) AS sample, c.c_name AS name, CASE WHEN z.made IS NOT NULL THEN q.c_name || ' (fine-trimmed)' ELSE '' END AS ref_name
FROM customer c LEFT JOIN z ON z.made = c.c_custkey LEFT JOIN customer p ON p.c_custkey = z.root LEFT JOIN customer q ON q.c_custkey = z.source""")
def b26_relabel(t):
    """Customers as bins; finished orders as lines that process one, the others as lines that create one."""
    number = F.concat(F.col("o_custkey").cast("string"), F.lit(".1"))
    log = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Processing "), number)).otherwise(F.concat(F.lit("Creating new GenomePackage "), number)).alias("line"))
    report = t("customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".1")).alias("bin"), F.col("c_mktsegment").alias("sample"), F.col("c_name").alias("name"), F.lit("").alias("ref_name"))
    return quality.relabel(report, log, "o_orderkey", "line", "bin", "sample", "name", "ref_name")
