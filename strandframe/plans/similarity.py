"""K-mer similarity, representatives and signatures. Sequences are the letters a-z of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import graph, kmers, reps, signatures
from .registry import query

S = "lower(regexp_replace({}, '[^A-Za-z]', '', 'g'))"
ITEMS = f"items AS (SELECT item_id, {S.format('text')} AS seq FROM benchmark)"
DOCS = f"docs AS (SELECT doc_id, lang, source, {S.format('text')} AS seq FROM documents)"
TURNS = f"turns AS (SELECT conv_id, turn, conv_id * 1000 + turn AS read_id, {S.format('text')} AS seq FROM conversations)"


def cut(name: str, table: str, cols: str, k: int) -> str:
    return f"{name} AS (SELECT {cols}, substr(seq, i::INT, {k}) AS kmer FROM (SELECT {cols}, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {table}))"


SCORES = f"""WITH {ITEMS}, {DOCS}, {cut('ik', 'items', 'item_id', 12)}, {cut('dk', 'docs', 'doc_id', 12)}, s AS (SELECT doc_id, item_id, count(*) AS score FROM (SELECT DISTINCT doc_id, kmer FROM dk) JOIN ik USING (kmer) GROUP BY ALL)"""
PAIRS = f"""WITH {ITEMS}, {cut('k0', 'items', 'item_id', 5)}, k AS (SELECT DISTINCT * FROM k0), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS score FROM k x JOIN k y USING (kmer) WHERE x.item_id <> y.item_id GROUP BY ALL HAVING count(*) >= 4)"""


def items(t):
    return t("benchmark").select("item_id", seq.normalize(F.col("text"), "letters").alias("seq"))


def docs(t):
    return t("documents").select("doc_id", "lang", "source", seq.normalize(F.col("text"), "letters").alias("seq"))


def turns(t):
    return t("conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), seq.normalize(F.col("text"), "letters").alias("seq"))


def doc_scores(t):
    return kmers.pair_similarity(docs(t), items(t), "doc_id", "item_id", "seq", 12)


def item_pairs(t):
    return kmers.all_pairs(items(t), "item_id", "seq", 5)


@query(f"WITH {ITEMS}, {cut('k', 'items', 'item_id', 8)} SELECT item_id, count(*) AS n, count(DISTINCT kmer) AS kinds, count(*) - 1 AS without_tail FROM k GROUP BY item_id")
def k1_kmers(t):
    kept = kmers.explode(items(t), "item_id", "seq", 8).groupBy("item_id").agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("kinds"))
    return kept.join(kmers.explode(items(t), "item_id", "seq", 8, tail="drop").groupBy("item_id").agg(F.count("*").alias("without_tail")), "item_id")


DNA = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"WITH {ITEMS}, d AS (SELECT item_id, {DNA.format('seq')} AS seq FROM items), {cut('k', 'd', 'item_id', 12)} SELECT item_id, regexp_replace(kmer, '(..).', '\\1', 'g') AS kmer, count(*) AS n FROM k GROUP BY ALL")
def k2_spaced_kmers(t):
    dna = t("benchmark").select("item_id", seq.as_dna(F.col("text")).alias("seq"))
    return kmers.explode_spaced(dna, "item_id", "seq", 8).groupBy("item_id", "kmer").agg(F.count("*").alias("n"))


@query(f"{SCORES} SELECT * FROM s")
def k3_pair_similarity(t):
    return doc_scores(t)


@query(f"{PAIRS} SELECT * FROM p")
def k4_all_pairs(t):
    return item_pairs(t)


@query(f"""WITH {ITEMS}, k AS (SELECT item_id, substr(seq, i::INT, 5) AS kmer FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 5 + 1)) AS i FROM items)), d AS (SELECT DISTINCT * FROM k)
SELECT d.item_id AS a, k.item_id AS b, count(*) AS score FROM d JOIN k USING (kmer) WHERE d.item_id <> k.item_id GROUP BY ALL HAVING count(*) >= 4""")
def k4_all_pairs_occurrences(t):
    return kmers.all_pairs_occurrences(items(t), "item_id", "seq", 5)


@query(f"{SCORES} SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1")
def k5_best_representative(t):
    return reps.find(doc_scores(t), "doc_id", "item_id")


@query(f"{SCORES} SELECT doc_id, item_id, score FROM documents LEFT JOIN (FROM s WHERE score >= 20) USING (doc_id)")
def k6_close_representatives(t):
    return reps.list_close(doc_scores(t), t("documents"), "doc_id", "item_id", 20)


@query(f"{SCORES} SELECT doc_id, count(item_id) AS n FROM documents LEFT JOIN (FROM s WHERE score >= 20) USING (doc_id) GROUP BY doc_id")
def k7_count_close(t):
    return reps.count_close(doc_scores(t), t("documents"), "doc_id", 20)


@query(f"{PAIRS}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS i FROM p WHERE score >= 10) SELECT a, (i - 1) // 10 AS part, array_to_string(list(b ORDER BY i), ',') AS neighbors FROM r GROUP BY ALL")
def k8_neighbor_lists(t):
    return reps.neighbor_lists(item_pairs(t), 10, 10).withColumn("neighbors", F.array_join(F.col("neighbors").cast("array<string>"), ","))


@query(f"{PAIRS} SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p QUALIFY rank <= 5")
def k9_closest_n(t):
    return reps.closest_n(item_pairs(t), 5)


@query(f"{SCORES} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5")
def k10_top_matches(t):
    return kmers.top_matches(doc_scores(t), "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


SIGS = f"WITH {DOCS}, {TURNS}, {cut('dk', 'docs', 'lang', 10)}, {cut('tk', 'turns', 'conv_id, read_id', 10)}, sig AS (SELECT kmer, min(lang) AS lang FROM dk GROUP BY kmer HAVING count(DISTINCT lang) = 1), tot AS (SELECT lang, count(*) AS total FROM sig GROUP BY lang)"


def lang_signatures(t):
    return signatures.of_letters(docs(t), "lang", "seq", 10)


def turn_codes(t, by):
    return kmers.coded(turns(t), by, "seq", 10)


def turn_kmers(t, k=10):
    return kmers.explode(turns(t), ["conv_id", "read_id"], "seq", k)


@query(f"{SIGS} SELECT lang, count(*) AS n, min(kmer) AS least, max(kmer) AS largest FROM sig GROUP BY lang")
def k12_signatures(t):
    return lang_signatures(t).groupBy("lang").agg(F.count("*").alias("n"), *(kmers.decoded(f("kmer"), 10).alias(c) for c, f in (("least", F.min), ("largest", F.max))))


@query(f"{SIGS} SELECT conv_id, lang, count(DISTINCT kmer) AS seen, any_value(total) AS total, round(100.0 * count(DISTINCT kmer) / any_value(total), 6) AS percent FROM tk JOIN sig USING (kmer) JOIN tot USING (lang) GROUP BY conv_id, lang")
def k13_evidence(t):
    return signatures.evidence(turn_codes(t, "conv_id"), lang_signatures(t), "conv_id", "lang").withColumn("percent", F.round("percent", 6))


@query(f"{SIGS}, h AS (SELECT read_id, lang, count(*) * 1000 / any_value(total) AS score FROM tk JOIN sig USING (kmer) JOIN tot USING (lang) GROUP BY ALL) SELECT read_id, lang, round(score, 6) AS score FROM h QUALIFY rank() OVER (PARTITION BY read_id ORDER BY score DESC) = 1")
def k14_assign_scaled(t):
    return signatures.assign(turn_codes(t, "read_id"), lang_signatures(t), "read_id", "lang", 0, signatures.scaled).withColumn("score", F.round("score", 6))


@query(f"{SIGS} SELECT * FROM (SELECT read_id, lang, count(*) AS score FROM tk JOIN sig USING (kmer) GROUP BY ALL HAVING count(*) >= 2) QUALIFY rank() OVER (PARTITION BY read_id ORDER BY score DESC) = 1")
def k14_assign_raw(t):
    return signatures.assign(turn_codes(t, "read_id"), lang_signatures(t), "read_id", "lang", 2)


@query(f"WITH {ITEMS}, {TURNS}, {cut('ik', 'items', 'item_id', 6)}, {cut('tk', 'turns', 'read_id', 6)} SELECT read_id, item_id, count(*) AS hits FROM tk JOIN (SELECT DISTINCT kmer, item_id FROM ik) USING (kmer) GROUP BY ALL HAVING count(*) >= 5")
def k15_group_hits(t):
    return kmers.group_hits(turn_kmers(t, 6), kmers.explode(items(t), "item_id", "seq", 6), "read_id", "item_id")


@query(f"""{SIGS}, v AS (SELECT read_id, lang, count(*) AS v FROM tk JOIN sig USING (kmer) GROUP BY ALL), b AS (SELECT *, row_number() OVER w AS i, coalesce(lead(v) OVER w, 0) AS nxt FROM v WINDOW w AS (PARTITION BY read_id ORDER BY v DESC, lang))
SELECT r.read_id, CASE WHEN v >= 2 * nxt THEN lang ELSE 'unknown' END AS lang, coalesce(v, 0) AS votes FROM (SELECT DISTINCT read_id FROM tk) r LEFT JOIN (FROM b WHERE i = 1) b USING (read_id)""")
def k16_annotate(t):
    return kmers.voted(lang_signatures(t), turn_codes(t, "read_id"), "lang", "read_id", "unknown")


@query(f"WITH {DOCS}, {cut('dk', 'docs', 'source', 24)}, k AS (SELECT DISTINCT source, kmer FROM dk) SELECT x.source AS a, y.source AS b, count(*) AS kmers FROM k x JOIN k y USING (kmer) WHERE x.source < y.source GROUP BY ALL")
def k17_connections(t):
    return kmers.connections(kmers.explode(docs(t), "source", "seq", 24), "source", source=t("documents"))


@query(f"""WITH {ITEMS}, {TURNS}, {cut('ik', 'items', 'item_id', 10)}, {cut('tk', 'turns', 'conv_id, read_id', 10)}, h AS (SELECT read_id, item_id, count(*) AS hits FROM tk JOIN (SELECT DISTINCT kmer, item_id FROM ik) USING (kmer) GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT read_id, max(hits) AS h FROM h GROUP BY read_id) SELECT conv_id, count(*) FILTER (coalesce(h, 0) >= 6) AS likely, count(*) FILTER (coalesce(h, 0) BETWEEN 3 AND 5) AS distant, count(*) FILTER (coalesce(h, 0) < 3) AS none FROM (SELECT DISTINCT conv_id, read_id FROM turns) LEFT JOIN m USING (read_id) GROUP BY conv_id""")
def k18_screen_reads(t):
    hits = kmers.group_hits(turn_kmers(t), kmers.explode(items(t), "item_id", "seq", 10), "read_id", "item_id", 2)
    reads = turns(t)
    return kmers.screen_reads(hits.join(reads.select("conv_id", "read_id"), "read_id"), reads, "conv_id", "read_id", 3, 6)


@query(f"{SIGS} SELECT lang, coalesce(total, 0) AS n FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN tot USING (lang)")
def k19_signature_summary(t):
    return signatures.summary(lang_signatures(t), t("documents"), "lang")


@query(f"WITH {DOCS} SELECT right(seq, 16) AS tail, count(*) AS count FROM docs WHERE length(seq) >= 16 GROUP BY 1 HAVING count(*) > 1")
def k20_shared_tails(t):
    return kmers.tails(docs(t), "doc_id", "seq", 16).groupBy("tail").count().where("count > 1")


@query(f"""WITH {DOCS}, e AS (SELECT doc_id, seq, right(seq, 16) AS tail FROM docs WHERE length(seq) >= 16), g AS (SELECT tail FROM e GROUP BY tail HAVING count(*) > 1),
l AS (SELECT DISTINCT first(doc_id ORDER BY length(seq) DESC, doc_id) AS set_id FROM e JOIN g USING (tail) GROUP BY tail), {cut('dk', 'docs', 'doc_id', 24)},
s AS (SELECT set_id, k.doc_id AS member FROM (SELECT DISTINCT set_id, kmer FROM l JOIN dk ON set_id = doc_id) JOIN dk k USING (kmer) GROUP BY ALL HAVING count(*) >= 200 UNION ALL SELECT set_id, set_id FROM l) SELECT member, min(set_id) AS set_id FROM s GROUP BY member""")
def k21_very_similar_sets(t):
    d = docs(t)
    tails, lengths = kmers.tails(d, "doc_id", "seq", 16), d.select("doc_id", F.length("seq").alias("length"))
    longest = graph.written(reps.longest_of_tails(tails, lengths, "doc_id"))
    sets = d.join(longest.withColumnRenamed("set_id", "doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "a")
    pairs = kmers.common_letters(sets, d.withColumnRenamed("doc_id", "b"), "a", "b", "seq", 24)
    return reps.very_similar_sets(tails, lengths, pairs, "doc_id")


def item_nodes(t):
    return t("benchmark").select(F.col("item_id").alias("node"), F.length("text").alias("l")).select("node", (-F.col("l")).alias("rank"))


THIN = f"""WITH RECURSIVE {PAIRS[5:]}, o AS (SELECT item_id AS node, row_number() OVER (ORDER BY -length(text), item_id) AS i FROM benchmark), n AS (SELECT i, node, list(b) FILTER (b IS NOT NULL) AS near FROM o LEFT JOIN (FROM p WHERE score >= 12) ON a = node GROUP BY ALL),
w AS (SELECT 0::BIGINT AS i, [NULL::BIGINT] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, coalesce(n.near, [])) THEN w.kept ELSE list_append(w.kept, n.node) END FROM w JOIN n ON n.i = w.i + 1),
firsts AS (SELECT node FROM (SELECT unnest(kept) AS node FROM w WHERE i = (SELECT max(i) FROM w)) WHERE node IS NOT NULL)"""


@query(f"{THIN} SELECT node FROM firsts")
def r1_thin(t):
    return reps.thin(item_pairs(t), item_nodes(t), 12)


@query(f"""WITH RECURSIVE {PAIRS[5:]}, o AS (SELECT item_id AS node, row_number() OVER (ORDER BY -length(text), item_id) AS i FROM benchmark), n AS (SELECT i, node, coalesce(list({{'b': b, 's': score}}) FILTER (b IS NOT NULL), []) AS near FROM o LEFT JOIN p ON a = node GROUP BY ALL),
w AS (SELECT t, 0::BIGINT AS i, [NULL::BIGINT] AS kept FROM range(1, 65) r(t) UNION ALL SELECT w.t, n.i, CASE WHEN list_has_any(w.kept, list_transform(list_filter(n.near, lambda x: x.s >= w.t), lambda x: x.b)) THEN w.kept ELSE list_append(w.kept, n.node) END FROM w JOIN n ON n.i = w.i + 1),
f AS (FROM w WHERE i = (SELECT max(i) FROM w) ORDER BY abs(len(kept) - 1 - 20), t LIMIT 1) SELECT node, t::INT AS threshold FROM (SELECT t, unnest(kept) AS node FROM f) WHERE node IS NOT NULL""")
def r2_n_reps(t):
    threshold, kept = reps.n_reps(item_pairs(t), item_nodes(t), 20, list(range(1, 65)))
    return kept.withColumn("threshold", F.lit(threshold))


@query(f"""{THIN} SELECT a AS node, b AS rep, score FROM p JOIN o x ON x.node = a JOIN o y ON y.node = b WHERE score >= 12 AND b IN (FROM firsts) AND a NOT IN (FROM firsts) AND y.i < x.i QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1
UNION ALL SELECT node, node, NULL FROM firsts""")
def r3_crude(t):
    return reps.crude(item_pairs(t), item_nodes(t), 12)


@query(f"{SCORES}, b AS (SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1) SELECT doc_id, item_id, coalesce(score, 0) AS score, CASE WHEN score >= 60 THEN 'represented' WHEN score >= 15 THEN 'middle' ELSE 'outlier' END AS class FROM documents LEFT JOIN b USING (doc_id)")
def r4_check(t):
    return reps.check(doc_scores(t), t("documents"), "doc_id", "item_id", 60, 15)


def cover_sql(nodes: str, edges: str, kind: str, least: int) -> str:
    """Greedy cover, one pick after the other: v (rep, members) of a table nodes (node) and edges (a, b) in both directions."""
    return f"""nb AS (SELECT list({{'node': node, 'near': near}}) AS every FROM (SELECT node, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near FROM {nodes} LEFT JOIN {edges} ON a = node GROUP BY node)),
cv AS (SELECT NULL::{kind} AS rep, NULL::{kind}[] AS members, (SELECT list(node) FROM {nodes}) AS rest
UNION ALL SELECT pick, members, list_filter(rest, lambda x: NOT list_contains(members, x)) FROM (
  SELECT rest, pick, list_prepend(pick, list_intersect(list_filter(every, lambda x: x.node = pick)[1].near, rest)) AS members FROM (
    SELECT rest, every, list_min(list_transform(list_filter(every, lambda x: list_contains(rest, x.node)), lambda x: {{'k': -len(list_intersect(x.near, rest)), 'node': x.node}})).node AS pick FROM cv, nb WHERE len(rest) > 0)) WHERE len(members) >= {least})"""


@query(f"""WITH RECURSIVE {PAIRS[5:]}, nd AS (SELECT item_id AS node FROM benchmark), ed AS (SELECT a, b FROM p WHERE score >= 12), {cover_sql('nd', 'ed', 'BIGINT', 2)} SELECT rep, unnest(members) AS member FROM cv WHERE rep IS NOT NULL""")
def r5_cover(t):
    return reps.cover(item_pairs(t), t("benchmark").select(F.col("item_id").alias("node")), 12)


BEST = "b AS (SELECT doc_id, item_id, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1)"


@query(f"""{SCORES}, {BEST}, {PAIRS[5:].replace('items AS', 'items2 AS').replace('FROM items)', 'FROM items2)')}, n AS (SELECT a AS query, b AS item_id, score AS s0 FROM p WHERE score >= 10),
g AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS i FROM b QUALIFY i <= 3), r AS (SELECT * FROM n JOIN g USING (item_id)),
z AS (SELECT query, item_id, s0, count(*) AS c FROM r GROUP BY ALL), w AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY query ORDER BY s0 DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
SELECT r.query, r.item_id, r.doc_id, r.s0 AS score FROM r JOIN w ON r.query = w.query AND r.item_id = w.item_id WHERE before < 8""")
def r7_region(t):
    members = reps.find(doc_scores(t), "doc_id", "item_id")
    close = item_pairs(t).select(F.col("a").alias("query"), F.col("b").alias("item_id"), "score")
    return reps.region(close, members, "query", "item_id", "doc_id", size=8, per_group=3, least=10)


@query(f"{SCORES}, {BEST} SELECT item_id, count(doc_id) AS members FROM benchmark LEFT JOIN b USING (item_id) GROUP BY item_id")
def r10_group_sizes(t):
    return reps.stats(t("benchmark"), reps.find(doc_scores(t), "doc_id", "item_id"), "item_id")


@query("""WITH g AS (SELECT 'source' AS db, source AS grp FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'size', floor(n_chars / 500)::VARCHAR FROM documents), z AS (SELECT db, grp, count(*) AS n FROM g GROUP BY ALL)
SELECT db, count(*) AS groups, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n >= 100) AS large, round(CASE WHEN count(*) > 1 THEN (sum(n) - max(n)) / (count(*) - 1) END, 6) AS interior_mean FROM z GROUP BY db""")
def r11_compare(t):
    d = t("documents")
    one = lambda db, c: d.select(F.lit(db).alias("db"), c.cast("string").alias("grp"))
    return reps.compare(one("source", F.col("source")).unionByName(one("lang", F.col("lang"))).unionByName(one("size", F.floor(F.col("n_chars") / 500))), "db", "grp").withColumn("interior_mean", F.round("interior_mean", 6))


@query(f"""{SCORES}, {BEST}, x AS (SELECT DISTINCT item_id, rank, taxon FROM (SELECT item_id, 'lang' AS rank, lang AS taxon FROM b JOIN documents USING (doc_id) UNION ALL SELECT item_id, 'source', source FROM b JOIN documents USING (doc_id)))
SELECT rank, round(count(*) / count(DISTINCT item_id), 6) AS taxa_per_group, round(count(*) / count(DISTINCT taxon), 6) AS groups_per_taxon FROM x GROUP BY rank""")
def r12_taxonomy_fit(t):
    groups = reps.find(doc_scores(t), "doc_id", "item_id").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    return reps.taxonomy_fit(groups, "item_id", ["lang", "source"]).withColumns({c: F.round(c, 6) for c in ("taxa_per_group", "groups_per_taxon")})


@query("""WITH z AS (SELECT l_suppkey, count(*) AS n, min(l_quantity) AS min_l_quantity, round(avg(l_quantity), 6) AS avg_l_quantity, max(l_quantity) AS max_l_quantity, round(stddev_samp(l_quantity), 6) AS sd_l_quantity,
min(l_tax) AS min_l_tax, round(avg(l_tax), 6) AS avg_l_tax, max(l_tax) AS max_l_tax, round(stddev_samp(l_tax), 6) AS sd_l_tax, corr(l_quantity, l_tax) AS r FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1)
SELECT * EXCLUDE (r), round(CASE WHEN max_l_quantity - min_l_quantity <= 1 AND max_l_tax - min_l_tax <= 1 THEN 1 ELSE r END, 6) AS correlation FROM z""")
def r15_distance_stats(t):
    out = reps.role_distance_stats(t("lineitem"), "l_suppkey", "l_quantity", "l_tax")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c[:3] in ("avg", "sd_", "cor")})


@query(f"{SCORES} SELECT doc_id, item_id, score FROM s WHERE score >= 20 QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) = 1 AND rank() OVER (PARTITION BY item_id ORDER BY score DESC) = 1")
def r18_bidirectional_best(t):
    return reps.bidirectional_best(doc_scores(t), "doc_id", "item_id", 20)


@query(f"""{SCORES}, m AS (SELECT doc_id, item_id FROM s WHERE score >= 20 QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) = 1 AND rank() OVER (PARTITION BY item_id ORDER BY score DESC) = 1)
SELECT 'left' AS side, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m) UNION ALL SELECT 'right', item_id::VARCHAR FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM m)""")
def r18_orphans(t):
    return reps.orphans(reps.bidirectional_best(doc_scores(t), "doc_id", "item_id", 20), t("documents"), t("benchmark"), "doc_id", "item_id")


@query(f"""{SCORES}, m AS (SELECT doc_id, item_id FROM s WHERE score >= 20 QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY score DESC) = 1 AND rank() OVER (PARTITION BY item_id ORDER BY score DESC) = 1),
wd AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), wi AS (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark),
wdk AS (SELECT DISTINCT doc_id, w, substr(w, i::INT, 4) AS kmer FROM (SELECT doc_id, w, unnest(range(1, length(w) - 2)) AS i FROM wd)), wik AS (SELECT DISTINCT item_id, w, substr(w, i::INT, 4) AS kmer FROM (SELECT item_id, w, unnest(range(1, length(w) - 2)) AS i FROM wi)),
x AS (SELECT doc_id, item_id, wdk.w AS p, wik.w AS q, count(*) AS n FROM m JOIN wdk USING (doc_id) JOIN wik USING (item_id, kmer) GROUP BY ALL),
b AS (SELECT doc_id, item_id, count(*) AS pairs FROM (FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, p ORDER BY n DESC, q) = 1 AND row_number() OVER (PARTITION BY doc_id, item_id, q ORDER BY n DESC, p) = 1) GROUP BY ALL),
wn1 AS (SELECT doc_id, count(DISTINCT w) AS wn1 FROM wdk GROUP BY 1), wn2 AS (SELECT item_id, count(DISTINCT w) AS wn2 FROM wik GROUP BY 1)
SELECT doc_id, item_id, coalesce(pairs, 0) AS pairs, round(CASE WHEN pairs > 0 THEN 100 * pairs / (pairs + (coalesce(wn1, 0) + coalesce(wn2, 0) - 2 * pairs) / 2) ELSE 0 END, 6) AS score FROM m LEFT JOIN b USING (doc_id, item_id) LEFT JOIN wn1 USING (doc_id) LEFT JOIN wn2 USING (item_id)""")
def r18_match_scores(t):
    """Documents and items that match, and how many of their words are each other's best by shared 4-mers."""
    matches = reps.bidirectional_best(doc_scores(t), "doc_id", "item_id", 20)

    def words(df, key):
        each = df.select(key, F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
        return kmers.explode(each.withColumn("seq", F.col("word")), [key, "word"], "seq", 4)

    left = words(t("documents").join(matches.select("doc_id"), "doc_id", "left_semi"), "doc_id")
    scores = reps.match_scores(matches, left, words(t("benchmark"), "item_id"), "doc_id", "item_id", "word")
    return scores.withColumn("score", F.round("score", 6))


@query(f"""WITH {ITEMS}, {cut('ik', 'items', 'item_id', 5)}, k AS (SELECT DISTINCT item_id, kmer FROM ik), n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1), sh AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM k x JOIN k y USING (kmer) WHERE x.item_id <> y.item_id GROUP BY ALL),
d AS (SELECT p.item_id AS a, coalesce(1 - c / (u.n + v.n - c), 1) AS d FROM benchmark p JOIN benchmark q ON p.item_id <> q.item_id LEFT JOIN sh ON sh.a = p.item_id AND sh.b = q.item_id LEFT JOIN n u ON u.item_id = p.item_id LEFT JOIN n v ON v.item_id = q.item_id)
SELECT a AS item_id, count(*) AS n, round(min(d), 9) AS nearest, round(max(d), 9) AS farthest, round(avg(d), 6) AS mean FROM d GROUP BY a""")
def r10_distance_range(t):
    k = kmers.explode(items(t), "item_id", "seq", 5)
    near = reps.distances(k.withColumnRenamed("item_id", "a"), k.withColumnRenamed("item_id", "b"), "a", "b").where("a < b")
    out = reps.distance_range(near, t("benchmark"), "item_id")
    return out.select("item_id", "n", F.round("nearest", 9).alias("nearest"), F.round("farthest", 9).alias("farthest"), F.round("mean", 6).alias("mean"))


@query(f"{PAIRS} SELECT a, count(*) AS n, min(score) AS least, max(score) AS largest, round(avg(score), 6) AS mean FROM p GROUP BY a")
def r10_similarity_range(t):
    return reps.similarity_range(item_pairs(t)).withColumn("mean", F.round("mean", 6))


@query(f"""WITH RECURSIVE {PAIRS[5:]}, e AS (SELECT a, b FROM p WHERE score >= 25), c AS (SELECT item_id AS node, item_id AS r FROM benchmark UNION SELECT e.b, c.r FROM c JOIN e ON c.node = e.a) SELECT node, min(r) AS component FROM c GROUP BY node""")
def b28_components(t):
    return graph.components(t("benchmark").select(F.col("item_id").alias("node")), item_pairs(t).where("score >= 25"))
