"""Sequences, codons, alignments and dose-response groups.

DNA comes from the letters of conversation turns; aligned sequences are customers' names, equal in length, with zeros
as gaps; dose-response rows are line items (brand and type as drugs, nation as cell line).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq, text
from ..operators import align, codon, drugs, features, match, reads
from .registry import query

DNA = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
CODE = "code AS (SELECT substr('TCAG', i // 16 + 1, 1) || substr('TCAG', i // 4 % 4 + 1, 1) || substr('TCAG', i % 4 + 1, 1) AS codon, substr('" + seq.AMINO_ACIDS + "', i + 1, 1) AS aa FROM (SELECT unnest(range(64))::INT AS i))"
TURNS = f"t AS (SELECT conv_id, turn, {DNA} AS dna FROM conversations)"
GENES = f"{TURNS}, x AS (SELECT conv_id * 1000 + turn AS gene, dna, unnest(range(1, length(dna) // 3)) AS i, length(dna) // 3 AS k FROM t), c0 AS (SELECT gene, i, k, substr(dna, (3 * i + 1)::INT, 3) AS codon FROM x), c AS (SELECT gene, codon, count(*) AS n FROM c0 WHERE NOT (i = k - 1 AND codon IN ('TAA', 'TAG', 'TGA')) GROUP BY ALL)"


def turns(t):
    return t("conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("gene"), seq.as_dna(F.col("text")).alias("dna"))


def counts(t):
    return codon.counts(turns(t), "gene", "dna")


@query(f"WITH {TURNS} SELECT conv_id, turn, reverse(translate(dna, 'ACGT', 'TGCA')) AS seq FROM t")
def p2_reverse_complement(t):
    return turns(t).select("conv_id", "turn", seq.revcomp(F.col("dna")).alias("seq"))


@query(f"""WITH {CODE}, {TURNS}, s AS (SELECT conv_id, turn, '+' AS strand, dna AS d FROM t UNION ALL SELECT conv_id, turn, '-', reverse(translate(dna, 'ACGT', 'TGCA')) FROM t), f AS (SELECT *, unnest([0, 1, 2]) AS frame FROM s),
x AS (SELECT conv_id, turn, strand, frame, unnest(range(0, (length(d) - frame) // 3)) AS i, d FROM f) SELECT conv_id, turn, strand, frame, string_agg(aa, '' ORDER BY i) AS protein FROM x JOIN code ON codon = substr(d, (3 * i + frame + 1)::INT, 3) GROUP BY ALL""")
def p3_six_frames(t):
    return seq.translate_frames(turns(t).select("conv_id", "turn", "dna"), "dna").drop("dna")


@query(r"""WITH p AS (SELECT item_id, length(regexp_replace(upper(text), '[^A-Z]', '', 'g')) AS l, length(regexp_replace(upper(text), '[^ACGTUN]', '', 'g')) AS n, length(regexp_replace(upper(text), '[^U]', '', 'g')) AS u, length(regexp_replace(upper(text), '[^T]', '', 'g')) AS t FROM benchmark)
SELECT item_id, CASE WHEN l <= 10 THEN '' WHEN n < 0.75 * l THEN 'protein' WHEN u > t THEN 'RNA' ELSE 'DNA' END AS kind FROM p""")
def p5_guess_type(t):
    return t("benchmark").select("item_id", seq.guess_type(F.col("text")).alias("kind"))


@query(r"""WITH i AS (SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_linenumber || '_length_' || l_quantity::BIGINT || '_cov_' || l_suppkey || '.5' AS id FROM lineitem) SELECT l_orderkey, l_linenumber, regexp_extract(id, '^(\d+\.\d+)', 1) AS genome_id, regexp_extract(id, 'length_(\d+)', 1)::BIGINT AS length, regexp_extract(id, 'cov_([0-9.]+)', 1)::DOUBLE AS coverage FROM i""")
def p6_parse_id(t):
    i = t("lineitem").select("l_orderkey", "l_linenumber", F.concat("l_orderkey", F.lit("."), "l_linenumber", F.lit("_length_"), F.col("l_quantity").cast("long"), F.lit("_cov_"), "l_suppkey", F.lit(".5")).alias("id"))
    return i.select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in seq.parse_id(F.col("id")).items()))


@query("""WITH l AS (SELECT r_name || '; ' || n_name AS lineage FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT lineage, trim(split_part(lineage, ';', -1)) AS taxon, split_part(lineage, ';', 1) = 'ASIA' AS asian FROM l""")
def p13_lineage(t):
    l = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("; ", "r_name", "n_name").alias("lineage"))  # noqa: E741
    return l.select("lineage", text.last_taxon(F.col("lineage")).alias("taxon"), text.in_domain(F.col("lineage"), "ASIA").alias("asian"))


@query(f"""WITH {TURNS}, l AS (SELECT c.conv_id, c.turn, dna, 1 + c.turn * 7 AS b, CASE WHEN c.turn % 2 = 0 THEN '+' ELSE '-' END AS s FROM t c), p AS (SELECT *, CASE WHEN s = '-' THEN b - 29 ELSE b END AS lo FROM l), e AS (SELECT *, greatest(lo, 1) AS le, least(lo + 29, length(dna)) AS r FROM p), q AS (SELECT *, CASE WHEN r >= le THEN substr(dna, le::INT, (r - le + 1)::INT) ELSE '' END AS piece FROM e)
SELECT conv_id, turn, CASE WHEN s = '-' THEN reverse(translate(piece, 'ACGT', 'TGCA')) ELSE piece END AS piece FROM q""")
def p4_extract(t):
    c = turns(t)
    locations = c.select("gene", "conv_id", "turn", (1 + F.col("turn") * 7).alias("begin"), F.when(F.col("turn") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(30).alias("len"))
    return features.extract(c, locations, "gene", "dna", "begin", "strand", "len").select("conv_id", "turn", "piece")


@query(f"WITH {TURNS}, f AS (SELECT conv_id * 1000 + turn AS gene, dna, unnest(range(0, (length(dna) + 119) // 120)) AS fragment FROM t WHERE length(dna) > 0) SELECT gene, fragment, 120 * fragment + 1 AS start, substr(dna, (120 * fragment + 1)::INT, 120) AS piece FROM f WHERE length(substr(dna, (120 * fragment + 1)::INT, 120)) >= 40")
def b29_fragments(t):
    return match.fragments(turns(t), "gene", "dna", 120, 40)


@query(f"WITH {GENES} SELECT * FROM c")
def c1_codon_counts(t):
    return counts(t)


@query(f"WITH {CODE}, {GENES} SELECT aa, codon, coalesce(sum(n), 0)::BIGINT AS n FROM code LEFT JOIN c USING (codon) WHERE aa <> '*' GROUP BY ALL")
def c2_package_and_sum(t):
    return codon.total(codon.package(counts(t), "gene"), [])


@query(f"WITH {CODE}, {GENES}, s AS (SELECT aa, codon, coalesce(sum(n), 0) AS n FROM code LEFT JOIN c USING (codon) WHERE aa <> '*' GROUP BY ALL) SELECT aa, codon, round((n + 2.0 / count(*) OVER (PARTITION BY aa)) / (sum(n) OVER (PARTITION BY aa) + 2.0), 9)::DOUBLE AS freq FROM s")
def c3_frequencies(t):
    return codon.freqs(codon.total(codon.package(counts(t), "gene"), []), [], 2).withColumn("freq", F.round("freq", 9))


CHI = f"""{CODE}, {GENES}, tot AS (SELECT aa, codon, coalesce(sum(n), 0) AS n FROM code LEFT JOIN c USING (codon) WHERE aa NOT IN ('*', 'M', 'W') GROUP BY ALL), fr AS (SELECT aa, codon, (n + 1.0 / count(*) OVER (PARTITION BY aa)) / (sum(n) OVER (PARTITION BY aa) + 1.0) AS f FROM tot),
pk AS (SELECT g.gene, fr.aa, fr.codon, f, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT gene FROM c) g CROSS JOIN fr LEFT JOIN c ON c.gene = g.gene AND c.codon = fr.codon)"""


@query(f"WITH {CHI}, e AS (SELECT gene, aa, n, f * sum(n) OVER (PARTITION BY gene, aa) AS e FROM pk) SELECT gene, round(sum((n - e) ^ 2 / e), 6)::DOUBLE AS chi_square, count(*) - count(DISTINCT aa) AS df FROM e WHERE e > 0 GROUP BY gene")
def c4_chi_square(t):
    packaged = codon.package(counts(t), "gene", 18)
    f = codon.freqs(codon.total(packaged, []), [], 1)
    return codon.chi_square(packaged, "gene", f).select("gene", F.round("chi_square", 6).alias("chi_square"), "df")


def role_sets(t):
    """Frequency sets of the turns of each role."""
    of = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("gene"), "role")
    packaged = codon.package(counts(t), "gene", 18).join(of, "gene")
    return codon.freqs(packaged.groupBy("role", "aa", "codon").agg(F.sum("n").alias("n")), ["role"], 1)


SETS = f"{CODE}, {GENES}, o AS (SELECT conv_id * 1000 + turn AS gene, role FROM conversations), r AS (SELECT DISTINCT role FROM o JOIN c USING (gene)), ts AS (SELECT role, aa, codon, coalesce(sum(n), 0) AS n FROM r CROSS JOIN (FROM code WHERE aa NOT IN ('*', 'M', 'W')) k LEFT JOIN (SELECT role, codon, n FROM c JOIN o USING (gene)) z USING (role, codon) GROUP BY ALL), fs AS (SELECT role, aa, codon, (n + 1.0 / count(*) OVER w) / (sum(n) OVER w + 1.0) AS f FROM ts WINDOW w AS (PARTITION BY role, aa)), d AS (SELECT a.role AS a, b.role AS b, a.aa, abs(a.f - b.f) AS d FROM fs a JOIN fs b USING (codon) WHERE a.role < b.role)"


PVAL = """CASE WHEN d <= 0 OR x IS NULL THEN NULL WHEN x <= 0 THEN 1 WHEN x / 2 < d / 2 + 1 THEN greatest(0.0, 1 - exp(d / 2 * ln(x / 2) - x / 2 - lgamma(d / 2)) * list_reduce(list_concat([1.0::DOUBLE], list_transform(range(200, 0, -1), lambda i: i::DOUBLE)), lambda t, i: 1 + x / 2 / (d / 2 + i) * t) / (d / 2))
ELSE exp(d / 2 * ln(x / 2) - x / 2 - lgamma(d / 2)) / list_reduce(list_concat([x / 2 + 401 - d / 2], list_transform(range(200, 0, -1), lambda i: i::DOUBLE)), lambda t, i: x / 2 + 2 * i - 1 - d / 2 - i * (i - d / 2) / t) END"""


@query(f"""WITH {SETS}, g AS (SELECT DISTINCT gene FROM c), k AS (SELECT gene, fs.role, fs.aa, fs.codon, f, coalesce(c.n, 0) AS n FROM g CROSS JOIN fs LEFT JOIN c USING (gene, codon)), e AS (SELECT *, f * sum(n) OVER (PARTITION BY role, gene, aa) AS e FROM k),
y AS (SELECT role, gene, sum((n - e) ^ 2 / e) FILTER (e > 0) AS x, (count(*) FILTER (e > 0) - count(DISTINCT aa) FILTER (e > 0))::DOUBLE AS d, sum(n * ln(greatest(f, 1e-6))) AS l FROM e GROUP BY ALL), p AS (SELECT role, l, {PVAL} AS p FROM y)
SELECT role, round(sum(p ^ 0.3), 6) AS score, count(*) FILTER (p >= 0.05) AS genes, round(sum(l), 4) AS log_likelihood FROM p GROUP BY role""")
def c5_frequency_scores(t):
    scores = codon.freq_score(codon.package(counts(t), "gene", 18), "gene", role_sets(t), "role")
    return scores.select("role", F.round("score", 6).alias("score"), "genes", F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"WITH {SETS}, h AS (SELECT a, b, aa, sum(d) / 2 AS h FROM d GROUP BY ALL), z AS (SELECT a, b, sqrt(sum(d ^ 2)) AS d1, sum(d) AS d3 FROM d GROUP BY ALL) SELECT a, b, round(any_value(d1), 9)::DOUBLE AS euclid, round(sqrt(sum(h ^ 2)), 9)::DOUBLE AS halves, round(any_value(d3), 9)::DOUBLE AS sums FROM h JOIN z USING (a, b) GROUP BY a, b")
def c6_set_distances(t):
    s = role_sets(t)
    out = codon.distance(s, "role", 1).withColumnRenamed("distance", "euclid")
    for kind, name in ((2, "halves"), (3, "sums")):
        out = out.join(codon.distance(s, "role", kind).withColumnRenamed("distance", name), ["a", "b"])
    return out.select("a", "b", *(F.round(c, 9).alias(c) for c in ("euclid", "halves", "sums")))


ALN = "n AS (SELECT c_nationkey AS aln, c_custkey AS seq_id, replace(c_name, '0', '-') AS seq FROM customer)"
PAIR = f"{ALN}, m AS (SELECT x.seq_id, array_to_string(list_transform(range(1, length(x.seq) + 1), lambda i: CASE WHEN substr(x.seq, i::INT, 1) = '-' AND substr(y.seq, i::INT, 1) = '-' THEN '' WHEN substr(x.seq, i::INT, 1) = '-' THEN 'a' WHEN substr(y.seq, i::INT, 1) = '-' THEN 'b' WHEN substr(x.seq, i::INT, 1) = substr(y.seq, i::INT, 1) THEN '=' ELSE 'x' END), '') AS m FROM n x JOIN n y ON y.seq_id = x.seq_id + 1)"


def names(t):
    return t("customer").select(F.col("c_nationkey").alias("aln"), F.col("c_custkey").alias("seq_id"), F.translate("c_name", "0", "-").alias("seq"))


def name_pairs(t):
    n = names(t)
    return n.select("seq_id", F.col("seq").alias("x")).join(n.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("y")), "seq_id")


@query(f"""WITH {PAIR}, k AS (SELECT seq_id, m, length(regexp_replace(m, '[^=]', '', 'g')) AS matches, length(regexp_replace(m, '[^x]', '', 'g')) AS differences, length(regexp_replace(m, '[^ab]', '', 'g')) AS gaps, len(regexp_extract_all(m, 'a+|b+')) AS openings, regexp_extract(m, '^(a+|b+)', 1) AS h, regexp_extract(m, '(a+|b+)$', 1) AS e FROM m)
SELECT seq_id, matches, differences, gaps, openings, length(h) + length(e) AS end_gaps, round(matches / (matches + differences + gaps - length(h) - length(e)), 9) AS identity, round((differences + 0.5 * (openings - (h <> '')::INT - (e <> '')::INT) + 0.1 * (gaps - length(h) - length(e))) / (matches + differences + 0.5 * (openings - (h <> '')::INT - (e <> '')::INT) + 0.1 * (gaps - length(h) - length(e))), 9)::DOUBLE AS distance FROM k""")
def c7_pair_statistics(t):
    s = align.identity(align.distance(align.pair_stats(name_pairs(t), "x", "y"), 0.5, 0.1))
    return s.select("seq_id", "matches", "differences", "gaps", "openings", "end_gaps", F.round("identity", 9).alias("identity"), F.round("distance", 9).alias("distance"))


SCORED = f"""{ALN}, mat AS (SELECT substr(l, 1, 1) AS x, substr(l, 2, 1) AS y, s FROM (VALUES {", ".join(f"('{x}{y}', {v})" for (x, y), v in align.blosum62().items())}) v(l, s)),
pr AS (SELECT x.seq_id, upper(x.seq) AS a, upper(y.seq) AS b, greatest(length(regexp_extract(x.seq, '^-*')), length(regexp_extract(y.seq, '^-*'))) AS h, greatest(length(regexp_extract(x.seq, '-*$')), length(regexp_extract(y.seq, '-*$'))) AS e FROM n x JOIN n y ON y.seq_id = x.seq_id + 1),
ch AS (SELECT seq_id, i, h, length(a) - e AS z, substr(a, i::INT, 1) AS x, substr(b, i::INT, 1) AS y FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM pr)),
sc AS (SELECT seq_id, i, i > h AND i <= z AS mid, CASE WHEN x = '-' AND y = '-' THEN NULL WHEN x = '-' THEN 'a' WHEN y = '-' THEN 'b' ELSE '=' END AS kind, CASE WHEN x <> '-' AND y <> '-' THEN coalesce(s, -1) END AS s FROM ch LEFT JOIN mat USING (x, y)),
k AS (SELECT *, lag(kind) OVER (PARTITION BY seq_id ORDER BY i) AS before, lag(kind) OVER (PARTITION BY seq_id, mid ORDER BY i) AS before_inner FROM sc WHERE kind IS NOT NULL),
t AS (SELECT seq_id, sum(s) AS s, count(*) FILTER (s > 0) AS pos, count(*) AS n, count(*) FILTER (kind <> '=') AS g, count(*) FILTER (kind <> '=' AND kind IS DISTINCT FROM before) AS o,
  sum(s) FILTER (mid) AS s2, count(*) FILTER (s > 0 AND mid) AS pos2, count(*) FILTER (mid) AS n2, count(*) FILTER (kind <> '=' AND mid) AS g2, count(*) FILTER (kind <> '=' AND mid AND kind IS DISTINCT FROM before_inner) AS o2 FROM k GROUP BY seq_id)"""


@query(f"""WITH {SCORED} SELECT seq_id, round(CASE WHEN n > 0 THEN (coalesce(s, 0) - 11 * o - (g - o)) * 0.5 / n END, 9)::DOUBLE AS nbs, round(CASE WHEN n > 0 THEN pos / n END, 9) AS pos,
round(CASE WHEN n2 > 0 THEN (coalesce(s2, 0) - 11 * o2 - (g2 - o2)) * 0.5 / n2 END, 9)::DOUBLE AS nbs2, round(CASE WHEN n2 > 0 THEN pos2 / n2 END, 9) AS pos2 FROM (SELECT seq_id FROM pr) LEFT JOIN t USING (seq_id)""")
def x3_pair_measures(t):
    out = name_pairs(t).select("seq_id", *(align.measure(F.col("x"), F.col("y"), m).alias(m) for m in ("nbs", "pos", "nbs2", "pos2")))
    return out.select("seq_id", *(F.round(m, 9).alias(m) for m in ("nbs", "pos", "nbs2", "pos2")))


@query(f"WITH {PAIR}, s AS (SELECT seq_id, list_sum(list_transform(regexp_extract_all(m, '=+'), lambda r: greatest(length(r) - 2, 0))) AS s, list_sum(list_transform(regexp_extract_all(m, '[=x]+'), lambda r: greatest(length(r) - 2, 0))) AS a FROM m) SELECT seq_id, round(CASE WHEN a > 0 THEN coalesce(s, 0) / a END, 9) AS identity_3 FROM s")
def c9_oligomer_identity(t):
    return align.oligomer_identity(name_pairs(t), "x", "y", 3, 3).select("seq_id", F.round("identity_3", 9).alias("identity_3"))


LONG = f"{ALN}, g AS (SELECT aln, seq_id, unnest(range(1, length(seq) + 1)) AS pos, seq FROM n), l AS (SELECT aln, seq_id, pos, substr(seq, pos::INT, 1) AS residue FROM g)"


@query(f"WITH {LONG}, k AS (SELECT DISTINCT aln, pos FROM l WHERE residue <> '-') SELECT aln, seq_id, string_agg(residue, '' ORDER BY pos) AS seq FROM l JOIN k USING (aln, pos) GROUP BY ALL")
def c10_pack(t):
    return align.pack(names(t), "aln", "seq_id", "seq")


@query(f"WITH {LONG} SELECT aln, pos, residue, count(*) AS n FROM l GROUP BY ALL")
def c11_column_counts(t):
    return align.column_counts(names(t), "aln", "seq_id", "seq")


@query(f"WITH {LONG}, k AS (SELECT aln, pos, residue, count(*) AS n FROM l WHERE residue <> '-' GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY aln, pos) AS t, row_number() OVER (PARTITION BY aln, pos ORDER BY n DESC, residue) AS i FROM k) SELECT aln, string_agg(CASE WHEN n >= 0.2 * t THEN residue ELSE 'X' END, '' ORDER BY pos) AS consensus FROM b WHERE i = 1 GROUP BY aln")
def c11_consensus(t):
    return align.consensus(names(t), "aln", "seq_id", "seq", 0.2)


@query(f"WITH {ALN}, h AS (SELECT aln, length(regexp_extract(seq, '^-*')) AS h, length(regexp_extract(seq, '-*$')) AS t FROM n), k AS (SELECT aln, list_sort(list(h))[floor(0.75 * (count(*) - 1) + 0.5)::INT + 1] AS h, list_sort(list(t))[floor(0.75 * (count(*) - 1) + 0.5)::INT + 1] AS t FROM h GROUP BY aln) SELECT aln, seq_id, substr(seq, (h + 1)::INT, greatest(length(seq) - h - t, 0)::INT) AS seq FROM n JOIN k USING (aln)")
def c12_trim_ends(t):
    return align.trim_ends(names(t), "aln", "seq").select("aln", "seq_id", "seq")


def supplier_names(t):
    return t("supplier").select(F.col("s_nationkey").alias("aln"), F.col("s_suppkey").alias("id"), F.translate("s_name", "0", "-").alias("seq"), (-F.length(F.regexp_replace("s_name", "0", ""))).alias("rank"))


def supplier_pairs(t, least=0):
    """Pairs of different supplier names of one nation with their identity, and the copies of names."""
    s = supplier_names(t)
    same = align.copies(s, "aln", "id", "seq", "rank")
    return align.identities(s.join(same.select(F.col("node").alias("id")), "id", "left_anti"), "aln", "id", "seq", least), same


def supplier_nodes(t):
    return t("supplier").select(F.col("s_suppkey").alias("node"), (-F.length(F.regexp_replace("s_name", "0", ""))).alias("rank"))


LIKE = """s AS (SELECT s_nationkey AS aln, s_suppkey AS id, translate(s_name, '0', '-') AS seq, -length(replace(s_name, '0', '')) AS rank FROM supplier), c AS (SELECT a, b, string_agg(CASE WHEN x = '-' AND y = '-' THEN '' WHEN x = '-' THEN 'a' WHEN y = '-' THEN 'b' WHEN x = y THEN '=' ELSE 'x' END, '' ORDER BY i) AS m
FROM (SELECT p.id AS a, q.id AS b, i, substr(p.seq, i::INT, 1) AS x, substr(q.seq, i::INT, 1) AS y FROM s p JOIN s q ON p.aln = q.aln AND p.id < q.id, unnest(range(1, 19)) AS t(i)) GROUP BY a, b),
e AS (SELECT a, b, length(regexp_replace(m, '[^=]', '', 'g')) AS same, length(m) - length(regexp_extract(m, '^(a+|b+)', 1)) - CASE WHEN regexp_matches(m, '[=x]') THEN length(regexp_extract(m, '(a+|b+)$', 1)) ELSE 0 END AS size FROM c),
p AS (SELECT a, b, same / size AS identity FROM e WHERE size > 0 AND same / size > 0.9), near AS (SELECT a, b, identity FROM p UNION ALL SELECT b, a, identity FROM p),
o AS (SELECT id AS node, row_number() OVER (ORDER BY rank, id) AS i FROM s), n AS (SELECT i, node, list(b) FILTER (b IS NOT NULL) AS near FROM o LEFT JOIN near ON a = node GROUP BY ALL),
w AS (SELECT 0::BIGINT AS i, [NULL::BIGINT] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, coalesce(n.near, [])) THEN w.kept ELSE list_append(w.kept, n.node) END FROM w JOIN n ON n.i = w.i + 1),
k AS (SELECT node FROM (SELECT unnest(kept) AS node FROM w WHERE i = (SELECT max(i) FROM w)) WHERE node IS NOT NULL)"""


@query(f"WITH RECURSIVE {LIKE} SELECT node FROM k")
def c14_dereplicate(t):
    pairs, same = supplier_pairs(t, 0.9)
    return align.dereplicate(pairs, supplier_nodes(t), 0.9, same)


LIKE_ALL = LIKE[: LIKE.index("p AS (SELECT a, b, same / size AS identity")] + """p AS (SELECT a, b, same / size AS identity FROM e WHERE size > 0), near AS (SELECT a, b, identity FROM p UNION ALL SELECT b, a, identity FROM p),
lim AS (SELECT min(identity) AS low, max(identity) AS high FROM p), bounds AS (SELECT DISTINCT unnest(list_concat([0.0::DOUBLE, high], list_transform(range(32), lambda i: low + (high - low) * i / 32))) AS t FROM lim),
o AS (SELECT id AS node, row_number() OVER (ORDER BY rank, id) AS i FROM s), n AS (SELECT i, node, coalesce(list({'b': b, 's': identity}) FILTER (b IS NOT NULL), []) AS near FROM o LEFT JOIN near ON a = node GROUP BY ALL),
w AS (SELECT t, 0::BIGINT AS i, [NULL::BIGINT] AS kept FROM bounds UNION ALL SELECT w.t, n.i, CASE WHEN list_has_any(w.kept, list_transform(list_filter(n.near, lambda x: x.s > w.t), lambda x: x.b)) THEN w.kept ELSE list_append(w.kept, n.node) END FROM w JOIN n ON n.i = w.i + 1),
f AS (FROM w WHERE i = (SELECT max(i) FROM w) AND len(kept) - 1 >= (SELECT count(*) * 3 // 4 FROM s) ORDER BY t LIMIT 1)"""


@query(f"WITH RECURSIVE {LIKE_ALL} SELECT node FROM (SELECT unnest(kept[2:1 + (SELECT count(*) * 3 // 4 FROM s)]) AS node FROM f)")
def c14_dereplicate_n(t):
    """Three quarters of the suppliers: as many as that, by the smallest bound that leaves enough."""
    pairs, same = supplier_pairs(t)
    return align.dereplicate_n(pairs, supplier_nodes(t), t("supplier").count() * 3 // 4, same=same)[1]


@query(f"""WITH RECURSIVE {LIKE}, j AS (SELECT near.a AS node, b AS rep FROM near JOIN o x ON x.node = near.a JOIN o y ON y.node = b WHERE b IN (FROM k) AND near.a NOT IN (FROM k) AND y.i < x.i QUALIFY row_number() OVER (PARTITION BY near.a ORDER BY identity DESC, y.i) = 1)
SELECT node, rep FROM j UNION ALL SELECT node, node FROM k""")
def c15_cluster(t):
    pairs, same = supplier_pairs(t, 0.9)
    return align.cluster(pairs, supplier_nodes(t), 0.9, same)


LIKE_MORE = LIKE.replace("ON a = node GROUP", "ON a = node AND identity > pow(0.9, 0.8) GROUP")


@query(f"""WITH RECURSIVE {LIKE_MORE}, j AS (SELECT near.a AS node, b AS up FROM near JOIN o x ON x.node = near.a JOIN o y ON y.node = b WHERE b IN (FROM k) AND y.i < x.i
QUALIFY row_number() OVER (PARTITION BY near.a ORDER BY CASE WHEN identity > pow(0.9, 0.8) THEN 0 ELSE 1 END, CASE WHEN identity > pow(0.9, 0.8) THEN 0 ELSE -identity END, y.i) = 1),
g AS (SELECT id AS node, id AS rep FROM s WHERE id NOT IN (SELECT node FROM j) UNION ALL SELECT j.node, g.rep FROM j JOIN g ON j.up = g.node)
SELECT node, rep, node IN (FROM k) AS is_rep FROM g""")
def c15_cluster_extended(t):
    pairs, same = supplier_pairs(t, 0.9)
    return align.cluster_extended(pairs, supplier_nodes(t), 0.9, same=same)


@query("""WITH n AS (SELECT c_nationkey AS aln, c_custkey AS seq_id, translate(c_name, '0', '-') AS seq FROM customer), z AS (SELECT aln, max(length(seq)) AS n FROM n GROUP BY aln),
d AS (SELECT aln, pos, ('0x' || left(md5(concat_ws(':', '7', aln, pos)), 8))::BIGINT % n + 1 AS src FROM (SELECT aln, n, unnest(range(1, n + 1)) AS pos FROM z)) SELECT aln, seq_id, string_agg(substr(seq, src::INT, 1), '' ORDER BY pos) AS seq FROM n JOIN d USING (aln) GROUP BY aln, seq_id""")
def c16_bootstrap(t):
    return align.bootstrap(names(t), "aln", "seq_id", "seq", 7)


@query("""WITH b AS (SELECT p_brand AS role, p_type AS genome, p_name AS seq FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY length(p_name) DESC, p_name) = 1) SELECT * FROM b WHERE role IN (SELECT role FROM b GROUP BY role HAVING count(*) = (SELECT count(DISTINCT genome) FROM b))""")
def c17_supermatrix(t):
    return align.supermatrix(t("part").select(F.col("p_brand").alias("role"), F.col("p_type").alias("genome"), F.col("p_name").alias("seq")), "role", "genome", "seq")


@query("""SELECT p_type AS genome, arg_min(p_name, (-length(p_name), p_name)) AS seq, count(*) AS copies FROM part WHERE p_brand = 'Brand#1' GROUP BY p_type""")
def f11_role_sequences(t):
    return features.role_sequences(t("part").select(F.col("p_type").alias("genome"), F.col("p_brand").alias("role"), F.col("p_name").alias("seq")), "genome", "role", "seq", "Brand#1")


@query("""WITH a AS (SELECT o_custkey AS contig, o_orderkey % 997 AS stop, any_value(o_orderstatus) AS f, max(o_totalprice) AS l FROM orders WHERE o_orderpriority < '3' GROUP BY ALL), b AS (SELECT o_custkey AS contig, o_orderkey % 997 AS stop, any_value(o_orderstatus) AS f, max(o_totalprice) AS l FROM orders WHERE o_orderpriority >= '2' GROUP BY ALL)
SELECT coalesce(a.contig, b.contig) AS contig, coalesce(a.stop, b.stop) AS stop, CASE WHEN a.l IS NULL THEN 'new' WHEN b.l IS NULL THEN 'uncalled' WHEN abs(a.l - b.l) <= 0.1 * greatest(a.l, b.l) THEN 'same' WHEN b.l > a.l THEN 'longer' ELSE 'shorter' END AS length_change, coalesce(a.f = b.f, false) AS same_function FROM a FULL JOIN b ON a.contig = b.contig AND a.stop = b.stop""".replace("any_value(o_orderstatus)", "min(o_orderstatus)"))
def f6_compare_calls(t):
    one = lambda c: t("orders").where(c).groupBy(F.col("o_custkey").alias("contig"), (F.col("o_orderkey") % 997).alias("stop")).agg(F.min("o_orderstatus").alias("function"), F.max("o_totalprice").alias("length"))
    return features.compare_calls(one("o_orderpriority < '3'"), one("o_orderpriority >= '2'"), ["contig", "stop"])


@query("""WITH d AS (SELECT text AS seq, count(*) AS n FROM documents GROUP BY text HAVING count(*) >= 2) SELECT n, row_number() OVER (ORDER BY n DESC, md5(seq)) AS number, md5(seq) AS seq FROM d""")
def a14_dereplicate(t):
    return reads.dereplicate(t("documents").select(F.md5("text").alias("seq")), "seq", 2, 0.0)


DRUGS = "g AS (SELECT p_brand AS drug1, p_type AS drug2, s_nationkey AS line, l_discount - 0.02 AS growth, l_tax AS expected, l_linenumber AS c1, l_quantity AS c2 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


def doses(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("p_brand").alias("drug1"), F.col("p_type").alias("drug2"), F.col("s_nationkey").alias("line"), (F.col("l_discount") - 0.02).alias("growth"), F.col("l_tax").alias("expected"), F.col("l_linenumber").alias("c1"), F.col("l_quantity").alias("c2"))


@query(f"WITH {DRUGS} SELECT drug1, drug2, line, round(max(expected - growth), 6) + 0.0 AS synergy, round(max(growth - expected), 6) + 0.0 AS antagony, round(max(expected - growth) FILTER (growth >= 0), 6) + 0.0 AS synergy2, round(arg_min(expected - growth, (growth, expected)), 6) + 0.0 AS minergy FROM g GROUP BY ALL HAVING max(expected - growth) FILTER (growth >= 0) IS NOT NULL")
def d1_scores(t):
    rows = doses(t)
    out = None
    for c in ("synergy", "antagony", "synergy2", "minergy"):
        one = drugs.score(rows, c).withColumn(c, F.round("score", 6)).drop("score")
        out = one if out is None else out.join(one, drugs.GROUP)
    return out


@query(f"""WITH {DRUGS}, h AS (SELECT drug1, drug2, line, c1, c2, avg(growth) AS growth FROM g GROUP BY ALL), x AS (SELECT *, lag(growth) OVER (PARTITION BY drug1, drug2, line, c2 ORDER BY c1) AS p, lag(growth) OVER (PARTITION BY drug1, drug2, line, c1 ORDER BY c2) AS q FROM h),
d AS (SELECT drug1, drug2, line, growth, unnest([p, q]) AS b FROM x), e AS (SELECT drug1, drug2, line, max(CASE WHEN greatest(abs(growth), abs(b)) > 0 THEN 100 * abs(growth - b) / greatest(abs(growth), abs(b)) END) AS score FROM d GROUP BY ALL)
SELECT drug1, drug2, line, round(score, 6) AS score FROM e WHERE score IS NOT NULL""")
def d2_delta(t):
    return drugs.score(doses(t).groupBy(*drugs.GROUP, "c1", "c2").agg(F.avg("growth").alias("growth")), "deltaDiff").withColumn("score", F.round("score", 6))


SCORED = f"{DRUGS}, s AS (SELECT drug1, drug2, line, max(expected - growth) AS score FROM g GROUP BY ALL)"
DP = f"{SCORED}, p AS (SELECT least(drug1, drug2) AS a, greatest(drug1, drug2) AS b, count(*) AS n, avg(score) AS mean, count(*) FILTER (score >= 0.07) AS significant, avg(score) FILTER (score >= 0.07) AS significant_mean FROM s GROUP BY ALL)"


def synergy(t):
    return drugs.score(doses(t), "synergy")


@query(f"WITH {SCORED} SELECT drug1, drug2, line, round(score, 6) + 0.0 AS score FROM s WHERE score >= 0.065")
def d3_select(t):
    return drugs.select(synergy(t), 0.065).withColumn("score", F.round("score", 6))


@query(f"WITH {DP} SELECT a, b, n, round(mean, 6) AS mean, significant, round(significant_mean, 6) AS significant_mean FROM p")
def d4_pairs(t):
    return drugs.pairs(synergy(t), 0.07).withColumns({"mean": F.round("mean", 6), "significant_mean": F.round("significant_mean", 6)})


KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"WITH {DP}, e AS (SELECT a, b, significant FROM p UNION ALL SELECT b, a, significant FROM p) SELECT a AS drug, " + ", ".join(f"coalesce(sum(significant) FILTER (b = '{k}'), 0)::BIGINT AS \"{k}\"" for k in KINDS) + ", (" + " + ".join(f"coalesce(sum(significant) FILTER (b = '{k}'), 0)" for k in KINDS) + ")::BIGINT AS total FROM e GROUP BY a")
def d5_summary(t):
    return drugs.summary(drugs.pairs(synergy(t), 0.07), KINDS)


@query("""WITH s AS (SELECT p1.p_brand AS a, p2.p_brand AS b, count(*) AS significant FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber JOIN part p1 ON x.l_partkey = p1.p_partkey JOIN part p2 ON y.l_partkey = p2.p_partkey GROUP BY ALL),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM s WHERE a <> b GROUP BY ALL HAVING sum(significant) >= 40) SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""")
def d6_triples(t):
    l = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")  # noqa: E741
    x, y = l.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("p_brand").alias("p")), l.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("p_brand").alias("q"))
    e = x.join(y, "l_orderkey").where("i < j").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("significant"))
    return drugs.triples(e, 40)


@query(f"WITH {SCORED}, u AS (SELECT line, drug1 AS drug FROM s WHERE score >= 0.065 UNION ALL SELECT line, drug2 FROM s WHERE score >= 0.065 AND drug1 <> drug2) SELECT line, drug, count(*) AS n FROM u GROUP BY ALL")
def d7_participation(t):
    return drugs.participation(drugs.select(synergy(t), 0.065), "line")


@query(f"WITH {DRUGS}, x AS (SELECT least(drug1, drug2) AS a, greatest(drug1, drug2) AS b, line, max(expected - growth) AS score_a, max(growth - expected) AS score_b FROM g GROUP BY ALL) SELECT a, b, line, round(score_a, 6) + 0.0 AS score_a, round(score_b, 6) + 0.0 AS score_b, row_number() OVER (PARTITION BY a, b ORDER BY score_a DESC, line) AS rank_a, row_number() OVER (PARTITION BY a, b ORDER BY score_b DESC, line) AS rank_b FROM x")
def d8_merge_studies(t):
    return drugs.merge(synergy(t), drugs.score(doses(t), "antagony")).withColumns({"score_a": F.round("score_a", 6), "score_b": F.round("score_b", 6)})


@query("""WITH a AS (SELECT c_nationkey AS line, c_mktsegment AS drug, round(avg(c_acctbal), 4) AS first FROM customer GROUP BY ALL), b AS (SELECT c_nationkey AS line, c_mktsegment AS drug, count(*)::DOUBLE AS second FROM customer GROUP BY ALL), d AS (SELECT unnest(['BUILDING', 'MACHINERY']) AS drug), l AS (SELECT DISTINCT c_nationkey AS line FROM customer)
SELECT l.line, d.drug, first, second FROM l CROSS JOIN d LEFT JOIN a ON a.line = l.line AND a.drug = d.drug LEFT JOIN b ON b.line = l.line AND b.drug = d.drug""")
def d9_predictions(t):
    wide = lambda agg: t("customer").groupBy(F.col("c_nationkey").alias("line")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(agg)
    return drugs.predictions(wide(F.round(F.avg("c_acctbal"), 4)), wide(F.count(F.lit(1))), ["line"], ["BUILDING", "MACHINERY"])


@query("SELECT c_custkey, round(c_acctbal / ln(10), 6) AS ic50, 'N.' || c_mktsegment AS drug FROM customer")
def p19_harmonize(t):
    return drugs.harmonize_ic50(t("customer").select("c_custkey", F.col("c_acctbal").alias("ic50"), F.col("c_mktsegment").alias("drug")), "drug", "ic50", True, "N").withColumn("ic50", F.round("ic50", 6))


@query("SELECT p_size::VARCHAR AS number, arg_min(p_name, p_partkey) AS name FROM part GROUP BY p_size")
def p20_name_map(t):
    return drugs.name_map(t("part").select("p_partkey", F.concat_ws(": ", F.col("p_size").cast("string"), "p_name").alias("line")), "line", "p_partkey")
