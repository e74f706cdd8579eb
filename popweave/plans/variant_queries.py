"""Queries over variant sites and genotypes."""

from pyspark.sql import functions as F

from popweave.operators import popgen as G
from popweave.operators import variants as V
from popweave.plans.fixtures import Catalog

C = Catalog()
POPS = "pm AS (SELECT 'm' AS pop, sample_idx FROM fx_samples WHERE sex = 'm' UNION ALL SELECT 'f', sample_idx FROM fx_samples WHERE sex = 'f' UNION ALL SELECT 'inv', sample_idx FROM fx_samples WHERE karyotype = 'Inverted' UNION ALL SELECT 'norm', sample_idx FROM fx_samples WHERE karyotype = 'Normal')"
AC = f"{POPS}, ac AS (SELECT site_id, pop, sum(2 - a1 - a2) AS ref, sum(a1 + a2) AS alt, 2 * count(*) AS n FROM fx_genotypes g JOIN pm ON pm.sample_idx = g.sample_idx WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY 1, 2)"
AD = f"{POPS}, ad AS (SELECT site_id, pop, sum(CASE WHEN ad_ref = 0 AND ad_alt = 0 THEN 0 WHEN ad_ref = 0 THEN 2 WHEN ad_alt = 0 THEN 0 ELSE 1 END) AS alt, sum(CASE WHEN ad_ref = 0 AND ad_alt = 0 THEN 0 ELSE 2 END) AS total FROM fx_genotypes g JOIN pm ON pm.sample_idx = g.sample_idx GROUP BY 1, 2)"


def pops(t):
    return V.membership({"m": F.col("sex") == "m", "f": F.col("sex") == "f", "inv": F.col("karyotype") == "Inverted", "norm": F.col("karyotype") == "Normal"}, t.fx_samples)


@C.query("population_groups", f"WITH {POPS} SELECT pop, sample_idx FROM pm")
def _(t):
    return pops(t)


@C.query("allele_counts", f"WITH {AC} SELECT site_id, pop, CAST(ref AS BIGINT) AS ref, CAST(alt AS BIGINT) AS alt, n FROM ac")
def _(t):
    return V.allele_counts(t.fx_genotypes, pops(t))


@C.query("allele_frequency", f"WITH {POPS} SELECT site_id, pop, 2 * count(*) FILTER (gq >= 10 AND a1 IS NOT NULL) AS obs_ct, round(sum(CASE WHEN gq >= 10 THEN a1 + a2 END) / nullif(2.0 * count(*) FILTER (gq >= 10 AND a1 IS NOT NULL), 0), 6) AS alt_freq FROM fx_genotypes g JOIN pm ON pm.sample_idx = g.sample_idx GROUP BY 1, 2")
def _(t):
    return V.allele_frequency(t.fx_genotypes, pops(t)).withColumn("alt_freq", F.round("alt_freq", 6))


@C.query("ad_allele_counts", f"WITH {AD} SELECT site_id, pop, CAST(alt AS BIGINT) AS alt, CAST(total AS BIGINT) AS total FROM ad")
def _(t):
    return V.ad_allele_counts(t.fx_genotypes, pops(t))


_HET = "count(*) FILTER (a1 IS NOT NULL) AS n, round(count(*) FILTER (a1 <> a2) / nullif(CAST(count(*) FILTER (a1 IS NOT NULL) AS DOUBLE), 0), 6) AS het FROM fx_genotypes"


@C.query("observed_heterozygosity", f"SELECT site_id, {_HET} GROUP BY site_id")
def _(t):
    return V.heterozygosity(t.fx_genotypes, ["site_id"]).withColumn("het", F.round("het", 6))


@C.query("individual_het", f"SELECT sample_idx, {_HET} GROUP BY sample_idx")
def _(t):
    return V.heterozygosity(t.fx_genotypes, ["sample_idx"]).withColumn("het", F.round("het", 6))


@C.query("af_by_reads", "SELECT site_id, round(sum(ad_ref) / nullif(CAST(sum(ad_ref + ad_alt) AS DOUBLE), 0), 6) AS af FROM fx_genotypes GROUP BY site_id")
def _(t):
    return V.af_by_reads(t.fx_genotypes).withColumn("af", F.round("af", 6))


@C.query("category_totals", "SELECT contig_ord, count(*) AS n FROM fx_sites WHERE n_alt_alleles = 1 AND length(ref) = 1 AND length(alt) = 1 AND qual >= 230 GROUP BY contig_ord")
def _(t):
    return V.filter_snp_quality(t.fx_sites, t.fx_contigs, 230).groupBy("contig_ord").agg(F.count("*").alias("n"))


_SUBSET = "sub AS (SELECT site_id, sum(a1 + a2) AS ac, 2 * count(*) AS an FROM fx_genotypes g JOIN fx_samples s ON s.sample_idx = g.sample_idx WHERE sex = 'm' AND a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY site_id)"


@C.query("filter_biallelic_snps", f"WITH {_SUBSET} SELECT k, s.site_id, contig_ord FROM fx_sites s JOIN sub ON sub.site_id = s.site_id CROSS JOIN (VALUES (1), (5), (8)) v(k) WHERE n_alt_alleles = 1 AND length(ref) = 1 AND length(alt) = 1 AND least(ac, an - ac) >= k")
def _(t):
    males = t.fx_samples.where("sex = 'm'")
    out = None
    for k in (1, 5, 8):
        one = V.filter_biallelic_snps(t.fx_sites, t.fx_genotypes, males, k).select(F.lit(k).alias("k"), "site_id", "contig_ord")
        out = one if out is None else out.unionByName(one)
    return out


@C.query("filter_snp_quality", "SELECT site_id FROM fx_sites WHERE n_alt_alleles = 1 AND length(ref) = 1 AND length(alt) = 1 AND qual >= 230")
def _(t):
    return V.filter_snp_quality(t.fx_sites, t.fx_contigs, 230).select("site_id")


@C.query("informative_sites", "SELECT x.site_id, x.a1 AS g0, y.a1 AS g1, z.a1 AS g2 FROM fx_genotypes x JOIN fx_genotypes y ON x.site_id = y.site_id AND y.sample_idx = 2 JOIN fx_genotypes z ON x.site_id = z.site_id AND z.sample_idx = 3 WHERE x.sample_idx = 1 AND x.a1 = x.a2 AND y.a1 = y.a2 AND z.a1 = z.a2 AND (x.a1 <> y.a1 OR x.a1 <> z.a1)")
def _(t):
    return V.informative_sites(t.fx_genotypes, [1, 2, 3])


_SMALL = "pm AS (SELECT 'TI' AS pop, sample_idx FROM fx_samples WHERE sample_idx IN (0, 1, 2) UNION ALL SELECT 'CV', sample_idx FROM fx_samples WHERE sample_idx IN (3, 4) UNION ALL SELECT 'MC', sample_idx FROM fx_samples WHERE sample_idx IN (5, 6))"


@C.query("fixed_differences", f"WITH {_SMALL}, {AD[len(POPS) + 2 :]}, w AS (SELECT site_id, max(alt) FILTER (pop = 'TI') AS a_t, max(total) FILTER (pop = 'TI') AS tt, max(alt) FILTER (pop = 'CV') AS ac, max(total) FILTER (pop = 'CV') AS tc, max(alt) FILTER (pop = 'MC') AS am, max(total) FILTER (pop = 'MC') AS tm FROM ad GROUP BY site_id), q AS (SELECT * FROM w WHERE tt >= 2 AND tc >= 2 AND tm >= 2) SELECT site_id, 'TI' AS pop FROM q WHERE abs(a_t / CAST(tt AS DOUBLE) - am / CAST(tm AS DOUBLE)) = 1 UNION ALL SELECT site_id, 'CV' FROM q WHERE abs(ac / CAST(tc AS DOUBLE) - am / CAST(tm AS DOUBLE)) = 1")
def _(t):
    p = V.membership({"TI": F.col("sample_idx").isin(0, 1, 2), "CV": F.col("sample_idx").isin(3, 4), "MC": F.col("sample_idx").isin(5, 6)}, t.fx_samples)
    return V.fixed_differences(V.ad_allele_counts(t.fx_genotypes, p), {"TI": 2, "CV": 2, "MC": 2}, "MC")


_PARENT = "pa AS (SELECT site_id, sum(CASE WHEN ad_ref = 0 AND ad_alt = 0 THEN 0 WHEN ad_ref = 0 THEN 2 WHEN ad_alt = 0 THEN 0 ELSE 1 END) AS alt, sum(CASE WHEN ad_ref = 0 AND ad_alt = 0 THEN 0 ELSE 2 END) AS total FROM fx_genotypes WHERE sample_idx IN (5, 6) GROUP BY site_id), po AS (SELECT g.site_id, sample_idx, CASE WHEN alt = 0 THEN ad_alt ELSE ad_ref END AS r, CASE WHEN alt = 0 THEN ad_ref ELSE ad_alt END AS a FROM fx_genotypes g JOIN pa ON pa.site_id = g.site_id WHERE total = 4 AND (alt = 0 OR alt = total))"


def polarized(t):
    p = V.membership({"MC": F.col("sample_idx").isin(5, 6)}, t.fx_samples)
    return V.polarize_by_parent(t.fx_genotypes, V.ad_allele_counts(t.fx_genotypes, p))


@C.query("polarize_by_parent", f"WITH {_PARENT} SELECT site_id, sample_idx, r AS ad_ref, a AS ad_alt FROM po")
def _(t):
    return polarized(t).select("site_id", "sample_idx", "ad_ref", "ad_alt")


_SEG = "se AS (SELECT site_id, sum(r) / nullif(CAST(sum(r + a) AS DOUBLE), 0) AS af, sum(r + a) AS depth, count(*) FILTER (r + a > 0) AS n_called FROM po GROUP BY site_id HAVING sum(r) / nullif(CAST(sum(r + a) AS DOUBLE), 0) BETWEEN 0.1 AND 0.9 AND sum(r + a) >= 50 AND count(*) FILTER (r + a > 0) >= 10)"


@C.query("segregation_filter", f"WITH {_PARENT}, {_SEG} SELECT site_id, round(af, 6) AS af, CAST(depth AS BIGINT) AS depth, n_called FROM se")
def _(t):
    return V.segregation_filter(polarized(t), 0.1, 0.9, 50, 10).withColumn("af", F.round("af", 6))


def _calls(first, total):
    s = f"({first} / nullif(CAST({total} AS DOUBLE), 0))"
    return f"CASE WHEN {s} <= 0.2 THEN 'MC' WHEN {s} >= 0.8 THEN 'TI' WHEN {s} IS NOT NULL THEN 'Het' END"


@C.query("ancestry_call", f"SELECT site_id, sample_idx, {_calls('ad_ref', '(ad_ref + ad_alt)')} AS call, CASE WHEN ad_ref + ad_alt = 0 THEN NULL WHEN ad_ref / CAST(ad_ref + ad_alt AS DOUBLE) > 0.85 THEN 'CV' WHEN ad_ref / CAST(ad_ref + ad_alt AS DOUBLE) > 0.15 THEN 'Het' ELSE 'MC' END AS call3 FROM fx_genotypes")
def _(t):
    r, n = F.col("ad_ref"), F.col("ad_ref") + F.col("ad_alt")
    return t.fx_genotypes.select("site_id", "sample_idx", V.ancestry_call(r, n).alias("call"), V.ancestry_call_three(r, n).alias("call3"))


@C.query("bin_ancestry", f"""WITH {_PARENT}, {_SEG}, nu AS (SELECT se.*, contig_ord, pos, floor((row_number() OVER (ORDER BY contig_ord, pos, se.site_id) - 1) / 5) AS bin FROM se JOIN fx_sites s ON s.site_id = se.site_id),
ok AS (SELECT * FROM (SELECT *, avg(af) OVER (PARTITION BY contig_ord, bin) AS m FROM nu) q WHERE abs(af - m) < 0.3)
SELECT contig_ord, CAST(bin AS BIGINT) AS bin, sample_idx, min(pos) AS first_pos, CAST(sum(r) AS BIGINT) AS first_reads, CAST(sum(r + a) AS BIGINT) AS reads, {_calls('sum(r)', 'sum(r + a)')} AS call FROM ok JOIN po ON po.site_id = ok.site_id GROUP BY 1, 2, 3""")
def _(t):
    from popweave.operators import intervals as I

    p = polarized(t)
    sites = V.segregation_filter(p, 0.1, 0.9, 50, 10).join(t.fx_sites.select("site_id", "contig_ord", "pos"), "site_id")
    kept = I.join_back_group(I.running_bin(sites, 5), ["contig_ord", "bin"], "af", 0.3)
    x = kept.select("site_id", "contig_ord", "pos", "bin").join(p, "site_id").groupBy("contig_ord", "bin", "sample_idx")
    x = x.agg(F.min("pos").alias("first_pos"), F.sum("ad_ref").alias("first_reads"), F.sum(F.col("ad_ref") + F.col("ad_alt")).alias("reads"))
    return x.withColumn("call", V.ancestry_call(F.col("first_reads"), F.col("reads")))


_WIDE = f"{AC}, w AS (SELECT site_id, max(alt / CAST(n AS DOUBLE)) FILTER (pop = 'inv') AS inv, max(alt / CAST(n AS DOUBLE)) FILTER (pop = 'norm') AS norm FROM ac GROUP BY site_id HAVING count(*) FILTER (pop = 'inv') > 0 AND count(*) FILTER (pop = 'norm') > 0)"


def _wide(t):
    freq = V.allele_counts(t.fx_genotypes, pops(t)).withColumn("alt_freq", F.col("alt") / F.col("n"))
    return V.wide_frequencies(freq, ["inv", "norm"])


@C.query("multiway_join_freq", f"WITH {_WIDE} SELECT site_id, round(inv, 6) AS inv, round(norm, 6) AS norm FROM w")
def _(t):
    return _wide(t).select("site_id", F.round("inv", 6).alias("inv"), F.round("norm", 6).alias("norm"))


@C.query("differential_frequency", f"WITH {_WIDE} SELECT site_id FROM w WHERE (inv > 0.5 AND norm < 0.45) OR (norm > 0.95 AND inv < 0.2) OR (inv > 0.8 AND norm < 0.05)")
def _(t):
    w = _wide(t)
    a, b = F.col("norm"), F.col("inv")
    return w.where(V.differential_frequency(a, b) | ((b > 0.5) & (a < 0.45))).select("site_id")


@C.query("position_list_semi", "SELECT site_id FROM fx_sites s WHERE EXISTS (SELECT 1 FROM fx_sites p WHERE p.site_id % 3 = 0 AND p.contig_ord = s.contig_ord AND p.pos = s.pos)")
def _(t):
    return V.position_semi(t.fx_sites, t.fx_sites.where("site_id % 3 = 0")).select("site_id")


@C.query("concordance", "SELECT site_id FROM fx_sites s WHERE EXISTS (SELECT 1 FROM fx_sites p WHERE p.site_id % 5 < 3 AND p.contig_ord = s.contig_ord AND p.pos = s.pos AND p.ref = s.ref AND p.alt = s.alt)")
def _(t):
    return V.concordance(t.fx_sites, t.fx_sites.where("site_id % 5 < 3")).select("site_id")


@C.query("hard_filter_variants", "SELECT site_id FROM (SELECT site_id, contig_ord, 800 + site_id % 2500 AS dp, site_id % 50 AS fs, site_id % 7 AS qd, 30 + site_id % 30 AS mq, CASE WHEN site_id % 11 = 0 THEN 'x' ELSE CAST(site_id % 400 AS VARCHAR) END AS mq0 FROM fx_sites) WHERE dp >= 1000 AND (dp <= 3000 OR contig_ord IN (2, 5)) AND (fs <= 40 OR contig_ord IN (2, 5)) AND qd >= 2 AND mq >= 40 AND NOT coalesce(TRY_CAST(mq0 AS DOUBLE) / dp > 0.1, false)")
def _(t):
    n = F.col("site_id")
    values = {"DP": 800 + n % 2500, "FS": n % 50, "QD": n % 7, "MQ": 30 + n % 30, "MQ0": F.when(n % 11 == 0, "x").otherwise((n % 400).cast("string"))}
    info = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    s = t.fx_sites.join(t.fx_contigs.select("contig_ord", "contig"), "contig_ord").withColumn("info", info)
    return V.hard_filter_variants(s, ["NC_036782.1", "NC_036785.1"]).select("site_id")


@C.query("genotypes_to_long", "SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY sample_idx) - 1 AS INTEGER) AS sample_ord, a1, a2 FROM fx_genotypes")
def _(t):
    return V.to_long(V.to_wide(t.fx_genotypes))


@C.query("genotypes_to_wide", "SELECT site_id, count(*) AS n, CAST(sum(coalesce(a1, 0) * k) AS BIGINT) AS mark FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY sample_idx) AS k FROM fx_genotypes) GROUP BY site_id")
def _(t):
    w = V.to_wide(t.fx_genotypes)
    mark = F.aggregate(F.transform("gt", lambda x, i: F.coalesce(x["a1"], F.lit(0)).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("site_id", F.size("gt").cast("long").alias("n"), mark.alias("mark"))


_CODE = "CASE WHEN a1 IS NULL OR length(ref) > 1 OR length(alt) > 1 AND a1 + a2 > 0 THEN 'N' WHEN a1 = a2 THEN CASE WHEN a1 = 0 THEN ref ELSE alt END ELSE CASE least(ref, alt) || greatest(ref, alt) WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' WHEN 'GT' THEN 'K' ELSE ref END END"


@C.query("iupac_matrix", f"WITH n AS (SELECT site_id FROM fx_genotypes WHERE a1 IS NOT NULL GROUP BY site_id HAVING count(*) >= 20) SELECT p.sample_idx, contig_ord, string_agg({_CODE}, '' ORDER BY pos, s.site_id) AS sequence FROM n JOIN fx_sites s ON s.site_id = n.site_id CROSS JOIN fx_samples p LEFT JOIN fx_genotypes g ON g.site_id = n.site_id AND g.sample_idx = p.sample_idx GROUP BY 1, 2")
def _(t):
    return V.iupac_matrix(t.fx_genotypes, t.fx_sites, 20, t.fx_samples)


@C.query("iupac_tiles", f"WITH n AS (SELECT site_id FROM fx_genotypes WHERE a1 IS NOT NULL GROUP BY site_id HAVING count(*) >= 20), o AS (SELECT s.*, row_number() OVER (PARTITION BY contig_ord ORDER BY pos, s.site_id) AS rn FROM fx_sites s JOIN n ON n.site_id = s.site_id), ti AS (SELECT contig_ord, k, row_number() OVER (ORDER BY contig_ord, k) AS tile FROM (SELECT DISTINCT contig_ord, (rn - 1) // 10 AS k FROM o) q) SELECT tile, p.sample_idx, string_agg({_CODE}, '' ORDER BY rn) AS sequence FROM o JOIN ti ON ti.contig_ord = o.contig_ord AND ti.k = (rn - 1) // 10 CROSS JOIN fx_samples p LEFT JOIN fx_genotypes g ON g.site_id = o.site_id AND g.sample_idx = p.sample_idx GROUP BY 1, 2")
def _(t):
    return V.iupac_tiles(t.fx_genotypes, t.fx_sites, 20, t.fx_samples, 10).select("tile", "sample_idx", "sequence")


_TRIO = """k AS (SELECT g.site_id, g.sample_idx, g.a1, g.a2, (g.a1 IN (m.a1, m.a2) AND g.a2 IN (f.a1, f.a2)) AS one, (g.a2 IN (m.a1, m.a2) AND g.a1 IN (f.a1, f.a2)) AS two FROM fx_genotypes g JOIN fx_genotypes m ON m.site_id = g.site_id AND m.sample_idx = 0 JOIN fx_genotypes f ON f.site_id = g.site_id AND f.sample_idx = 1
 WHERE g.sample_idx > 1 AND g.a1 IS NOT NULL AND m.a1 IS NOT NULL AND f.a1 IS NOT NULL),
s AS (SELECT *, CASE WHEN NOT one AND NOT two THEN 'mendel_error' WHEN one AND two AND a1 <> a2 THEN 'unphased' ELSE 'phased' END AS status FROM k)"""


@C.query("phase_progeny", f"WITH {_TRIO} SELECT site_id, sample_idx, status, CASE WHEN status = 'phased' THEN CASE WHEN one THEN a1 ELSE a2 END END AS maternal, CASE WHEN status = 'phased' THEN CASE WHEN one THEN a2 ELSE a1 END END AS paternal FROM s")
def _(t):
    return V.phase_progeny(t.fx_genotypes.where("sample_idx >= 0"), 0, 1)


@C.query("phased_counts", f"WITH {_TRIO} SELECT sample_idx, count(*) FILTER (status = 'phased') AS n_phased FROM s GROUP BY sample_idx")
def _(t):
    return V.phase_progeny(t.fx_genotypes, 0, 1).groupBy("sample_idx").agg(F.count_if(F.col("status") == "phased").alias("n_phased"))


_HET = f"""{_TRIO}, h AS (SELECT s.site_id, contig_ord, row_number() OVER (ORDER BY contig_ord, pos, s.site_id) AS rn FROM fx_sites s JOIN fx_genotypes g ON g.site_id = s.site_id AND sample_idx = 0 AND a1 <> a2),
mt AS (SELECT rn, contig_ord, sample_idx, dense_rank() OVER (ORDER BY sample_idx) AS place, CASE WHEN status = 'phased' THEN CASE WHEN one THEN a1 ELSE a2 END END AS a FROM s JOIN h ON h.site_id = s.site_id),
vt AS (SELECT x.rn, y.rn AS prev, x.place, CASE WHEN x.a = y.a THEN 1 ELSE -1 END AS v FROM mt x JOIN mt y ON y.contig_ord = x.contig_ord AND y.sample_idx = x.sample_idx AND y.rn BETWEEN x.rn - 25 AND x.rn - 1 WHERE x.a IS NOT NULL AND y.a IS NOT NULL)"""


@C.query("phase_parents", f"""WITH RECURSIVE {_HET},
nt AS (SELECT rn, prev, sum(v) AS net FROM vt GROUP BY 1, 2),
lk AS (SELECT rn, prev, sign(net) AS sg FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY abs(net) DESC, prev DESC) AS k FROM nt WHERE net <> 0) q WHERE k = 1),
ro AS (SELECT site_id, contig_ord, rn, row_number() OVER (PARTITION BY contig_ord ORDER BY rn) AS block FROM h WHERE rn NOT IN (SELECT rn FROM lk)),
tr AS (SELECT rn, block, 1 AS sg FROM ro UNION ALL SELECT lk.rn, block, CAST(tr.sg * lk.sg AS INTEGER) FROM tr JOIN lk ON lk.prev = tr.rn)
SELECT site_id, CAST(block AS BIGINT) AS block, CAST(sg < 0 AS INTEGER) AS "left", CAST(sg > 0 AS INTEGER) AS "right" FROM tr JOIN h ON h.rn = tr.rn""")
def _(t):
    g = t.fx_genotypes
    return V.phase_parents(V.phase_progeny(g, 0, 1), g, t.fx_sites, 0, "maternal")


SUBSETS = list(range(1, 25))


@C.query("phase_subsets", f"""WITH {_HET}, sz AS (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS size),
nt AS (SELECT size, rn, prev, sum(v) AS net FROM vt JOIN sz ON place <= size GROUP BY 1, 2, 3),
lk AS (SELECT size, rn, prev FROM (SELECT *, row_number() OVER (PARTITION BY size, rn ORDER BY abs(net) DESC, prev DESC) AS k FROM nt WHERE net <> 0) q WHERE k = 1),
en AS (SELECT size, rn FROM lk UNION SELECT size, prev FROM lk)
SELECT sz.size, count(en.rn) AS n_phased FROM sz LEFT JOIN en ON en.size = sz.size GROUP BY sz.size""")
def _(t):
    g = t.fx_genotypes
    return V.phase_subsets(V.phase_progeny(g, 0, 1), g, t.fx_sites, 0, "maternal", SUBSETS)


_FST = f"{AC}, fs AS (SELECT site_id, 1 - (r0 * (r0 - 1) + x0 * (x0 - 1)) / nullif(n0 * (n0 - 1), 0) AS d0, 1 - (r1 * (r1 - 1) + x1 * (x1 - 1)) / nullif(n1 * (n1 - 1), 0) AS d1, 1 - (r0 * r1 + x0 * x1) / nullif(n0 * n1, 0) AS b FROM (SELECT site_id, CAST(max(ref) FILTER (pop = '{{0}}') AS DOUBLE) AS r0, CAST(max(alt) FILTER (pop = '{{0}}') AS DOUBLE) AS x0, CAST(max(n) FILTER (pop = '{{0}}') AS DOUBLE) AS n0, CAST(max(ref) FILTER (pop = '{{1}}') AS DOUBLE) AS r1, CAST(max(alt) FILTER (pop = '{{1}}') AS DOUBLE) AS x1, CAST(max(n) FILTER (pop = '{{1}}') AS DOUBLE) AS n1 FROM ac WHERE pop IN ('{{0}}', '{{1}}') GROUP BY site_id)), ft AS (SELECT site_id, (b - (d0 + d1) / 2) / nullif(b, 0) AS fst FROM fs)"


@C.query("hudson_fst", f"WITH {_FST.format('inv', 'norm')} SELECT site_id, round(fst, 6) AS fst FROM ft")
def _(t):
    return G.hudson_fst(V.allele_counts(t.fx_genotypes, pops(t)), "inv", "norm").withColumn("fst", F.round("fst", 6))


PAIRS = [("m", "f"), ("inv", "norm"), ("m", "inv"), ("f", "norm")]


def _scan_part(a, b):
    return f"SELECT '{a}-{b}' AS comparison, label, round(avg(fst), 6) AS mean_fst, count(fst) AS n FROM (SELECT *, coalesce((SELECT arg_max(interval_name, o) FROM iv WHERE iv.contig_ord = s.contig_ord AND pos > out_start AND pos < out_stop), 'Normal') AS label FROM fx_sites s) s JOIN ft_{a}_{b} ft ON ft.site_id = s.site_id GROUP BY label"


def _scan_sql():
    ctes = [AC]
    for a, b in PAIRS:
        f = _FST.format(a, b)[len(AC) + 2 :]
        ctes.append(f.replace("fs AS", f"fs_{a}_{b} AS").replace("FROM fs)", f"FROM fs_{a}_{b})").replace("ft AS", f"ft_{a}_{b} AS"))
    ctes.append("iv AS (SELECT *, row_number() OVER (ORDER BY contig_ord, interval_name) AS o FROM fx_intervals)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(_scan_part(a, b) for a, b in PAIRS)


def ordered_intervals(t):
    from pyspark.sql import Window as W

    return t.fx_intervals.withColumn("interval_ord", F.row_number().over(W.orderBy("contig_ord", "interval_name")))  # a handful of rows


@C.query("fst_scan", _scan_sql())
def _(t):
    from popweave.operators import intervals as I

    ac = V.allele_counts(t.fx_genotypes, pops(t))
    sites = I.interval_label(t.fx_sites, ordered_intervals(t))
    out = None
    for a, b in PAIRS:
        fst = G.hudson_fst(ac, a, b).join(sites.select("site_id", "label"), "site_id").groupBy("label").agg(F.round(F.avg("fst"), 6).alias("mean_fst"), F.count("fst").alias("n"))
        one = fst.select(F.lit(f"{a}-{b}").alias("comparison"), "label", "mean_fst", "n")
        out = one if out is None else out.unionByName(one)
    return out
