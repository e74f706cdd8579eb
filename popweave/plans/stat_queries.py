"""Queries over population statistics, intervals, genes, alignments between genomes, and k-mers."""

from pyspark.sql import functions as F

from popweave.functions.sizes import small
from popweave.operators import intervals as I
from popweave.operators import kmers as K
from popweave.operators import popgen as G
from popweave.operators import variants as V
from popweave.plans.fixtures import SAMPLES, Catalog
from popweave.plans.variant_queries import POPS, ordered_intervals, pops

C = Catalog()
NUM = "nu AS (SELECT *, row_number() OVER (ORDER BY contig_ord, pos, site_id) AS rn FROM fx_sites)"
WC = f"""{POPS}, wp AS (SELECT site_id, pop, CAST(count(*) AS DOUBLE) AS n, sum(a1 + a2) / (2.0 * count(*)) AS p, count(*) FILTER (a1 <> a2) / CAST(count(*) AS DOUBLE) AS h FROM fx_genotypes g JOIN pm ON pm.sample_idx = g.sample_idx WHERE pop IN ('m', 'f') AND a1 IS NOT NULL GROUP BY 1, 2),
wt AS (SELECT site_id, sum(n) / 2 AS nb, sum(n) - sum(n * n) / sum(n) AS nc, sum(n * p) / sum(n) AS pb, sum(n * h) / sum(n) AS hb, sum(n * p * p) AS npp, sum(n) AS nt FROM wp GROUP BY 1 HAVING count(*) = 2),
ws AS (SELECT *, (npp - nt * pb * pb) / nb AS s2 FROM wt),
wc AS (SELECT site_id, nb / nullif(nc, 0) * (s2 - (pb * (1 - pb) - s2 / 2 - hb / 4) / nullif(nb - 1, 0)) AS a, nb / nullif(nb - 1, 0) * (pb * (1 - pb) - s2 / 2 - (2 * nb - 1) * hb / (4 * nb)) AS b, hb / 2 AS c FROM ws)"""
BLOCKS = f"{NUM}, bl AS (SELECT *, CAST(floor((rn - 1) / 20) AS BIGINT) AS block FROM nu WHERE floor((rn - 1) / 20) < floor((SELECT count(*) FROM fx_sites) / 20))"


@C.query("weir_cockerham_blocks", f"WITH {WC}, {BLOCKS} SELECT block, arg_min(contig_ord, rn) AS contig_ord, arg_min(pos, rn) AS pos, round(sum(a) / nullif(sum(a + b + c), 0), 6) AS fst FROM bl LEFT JOIN wc ON wc.site_id = bl.site_id GROUP BY block")
def _(t):
    two = pops(t).where("pop in ('m', 'f')")
    return G.weir_cockerham_blocks(t.fx_genotypes, two, t.fx_sites, 20).withColumn("fst", F.round("fst", 6))


@C.query("block_rows", f"WITH {BLOCKS} SELECT site_id, rn, block FROM bl")
def _(t):
    return G.block_rows(t.fx_sites, 20).select("site_id", F.col("rn").cast("long").alias("rn"), "block")


@C.query("moving_average", f"WITH {NUM} SELECT site_id, round(avg(qual) OVER (PARTITION BY contig_ord ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) AS smooth FROM nu")
def _(t):
    return G.moving_average(G.numbered(t.fx_sites), "qual", 20).select("site_id", F.round("smooth", 6).alias("smooth"))


@C.query("moving_average_reflected", f"WITH {NUM}, top AS (SELECT max(rn) AS m FROM nu), re AS (SELECT rn, qual FROM nu UNION ALL SELECT 1 - rn, qual FROM nu WHERE rn <= 10 UNION ALL SELECT 2 * m + 1 - rn, qual FROM nu, top WHERE rn > m - 10), av AS (SELECT rn, avg(qual) OVER (ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS smooth FROM re) SELECT site_id, round(smooth, 6) AS smooth FROM nu JOIN av ON av.rn = nu.rn")
def _(t):
    return G.moving_average_reflected(G.numbered(t.fx_sites), "qual", 20).select("site_id", F.round("smooth", 6).alias("smooth"))


OFFSETS = "la AS (SELECT contig_ord, max(pos) AS last FROM fx_sites GROUP BY 1), ofs AS (SELECT contig_ord, coalesce(sum(last) OVER (ORDER BY contig_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM la)"


@C.query("max_by_group", "SELECT contig_ord, max(pos) AS last FROM fx_sites GROUP BY contig_ord")
def _(t):
    return t.fx_sites.groupBy("contig_ord").agg(F.max("pos").alias("last"))


@C.query("cumulative_offset", f"WITH {OFFSETS} SELECT site_id, CAST(pos + o AS BIGINT) AS x FROM fx_sites s JOIN ofs ON ofs.contig_ord = s.contig_ord")
def _(t):
    return G.cumulative_offset(t.fx_sites).select("site_id", F.col("x").cast("long").alias("x"))


@C.query("group_midpoint", f"WITH {OFFSETS}, x AS (SELECT s.contig_ord, pos + o AS x FROM fx_sites s JOIN ofs ON ofs.contig_ord = s.contig_ord) SELECT contig_ord, CAST(max(x) AS DOUBLE) - (max(x) - min(x)) / 2.0 AS mid FROM x GROUP BY contig_ord")
def _(t):
    return G.group_midpoint(G.cumulative_offset(t.fx_sites)).withColumn("mid", F.col("mid").cast("double"))


@C.query("sex_scan", f"""WITH {WC}, {BLOCKS}, {OFFSETS}, he AS (SELECT site_id, count(*) FILTER (sex = 'm' AND a1 <> a2) / nullif(CAST(count(*) FILTER (sex = 'm' AND a1 IS NOT NULL) AS DOUBLE), 0) - count(*) FILTER (sex = 'f' AND a1 <> a2) / nullif(CAST(count(*) FILTER (sex = 'f' AND a1 IS NOT NULL) AS DOUBLE), 0) AS d FROM fx_genotypes g JOIN fx_samples s ON s.sample_idx = g.sample_idx GROUP BY 1),
k AS (SELECT block, arg_min(bl.contig_ord, rn) AS contig_ord, arg_min(pos, rn) AS pos, sum(a) / nullif(sum(a + b + c), 0) AS fst, avg(d) AS het_diff FROM bl LEFT JOIN wc ON wc.site_id = bl.site_id LEFT JOIN he ON he.site_id = bl.site_id GROUP BY block)
SELECT block, CAST(k.pos + o AS BIGINT) AS x, round(fst, 6) AS fst, round(het_diff, 6) AS het_diff FROM k JOIN ofs ON ofs.contig_ord = k.contig_ord""")
def _(t):
    g, sites = t.fx_genotypes, t.fx_sites
    two = pops(t).where("pop in ('m', 'f')")
    het = V.heterozygosity(g.join(small(two), "sample_idx"), ["site_id", "pop"]).groupBy("site_id").agg((F.max(F.when(F.col("pop") == "m", F.col("het"))) - F.max(F.when(F.col("pop") == "f", F.col("het")))).alias("d"))
    diff = G.block_rows(sites, 20).join(het, "site_id", "left").groupBy("block").agg(F.avg("d").alias("het_diff"))
    out = G.cumulative_offset(G.weir_cockerham_blocks(g, two, sites, 20), G.contig_offsets(sites)).join(diff, "block")
    return out.select("block", F.col("x").cast("long").alias("x"), F.round("fst", 6).alias("fst"), F.round("het_diff", 6).alias("het_diff"))


DIST = "na AS (SELECT site_id, sample_idx, coalesce(a1, 0) + coalesce(a2, 0) AS n FROM fx_genotypes), pd AS (SELECT x.sample_idx AS i, y.sample_idx AS j, sum(abs(x.n - y.n)) AS d FROM na x JOIN na y ON x.site_id = y.site_id AND x.sample_idx <> y.sample_idx GROUP BY 1, 2)"


@C.query("pairwise_distance", f"WITH {DIST} SELECT i, j, round(d / 950000.0, 9) AS distance FROM pd")
def _(t):
    return G.pairwise_distance(t.fx_genotypes, 950_000.0).withColumn("distance", F.round("distance", 9))


@C.query("pairwise_self_join", "SELECT a.sample_idx AS i, b.sample_idx AS j, a.organism <> b.organism AS apart FROM fx_samples a JOIN fx_samples b ON a.sample_idx <> b.sample_idx")
def _(t):
    return G.pairwise_samples(t.fx_samples, "sample_idx", ["organism"]).select("i", "j", (F.col("organism_i") != F.col("organism_j")).alias("apart"))


@C.query("distance_table", f"""WITH {DIST} SELECT i, j, round(d / 950000.0, 9) AS distance, a.ecogroup AS eco_i, b.ecogroup AS eco_j, CASE WHEN a.karyotype = 'Heterozygous' OR b.karyotype = 'Heterozygous' THEN 'Het' WHEN a.karyotype <> 'Inverted' AND b.karyotype <> 'Inverted' THEN 'NonInv' WHEN a.karyotype = 'Inverted' AND b.karyotype = 'Inverted' THEN 'Inv' END AS kind,
 round((CASE a.karyotype WHEN 'Inverted' THEN 1 WHEN 'Heterozygous' THEN 0.5 ELSE 0 END + CASE b.karyotype WHEN 'Inverted' THEN 1 WHEN 'Heterozygous' THEN 0.5 ELSE 0 END) / 2.0, 6) AS dose
 FROM pd JOIN fx_samples a ON a.sample_idx = i JOIN fx_samples b ON b.sample_idx = j WHERE a.organism <> b.organism""")
def _(t):
    cols = ["organism", "ecogroup", "karyotype"]
    p = G.pairwise_samples(t.fx_samples, "sample_idx", cols).where("organism_i <> organism_j")
    d = G.pairwise_distance(t.fx_genotypes, 950_000.0).join(p, ["i", "j"])
    both = lambda k: (F.col("karyotype_i") == k) & (F.col("karyotype_j") == k)
    neither = (F.col("karyotype_i") != "Inverted") & (F.col("karyotype_j") != "Inverted")
    het = (F.col("karyotype_i") == "Heterozygous") | (F.col("karyotype_j") == "Heterozygous")
    kind = G.conditional_assign(None, (both("Inverted"), "Inv"), (neither, "NonInv"), (het, "Het"))
    dose = {"Normal": 0.0, "Heterozygous": 0.5, "Inverted": 1.0, "Unknown": 0.0}
    mean = (G.dict_recode("karyotype_i", dose) + G.dict_recode("karyotype_j", dose)) / 2
    return d.select("i", "j", F.round("distance", 9).alias("distance"), F.col("ecogroup_i").alias("eco_i"), F.col("ecogroup_j").alias("eco_j"), kind.alias("kind"), F.round(mean, 6).alias("dose"))


@C.query("conditional_assign", "SELECT sample_idx, CASE WHEN karyotype = 'Heterozygous' THEN 'Het' WHEN karyotype = 'Normal' THEN 'NonInv' WHEN karyotype IS NOT NULL THEN 'Inv' END AS kind FROM fx_samples")
def _(t):
    k = F.col("karyotype")
    return t.fx_samples.select("sample_idx", G.conditional_assign(None, (k.isNotNull(), "Inv"), (k == "Normal", "NonInv"), (k == "Heterozygous", "Het")).alias("kind"))


@C.query("dict_recode", "SELECT ecogroup, round(avg(CASE karyotype WHEN 'Inverted' THEN 1.0 WHEN 'Heterozygous' THEN 0.5 ELSE 0.0 END), 6) AS dose FROM fx_samples GROUP BY ecogroup")
def _(t):
    return t.fx_samples.groupBy("ecogroup").agg(F.round(F.avg(G.dict_recode("karyotype", {"Normal": 0.0, "Heterozygous": 0.5, "Inverted": 1.0})), 6).alias("dose"))


@C.query("mean_by_group", "SELECT ecogroup, CAST(CASE ecogroup WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS INTEGER) AS place, round(avg(read_length), 6) AS mean_length FROM fx_samples GROUP BY ecogroup")
def _(t):
    place = F.coalesce(G.dict_recode("ecogroup", {"BUILDING": 1, "MACHINERY": 2}), F.lit(3))
    return t.fx_samples.groupBy("ecogroup").agg(F.round(F.avg("read_length"), 6).alias("mean_length")).withColumn("place", place)


KING = "kc AS (SELECT site_id, sample_idx, a1 + a2 AS n FROM fx_genotypes WHERE a1 IS NOT NULL AND a2 IS NOT NULL), kp AS (SELECT x.sample_idx AS i, y.sample_idx AS j, count(*) AS n, count(*) FILTER (x.n = 1 AND y.n = 1) AS both_, count(*) FILTER (abs(x.n - y.n) = 2) AS opp, count(*) FILTER (x.n = 1) AS hi, count(*) FILTER (y.n = 1) AS hj FROM kc x JOIN kc y ON x.site_id = y.site_id AND x.sample_idx < y.sample_idx GROUP BY 1, 2), ki AS (SELECT i, j, n, (both_ - 2 * opp) / nullif(2.0 * least(hi, hj), 0) + 0.5 - (hi + hj) / nullif(4.0 * least(hi, hj), 0) AS phi, (both_ - 2 * opp) / nullif(CAST(hi + hj AS DOUBLE), 0) AS r2 FROM kp)"


@C.query("kinship_king", f"WITH {KING} SELECT i, j, n, round(phi, 6) AS phi, round(r2, 6) AS relatedness2 FROM ki")
def _(t):
    return G.kinship_king(t.fx_genotypes).withColumns({"phi": F.round("phi", 6), "relatedness2": F.round("relatedness2", 6)})


@C.query("kinship_matrix", f"WITH {KING}, cl AS (SELECT i, j, phi FROM ki UNION ALL SELECT j, i, phi FROM ki UNION ALL SELECT i, i, 0.5 FROM ki UNION ALL SELECT j, j, 0.5 FROM ki) SELECT i, {', '.join(f'round(max(phi) FILTER (j = {s}), 6) AS s{s}' for s in SAMPLES)} FROM cl GROUP BY i")
def _(t):
    king = G.kinship_king(t.fx_genotypes)
    return G.kinship_matrix(king.withColumn("phi", F.round("phi", 6)), SAMPLES)


@C.query("hist_proportion", "WITH b AS (SELECT event_type, least(floor(value / 100.0 * 100) + 1, 100) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2) SELECT event_type, CAST(bin AS BIGINT) AS bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS proportion FROM b")
def _(t):
    return G.hist_proportion(t.events, "value", "event_type", 100.0).withColumn("proportion", F.round("proportion", 6))


@C.query("hist_density", "WITH b AS (SELECT event_type, floor(value / 10.0) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2) SELECT event_type, CAST(bin AS BIGINT) AS bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 10.0), 9) AS density FROM b")
def _(t):
    return G.hist_density(t.events, "value", "event_type", 10.0).withColumn("density", F.round("density", 9))


@C.query("interval_label", "WITH iv AS (SELECT *, row_number() OVER (ORDER BY contig_ord, interval_name) AS o FROM fx_intervals) SELECT site_id, coalesce((SELECT arg_max(interval_name, o) FROM iv WHERE iv.contig_ord = s.contig_ord AND pos > out_start AND pos < out_stop), 'Normal') AS label FROM fx_sites s")
def _(t):
    return I.interval_label(t.fx_sites, ordered_intervals(t)).select("site_id", "label")


@C.query("interval_contains", "SELECT gene_id, interval_name FROM fx_genes g JOIN fx_intervals v ON g.contig_ord = v.contig_ord AND start_pos > out_start AND stop_pos < out_stop")
def _(t):
    return I.interval_contains(t.fx_genes, t.fx_intervals).select("gene_id", "interval_name")


@C.query("region_subset", "SELECT site_id, interval_name FROM fx_sites s JOIN fx_intervals v ON s.contig_ord = v.contig_ord AND pos BETWEEN least(in_start, in_stop) AND greatest(in_start, in_stop)")
def _(t):
    return I.region_subset(t.fx_sites, t.fx_intervals).select("site_id", "interval_name")


@C.query("fixed_bin", "SELECT contig_ord, CAST(floor(pos / 500000) * 500000 AS BIGINT) AS bin, count(*) AS n FROM fx_sites GROUP BY 1, 2")
def _(t):
    return t.fx_sites.groupBy("contig_ord", I.fixed_bin("pos").alias("bin")).agg(F.count("*").alias("n"))


@C.query("running_bin", f"WITH {NUM} SELECT contig_ord, CAST(floor((rn - 1) / 20) AS BIGINT) AS bin, count(*) AS n FROM nu GROUP BY 1, 2")
def _(t):
    return I.running_bin(t.fx_sites).groupBy("contig_ord", "bin").agg(F.count("*").alias("n"))


WIN = "w AS (SELECT site_id, s.contig_ord, unnest(range(CAST(greatest(ceil((pos - 200000) / 20000.0), 0) AS BIGINT), CAST(least(floor(pos / 20000.0), ceil((contig_len - 200000) / 20000.0) - 1) AS BIGINT) + 1)) * 20000 AS win_start FROM fx_sites s JOIN fx_contigs c ON c.contig_ord = s.contig_ord)"


@C.query("sliding_het", f"WITH {WIN} SELECT contig_ord, win_start, sample_idx, count(*) FILTER (a1 IS NOT NULL) AS n_sites, round(count(*) FILTER (a1 <> a2) / nullif(CAST(count(*) FILTER (a1 IS NOT NULL) AS DOUBLE), 0), 6) AS het FROM w JOIN fx_genotypes g ON g.site_id = w.site_id GROUP BY 1, 2, 3")
def _(t):
    return I.sliding_het(t.fx_genotypes, t.fx_sites, t.fx_contigs).withColumn("het", F.round("het", 6))


@C.query("pivot_individuals", f"WITH {WIN}, h AS (SELECT contig_ord, win_start, sample_idx, count(*) FILTER (a1 <> a2) / nullif(CAST(count(*) FILTER (a1 IS NOT NULL) AS DOUBLE), 0) AS het FROM w JOIN fx_genotypes g ON g.site_id = w.site_id GROUP BY 1, 2, 3) SELECT contig_ord, win_start, {', '.join(f'round(max(het) FILTER (sample_idx = {s}), 6) AS s{s}' for s in SAMPLES)} FROM h GROUP BY 1, 2")
def _(t):
    h = I.sliding_het(t.fx_genotypes, t.fx_sites, t.fx_contigs)
    return I.pivot_individuals(h.withColumn("het", F.round("het", 6)), ["contig_ord", "win_start"], SAMPLES, "het")


PAF = "ps AS (SELECT *, CASE WHEN strand = '-' THEN q_stop ELSE q_start END AS new_start, CASE WHEN strand = '-' THEN q_start ELSE q_stop END AS new_stop, residues_match / nullif(CAST(aln_len AS DOUBLE), 0) AS pm FROM fx_paf), pf AS (SELECT * FROM ps WHERE pm > 0.3 AND aln_type = 'tp:A:P' AND aln_len > 10000)"
PAFKEY = ["genome_version", "r_ord", "q_ord"]


@C.query("strand_swap", f"WITH {PAF} SELECT genome_version, r_ord, r_start, q_start, new_start, new_stop, round(pm, 6) AS percent_match FROM ps")
def _(t):
    return I.strand_swap(t.fx_paf).select("genome_version", "r_ord", "r_start", "q_start", "new_start", "new_stop", F.round("percent_match", 6).alias("percent_match"))


@C.query("filter_paf", f"WITH {PAF} SELECT 10000 AS least, r_ord, q_ord, r_start, aln_len FROM pf UNION ALL SELECT 300, r_ord, q_ord, r_start, aln_len FROM ps WHERE pm > 0.5 AND aln_type = 'tp:A:P' AND aln_len > 300")
def _(t):
    s = I.strand_swap(t.fx_paf)
    a, b = (I.filter_paf(s, m, n).select(F.lit(n).alias("least"), "r_ord", "q_ord", "r_start", "aln_len") for m, n in ((0.3, 10_000), (0.5, 300)))
    return a.unionByName(b)


@C.query("sum_by_pair", "SELECT r_ord, q_ord, CAST(sum(aln_len) AS BIGINT) AS total_len FROM fx_paf GROUP BY 1, 2")
def _(t):
    return I.sum_by_pair(t.fx_paf)


@C.query("keep_major_pairs", "SELECT r_ord, q_ord, r_start, aln_len FROM (SELECT *, sum(aln_len) OVER (PARTITION BY r_ord, q_ord) AS s FROM fx_paf) q WHERE s > 2500000")
def _(t):
    return I.keep_major_pairs(t.fx_paf, 2_500_000).select("r_ord", "q_ord", "r_start", "aln_len")


@C.query("melt_endpoints", f"WITH {PAF} SELECT genome_version, r_ord, q_ord, 'R_Start' AS aln_loc, r_start AS position, new_start AS position2 FROM ps UNION ALL SELECT genome_version, r_ord, q_ord, 'R_Stop', r_stop, new_stop FROM ps")
def _(t):
    return I.melt_endpoints(I.strand_swap(t.fx_paf), PAFKEY)


@C.query("paf_summary", f"WITH {PAF}, mj AS (SELECT * FROM (SELECT *, sum(aln_len) OVER (PARTITION BY r_ord, q_ord) AS s FROM pf) q WHERE s > 1000000) SELECT genome_version, r_ord, q_ord, 'R_Start' AS aln_loc, r_start AS position, new_start AS position2 FROM mj UNION ALL SELECT genome_version, r_ord, q_ord, 'R_Stop', r_stop, new_stop FROM mj")
def _(t):
    return I.paf_summary(t.fx_paf, PAFKEY, least_pair=1_000_000)


@C.query("contig_map_join", "SELECT genome_version, c.lg, d.lg AS q_lg, count(*) AS n FROM fx_paf p JOIN fx_contigs c ON c.contig_ord = r_ord JOIN fx_contigs d ON d.contig_ord = q_ord GROUP BY 1, 2, 3")
def _(t):
    c = t.fx_contigs
    r, q = c.select(F.col("contig_ord").alias("r_ord"), "lg"), c.select(F.col("contig_ord").alias("q_ord"), F.col("lg").alias("q_lg"))
    return t.fx_paf.join(F.broadcast(r), "r_ord").join(F.broadcast(q), "q_ord").groupBy("genome_version", "lg", "q_lg").agg(F.count("*").alias("n"))


@C.query("union_all", "SELECT 'a' AS set, r_ord, aln_len FROM fx_paf WHERE strand = '+' UNION ALL SELECT 'b', r_ord, aln_len FROM fx_paf WHERE mapq > 25")
def _(t):
    label = lambda d, n: d.select(F.lit(n).alias("set"), "r_ord", "aln_len")
    return label(t.fx_paf.where("strand = '+'"), "a").unionByName(label(t.fx_paf.where("mapq > 25"), "b"))


@C.query("concat_partitions", "SELECT site_id, contig_ord, pos FROM fx_sites WHERE contig_ord < 11 UNION ALL SELECT site_id, contig_ord, pos FROM fx_sites WHERE contig_ord >= 11")
def _(t):
    s = t.fx_sites.select("site_id", "contig_ord", "pos")
    return s.where("contig_ord < 11").unionByName(s.where("contig_ord >= 11")).repartitionByRange("contig_ord", "pos").sortWithinPartitions("contig_ord", "pos")


@C.query("sort_by", "SELECT r_ord, r_start, aln_len, row_number() OVER (PARTITION BY r_ord ORDER BY r_start, aln_len, q_start) AS place FROM fx_paf")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("r_ord").orderBy("r_start", "aln_len", "q_start")
    return t.fx_paf.select("r_ord", "r_start", "aln_len", F.row_number().over(w).cast("long").alias("place")).orderBy("r_ord", "r_start")


@C.query("top_k_per_group", "SELECT r_ord, q_ord, CAST(total_len AS BIGINT) AS total_len, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY r_ord ORDER BY total_len DESC, q_ord) AS rank FROM (SELECT r_ord, q_ord, sum(aln_len) AS total_len FROM fx_paf GROUP BY 1, 2) x) y WHERE rank <= 3")
def _(t):
    return I.top_k_per_group(I.sum_by_pair(t.fx_paf), "r_ord", [F.desc("total_len"), F.col("q_ord")])


DIMS = ["biotype", "human_relationship", "strand"]


@C.query("count_by_category", " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS category, count(gene_id) AS n FROM fx_genes WHERE {d} IS NOT NULL GROUP BY 2" for d in DIMS))
def _(t):
    return I.category_counts(t.fx_genes, DIMS)


NAMES = ["LG2", "LG9", "LG10", "LG11a", "LG11b", "LG13", "LG20a", "LG20b"]


@C.query("category_by_interval", f"WITH x AS (SELECT human_relationship AS category, interval_name FROM fx_genes g JOIN fx_intervals v ON g.contig_ord = v.contig_ord AND start_pos > out_start AND stop_pos < out_stop WHERE human_relationship IS NOT NULL UNION ALL SELECT human_relationship, 'All' FROM fx_genes WHERE human_relationship IS NOT NULL) SELECT category, {', '.join(f'count(*) FILTER (interval_name = {chr(39)}{n}{chr(39)}) AS {chr(34)}{n}{chr(34)}' for n in ['All', *NAMES])} FROM x GROUP BY category")
def _(t):
    return I.category_by_interval(t.fx_genes, t.fx_intervals, "human_relationship", NAMES)


@C.query("first_per_group", "SELECT biotype, arg_min(human_relationship, gene_id) FILTER (human_relationship IS NOT NULL) AS human_relationship, arg_min(gene_name, gene_id) AS gene_name FROM fx_genes GROUP BY biotype")
def _(t):
    return I.first_per_group(t.fx_genes, "biotype", ["human_relationship", "gene_name"], "gene_id")


@C.query("left_join_genes", "SELECT g.gene_id, o.ortholog_id FROM fx_genes g LEFT JOIN (SELECT gene_name AS ortholog_name, gene_id AS ortholog_id FROM fx_genes WHERE gene_id % 3 = 0) o ON o.ortholog_name = g.gene_name")
def _(t):
    o = t.fx_genes.where("gene_id % 3 = 0").select(F.col("gene_name").alias("ortholog_name"), F.col("gene_id").alias("ortholog_id"))
    return I.left_join_genes(t.fx_genes, o).select("gene_id", "ortholog_id")


@C.query("agg_mixed", "SELECT contig_ord, CAST(sum(n_alt_alleles) AS BIGINT) AS n_alt_alleles, arg_min(ref, site_id) AS ref, round(avg(qual), 6) AS qual FROM fx_sites GROUP BY contig_ord")
def _(t):
    return I.agg_mixed(t.fx_sites, ["contig_ord"], ["n_alt_alleles"], "ref", "site_id", "qual").withColumn("qual", F.round("qual", 6))


@C.query("join_back_group", "SELECT site_id FROM (SELECT *, avg(qual) OVER (PARTITION BY contig_ord) AS m FROM fx_sites) q WHERE abs(qual - m) < 5")
def _(t):
    return I.join_back_group(t.fx_sites, ["contig_ord"], "qual", 5.0).select("site_id")


EDGES = "rs AS (SELECT seq, 1 AS f FROM fx_seqs WHERE length(seq) > 9 UNION ALL SELECT reverse(translate(seq, 'ACGTN', 'TGCAN')), 0 FROM fx_seqs WHERE length(seq) > 9), me AS (SELECT substr(seq, i, 10) AS e, f FROM (SELECT *, unnest(range(1, length(seq) - 8)) AS i FROM rs)), ed AS (SELECT left(e, 9) AS src, right(e, 9) AS dst, sum(f) AS forward, sum(1 - f) AS backward FROM me GROUP BY e)"


@C.query("kmer_edges", f"WITH {EDGES} SELECT src, dst, CAST(forward AS BIGINT) AS forward, CAST(backward AS BIGINT) AS backward FROM ed")
def _(t):
    return K.kmer_edges(t.fx_seqs, 9)


@C.query("kmer_prune", f"WITH {EDGES}, en AS (SELECT src AS node, forward + backward AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, forward + backward FROM ed), wk AS (SELECT node FROM en GROUP BY node HAVING sum(o) <= 2 AND sum(i) <= 2) SELECT src, dst, CAST(forward AS BIGINT) AS forward, CAST(backward AS BIGINT) AS backward FROM ed WHERE src NOT IN (SELECT node FROM wk) AND dst NOT IN (SELECT node FROM wk)")
def _(t):
    return K.kmer_prune(K.kmer_edges(t.fx_seqs, 9))


@C.query("kmer_sources", f"WITH {EDGES} SELECT DISTINCT src AS node FROM ed WHERE src NOT IN (SELECT dst FROM ed)")
def _(t):
    return K.kmer_sources(K.kmer_edges(t.fx_seqs, 9))


@C.query("kmer_best_successor", f"WITH {EDGES} SELECT src, CAST(forward + backward AS BIGINT) AS n, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY forward + backward DESC, dst) AS k FROM ed) q WHERE k = 1")
def _(t):
    return K.kmer_best_successor(K.kmer_edges(t.fx_seqs, 9))


PATHS = f"{EDGES}, en AS (SELECT src AS node, forward + backward AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, forward + backward FROM ed), wk AS MATERIALIZED (SELECT node FROM en GROUP BY node HAVING sum(o) <= 2 AND sum(i) <= 2), pr AS MATERIALIZED (SELECT * FROM ed WHERE src NOT IN (SELECT node FROM wk) AND dst NOT IN (SELECT node FROM wk)), bs AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY forward + backward DESC, dst) AS k FROM pr) q WHERE k = 1)"


@C.query("kmer_paths", f"""WITH RECURSIVE {PATHS},
wa AS (SELECT DISTINCT src AS node, src AS at, 0 AS steps, src AS seq FROM pr WHERE src NOT IN (SELECT dst FROM pr)
 UNION ALL SELECT node, dst, steps + 1, seq || right(dst, 1) FROM wa JOIN bs ON bs.src = wa.at WHERE steps < 2000)
SELECT node, steps, CASE WHEN steps >= 2000 THEN '' ELSE seq END AS seq FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY steps DESC) AS k FROM wa) q WHERE k = 1""")
def _(t):
    return K.kmer_paths(K.kmer_prune(K.kmer_edges(t.fx_seqs, 9)))


@C.query("suffix_dedupe", "SELECT seq_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY right(seq, 6) ORDER BY length(seq) DESC, seq, seq_id) AS k FROM fx_seqs) q WHERE k = 1")
def _(t):
    return K.suffix_dedupe(t.fx_seqs, 6)


@C.query("short_species", "SELECT sample_id, left(organism, 1) || '_' || split_part(organism, ' ', 2) AS species FROM fx_samples")
def _(t):
    return t.fx_samples.select("sample_id", K.short_species("organism").alias("species"))


@C.query("relabel_tokens", "SELECT sample_id, '((' || ecogroup || '_G_' || left(organism, 1) || '_' || split_part(organism, ' ', 2) || ':0.1,' || sample_id || '9:0.2),x);' AS tree FROM fx_samples")
def _(t):
    s = t.fx_samples.withColumn("label", F.concat("ecogroup", F.lit("_G_"), K.short_species("organism")))
    tree = F.concat(F.lit("(("), "sample_id", F.lit(":0.1,"), "sample_id", F.lit("9:0.2),x);"))
    one = s.select("sample_id", tree.alias("tree"), F.create_map("sample_id", "label").alias("labels"))
    return one.select("sample_id", K.relabel_tokens("tree", "labels").alias("tree"))


EVENTS = "ev AS (SELECT contig_ord, start, stop, kind, row_number() OVER (PARTITION BY contig_ord ORDER BY start, stop, kind) AS i FROM (SELECT r_ord AS contig_ord, CAST(floor(r_start / 1000) AS BIGINT) AS start, CAST(floor(r_stop / 1000) AS BIGINT) AS stop, CASE WHEN strand = '-' THEN 'inv' ELSE 'del' END AS kind FROM fx_paf) q)"
NEAR = "(abs(e.start - k.a) <= 5 OR abs(e.stop - k.b) <= 5) AND NOT (e.kind = 'inv' AND k.d <> 'inv')"


@C.query("suppress_overlaps", f"""WITH RECURSIVE {EVENTS},
kp AS (SELECT contig_ord, i, start AS a, stop AS b, kind AS d, true AS kept FROM ev WHERE i = 1
 UNION ALL SELECT e.contig_ord, e.i, CASE WHEN {NEAR} THEN k.a ELSE e.start END, CASE WHEN {NEAR} THEN k.b ELSE e.stop END, CASE WHEN {NEAR} THEN k.d ELSE e.kind END, NOT ({NEAR}) FROM kp k JOIN ev e ON e.contig_ord = k.contig_ord AND e.i = k.i + 1)
SELECT contig_ord, a AS start, b AS stop, d AS kind FROM kp WHERE kept""")
def _(t):
    e = t.fx_paf.select(F.col("r_ord").alias("contig_ord"), F.floor(F.col("r_start") / 1000).alias("start"), F.floor(F.col("r_stop") / 1000).alias("stop"), F.when(F.col("strand") == "-", "inv").otherwise("del").alias("kind"))
    return K.suppress_overlaps(e)
