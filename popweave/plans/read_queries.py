"""Queries over alignment records."""

from pyspark.sql import functions as F

from popweave.operators import reads as R
from popweave.plans.fixtures import Catalog

C = Catalog()
ENDS = "e AS (SELECT *, pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS ref_end FROM fx_reads)"
REGIONS = "g AS (SELECT gene_id AS region, contig_ord, start_pos % 50000 AS start, start_pos % 50000 + CASE WHEN gene_id % 5 = 4 THEN 20000 ELSE stop_pos - start_pos END AS stop FROM fx_genes)"
SITES = "st AS (SELECT site_id, contig_ord, pos % 50000 AS loc, site_id % 2 AS side FROM fx_sites)"
CLASSES = ["unmapped", "chimeric", "clipped", "discordant", "inversion", "duplication"]
PHRED = "list_sum(list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT) - 33)) / CAST(length({0}) AS DOUBLE)"
CLASSIFIED = f"""
q AS (SELECT *, {PHRED.format('qual')} AS phred,
  CASE WHEN cigar LIKE '40S%' THEN {PHRED.format('left(qual, 40)')} WHEN cigar LIKE '30S%' THEN {PHRED.format('left(qual, 30)')} WHEN cigar = '35M65S' THEN {PHRED.format('right(qual, 65)')} END AS cq,
  cigar IN ('40S60M', '30S70M', '35M65S') AS one FROM fx_reads WHERE NOT is_duplicate),
k AS (SELECT *, CASE WHEN sa IS NOT NULL THEN 'chimeric' WHEN one AND NOT has_xm AND NOT is_secondary AND mapq <> 0 AND cq > 25 THEN 'clipped' END AS c1,
  CASE WHEN mate_is_unmapped THEN NULL WHEN contig_ord <> next_contig_ord THEN 'discordant' WHEN is_reverse = mate_is_reverse THEN 'inversion'
   WHEN ((pos < next_pos AND is_reverse) OR (pos > next_pos AND mate_is_reverse)) AND abs(isize) > 102 THEN 'duplication' END AS c2 FROM q),
cl AS (SELECT qname, sample_idx, 'unmapped' AS class FROM k WHERE is_unmapped AND phred > 25
 UNION ALL SELECT qname, sample_idx, c1 FROM k WHERE NOT is_unmapped AND c1 IS NOT NULL
 UNION ALL SELECT qname, sample_idx, c2 FROM k WHERE NOT is_unmapped AND c2 IS NOT NULL)"""


def regions(t):
    """The genes, some of them with 20,000 bases, where the reads are."""
    start = F.col("start_pos") % 50_000
    return t.fx_genes.select(F.col("gene_id").alias("region"), "contig_ord", start.alias("start"), (start + F.when(F.col("gene_id") % 5 == 4, 20_000).otherwise(F.col("stop_pos") - F.col("start_pos"))).alias("stop"))


def places(t):
    """The variant sites, where the reads are."""
    return t.fx_sites.select("site_id", "contig_ord", (F.col("pos") % 50_000).alias("pos"), (F.col("site_id") % 2).alias("side"))


@C.query("filter_qtl_reads", "SELECT qname FROM fx_reads WHERE is_paired AND NOT is_unmapped AND NOT mate_is_unmapped AND is_proper_pair AND abs(isize) <= 3000 AND mapq >= 40 AND regexp_full_match(cigar, '[0-9]+M')")
def _(t):
    return R.filter_qtl_reads(t.fx_reads).select("qname")


@C.query("filter_sv_reads", "SELECT qname, 10 AS q FROM fx_reads WHERE NOT is_secondary AND mapq > 10 AND sa IS NOT NULL UNION ALL SELECT qname, 30 FROM fx_reads WHERE NOT is_secondary AND mapq > 30 AND sa IS NOT NULL")
def _(t):
    a, b = (R.filter_sv_reads(t.fx_reads, q).select("qname", F.lit(q).alias("q")) for q in (10, 30))
    return a.unionByName(b)


@C.query("filter_nonempty_fastq", "SELECT name, name || ' 1:N:0:2' AS name1, name || ' 2:N:0:2' AS name2 FROM (SELECT qname AS name, CASE WHEN mapq % 7 = 0 THEN '' ELSE seq END AS seq1, CASE WHEN mapq % 5 = 0 THEN NULL ELSE seq END AS seq2 FROM fx_reads) WHERE length(seq1) > 0 AND length(seq2) > 0")
def _(t):
    pairs = t.fx_reads.select(F.col("qname").alias("name"), F.when(F.col("mapq") % 7 == 0, "").otherwise(F.col("seq")).alias("seq1"), F.when(F.col("mapq") % 5 != 0, F.col("seq")).alias("seq2"))
    return R.filter_nonempty_pairs(pairs).select("name", "name1", "name2")


@C.query("classify_reads", f"WITH {CLASSIFIED.strip()} SELECT qname, class FROM cl")
def _(t):
    return R.classify_reads(t.fx_reads).select("qname", "class")


@C.query("category_counts", f"WITH {CLASSIFIED.strip()} SELECT sample_idx, {', '.join(f'count(*) FILTER (class = {chr(39)}{c}{chr(39)}) AS {c}' for c in CLASSES)} FROM cl GROUP BY sample_idx")
def _(t):
    return R.category_counts(R.classify_reads(t.fx_reads), "sample_idx", CLASSES)


@C.query("mean_phred", f"SELECT qname, round({PHRED.format('qual')}, 6) AS phred FROM fx_reads")
def _(t):
    return t.fx_reads.select("qname", F.round(R.mean_phred("qual"), 6).alias("phred"))


@C.query("cigar_ops", "SELECT cigar, count(*) AS n, CAST(len(regexp_extract_all(cigar, '[0-9]+[A-Z]')) AS INTEGER) AS n_ops, regexp_extract(cigar, '^[0-9]+([A-Z])', 1) AS first_op, right(cigar, 1) AS last_op, CAST(length(cigar) - length(replace(cigar, 'S', '')) AS INTEGER) AS n_s, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)M', 1), lambda x: CAST(x AS BIGINT))) AS INTEGER) AS mapped FROM fx_reads GROUP BY cigar")
def _(t):
    ops = t.fx_reads.groupBy("cigar").agg(F.count("*").alias("n")).withColumn("o", R.cigar_ops("cigar"))
    return ops.select("cigar", "n", F.size("o").alias("n_ops"), F.get("o", F.lit(0))["op"].alias("first_op"), F.element_at("o", -1)["op"].alias("last_op"), R.op_count("cigar", "S").alias("n_s"), R.cigar_length("cigar", "M").alias("mapped"))


@C.query("reverse_complement", "SELECT seq_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM fx_seqs")
def _(t):
    return t.fx_seqs.select("seq_id", R.reverse_complement("seq").alias("rc"))


@C.query("read_group_string", r"SELECT Run, '@RG\tID:' || Run || '\tLB:' || BioProject || '\tSM:' || CAST(BioSample AS VARCHAR) || '\tPL:' || Platform AS rg, list_filter(string_split('x_' || Platform || '_L00' || CAST(BioSample % 4 AS VARCHAR) || '_R1', '_'), lambda x: starts_with(x, 'L'))[1] AS lane FROM fx_runs")
def _(t):
    name = F.concat(F.lit("x_"), "Platform", F.lit("_L00"), (F.col("BioSample") % 4).cast("string"), F.lit("_R1"))
    return t.fx_runs.select("Run", R.read_group_string("Run", "BioProject", "BioSample", "Platform").alias("rg"), R.lane_token(name).alias("lane"))


_PILE = "p AS (SELECT contig_ord, seq, cigar, pos + k AS ref_pos, CASE WHEN cigar = '50M2D50M' THEN CASE WHEN k < 50 THEN substr(seq, k + 1, 1) WHEN k < 52 THEN NULL ELSE substr(seq, k - 1, 1) END ELSE substr(seq, k + 1 + CASE WHEN cigar = '40S60M' THEN 40 WHEN cigar = '4S96M' THEN 4 WHEN cigar = '10S80M10S' THEN 10 WHEN cigar = '30S70M' THEN 30 ELSE 0 END, 1) END AS base, k, sample_idx FROM (SELECT *, unnest(range(0, ref_end - pos)) AS k FROM e))"


@C.query("pileup_bases", f"WITH {ENDS}, {_PILE} SELECT contig_ord, ref_pos AS pos, base || CASE WHEN cigar = '50M2D50M' AND k = 49 THEN '-2' ELSE '' END AS shown, count(*) AS n FROM p WHERE base IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    return R.pileup_bases(t.fx_reads)


@C.query("site_allele_depths", f"WITH {ENDS}, {_PILE}, s AS (SELECT contig_ord, (site_id * 7919) % 50000 + 50 AS pos, ref, alt FROM fx_sites) SELECT p.contig_ord, s.pos, sample_idx, count(*) FILTER (base = ref) AS ad_ref, count(*) FILTER (base = alt) AS ad_alt FROM p JOIN s ON p.contig_ord = s.contig_ord AND ref_pos = s.pos WHERE base IS NOT NULL GROUP BY 1, 2, 3")
def _(t):
    sites = t.fx_sites.select("contig_ord", ((F.col("site_id") * 7919) % 50_000 + 50).alias("pos"), "ref", "alt")  # where the reads are
    return R.site_allele_depths(t.fx_reads, sites, "sample_idx")


@C.query("mean_coverage_region", f"WITH {ENDS}, {REGIONS}, n AS (SELECT region, count(*) AS n_reads, sum(least(ref_end, stop + 1) - greatest(pos, start)) AS bases FROM e JOIN g ON e.contig_ord = g.contig_ord AND pos < stop + 1 AND ref_end > start GROUP BY region) SELECT g.region, round(CASE WHEN stop - start > 10000 THEN coalesce(n_reads, 0) * 100.0 / (stop - start + 1) ELSE coalesce(bases, 0) / (stop - start + 1.0) END, 9) AS coverage FROM g LEFT JOIN n ON n.region = g.region")
def _(t):
    return R.mean_coverage_region(t.fx_reads, regions(t), 100.0).withColumn("coverage", F.round("coverage", 9))


@C.query("median_read_length", "SELECT median(length(seq)) AS median_length FROM (SELECT seq FROM fx_reads ORDER BY qname LIMIT 100001)")
def _(t):
    return R.median_read_length(t.fx_reads, "qname")


@C.query("mean_coverage", "SELECT count(*) AS n_reads, round(count(*) * 100.0 / (SELECT sum(contig_len) FROM fx_contigs), 9) AS coverage FROM fx_reads WHERE NOT is_unmapped")
def _(t):
    return R.mean_coverage(t.fx_reads, t.fx_contigs, 100.0).withColumn("coverage", F.round("coverage", 9))


@C.query("nearby_coverage", f"WITH {ENDS}, {SITES}, b AS (SELECT site_id AS region, contig_ord, CASE WHEN side = 0 THEN loc ELSE greatest(loc - 500, 0) END AS start, CASE WHEN side = 0 THEN loc + 500 ELSE loc END AS stop FROM st), n AS (SELECT region, sum(least(ref_end, stop + 1) - greatest(pos, start)) AS bases FROM e JOIN b ON e.contig_ord = b.contig_ord AND pos < stop + 1 AND ref_end > start GROUP BY region) SELECT b.region, round(coalesce(bases, 0) / (stop - start + 1.0), 9) AS coverage FROM b LEFT JOIN n ON n.region = b.region")
def _(t):
    b = places(t).select(F.col("site_id").alias("region"), "contig_ord", "pos", F.when(F.col("side") == 0, "left").otherwise("right").alias("side"))
    return R.mean_coverage_region(t.fx_reads, R.nearby_regions(b, 500), 100.0).withColumn("coverage", F.round("coverage", 9))


_BINS = "b AS (SELECT e.*, contig_len, unnest(range(greatest(CAST(floor((pos - 500) / 250.0) AS BIGINT) + 1, 0), least(CAST(floor((ref_end - 1) / 250.0) AS BIGINT), CAST(floor((contig_len - 501) / 250.0) AS BIGINT)) + 1)) * 250 AS bin FROM e JOIN fx_contigs c ON c.contig_ord = e.contig_ord)"


@C.query("overlapping_bins", f"WITH {ENDS}, {_BINS} SELECT contig_ord, bin, count(*) AS n FROM b GROUP BY 1, 2")
def _(t):
    return R.overlapping_bins(t.fx_reads, t.fx_contigs).groupBy("contig_ord", "bin").agg(F.count("*").alias("n"))


_STRANDS = "s AS (SELECT contig_ord, contig_len, bin, count(*) FILTER (NOT is_reverse) AS forward, count(*) FILTER (is_reverse) AS reverse FROM b WHERE NOT regexp_matches(cigar, '[SH]') GROUP BY 1, 2, 3)"


@C.query("strand_counts", f"WITH {ENDS}, {_BINS}, {_STRANDS} SELECT contig_ord, bin, forward, reverse FROM s")
def _(t):
    return R.strand_counts(R.overlapping_bins(t.fx_reads, t.fx_contigs))


@C.query("insertion_islands", f"""WITH {ENDS}, {_BINS}, {_STRANDS}, h AS (SELECT contig_ord, bin FROM s x WHERE forward > 1 AND forward > 5 * reverse AND bin + 2000 < contig_len
  AND EXISTS (SELECT 1 FROM s y WHERE y.contig_ord = x.contig_ord AND y.bin IN (x.bin + 500, x.bin + 1000, x.bin + 1500) AND y.reverse > 1 AND y.reverse > 5 * y.forward))
SELECT contig_ord, bin + 500 AS mid FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.contig_ord = x.contig_ord AND y.bin = x.bin + 250)""")
def _(t):
    return R.insertion_islands(R.strand_counts(R.overlapping_bins(t.fx_reads, t.fx_contigs)), t.fx_contigs, 1)


@C.query("read_end_distance", f"WITH {ENDS}, {SITES} SELECT site_id, min(least(loc - pos, ref_end - 1 - loc)) AS least_distance, count(*) FILTER (regexp_matches(cigar, '[SH]')) AS clipped FROM e JOIN st ON e.contig_ord = st.contig_ord AND pos <= loc AND ref_end > loc WHERE NOT is_unmapped AND NOT is_secondary AND mapq > 0 GROUP BY site_id")
def _(t):
    return R.read_end_distance(t.fx_reads, places(t).drop("side"))


_CLIPS = "c AS (SELECT contig_ord, qname, CASE WHEN cigar = '35M65S' THEN ref_end ELSE pos END AS clip_pos, CASE WHEN cigar = '35M65S' THEN 'right' ELSE 'left' END AS side, CASE cigar WHEN '35M65S' THEN right(seq, 65) WHEN '40S60M' THEN reverse(left(seq, 40)) WHEN '4S96M' THEN reverse(left(seq, 4)) ELSE reverse(left(seq, 30)) END AS clip FROM e WHERE cigar IN ('35M65S', '40S60M', '4S96M', '30S70M'))"


@C.query("clip_consensus", f"""WITH {ENDS}, {_CLIPS}, x AS (SELECT contig_ord, clip_pos, side, i, substr(clip, i, 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(1, length(clip) + 1)) AS i FROM c) GROUP BY 1, 2, 3, 4, 5),
y AS (SELECT *, sum(n) OVER (PARTITION BY contig_ord, clip_pos, side, i) AS depth, row_number() OVER (PARTITION BY contig_ord, clip_pos, side, i ORDER BY n DESC, base) AS k FROM x)
SELECT contig_ord, clip_pos, side, string_agg(CASE WHEN depth = 1 THEN '' WHEN n / depth >= 0.74 THEN base ELSE 'N' END, '' ORDER BY i) AS consensus FROM y WHERE k = 1 GROUP BY 1, 2, 3""")
def _(t):
    return R.clip_consensus(R.clips(t.fx_reads))


@C.query("longest_clip", f"WITH {ENDS}, {_CLIPS} SELECT contig_ord, clip_pos, side, clip, qname FROM (SELECT *, row_number() OVER (PARTITION BY contig_ord, clip_pos, side ORDER BY length(clip) DESC, qname) AS k FROM c) WHERE k = 1")
def _(t):
    return R.longest_clip(R.clips(t.fx_reads))


@C.query("mark_duplicates", f"""WITH {ENDS}, f AS (SELECT *, CASE WHEN is_reverse THEN ref_end + CASE WHEN cigar = '35M65S' THEN 65 WHEN cigar = '10S80M10S' THEN 10 ELSE 0 END ELSE pos - CASE cigar WHEN '40S60M' THEN 40 WHEN '4S96M' THEN 4 WHEN '10S80M10S' THEN 10 WHEN '30S70M' THEN 30 ELSE 0 END END AS five,
 list_sum(list_transform(string_split(qual, ''), lambda c: CAST(ascii(c) AS BIGINT) - 33)) AS q FROM e)
SELECT qname, row_number() OVER (PARTITION BY sample_idx, contig_ord, five, is_reverse, next_contig_ord, next_pos ORDER BY q DESC, qname) > 1 AS duplicate FROM f""")
def _(t):
    return R.mark_duplicates(t.fx_reads).select("qname", "duplicate")


@C.query("mate_lookup", f"""WITH {ENDS}, s AS (SELECT site_id, contig_ord, pos % 50000 AS p FROM fx_sites),
a AS (SELECT site_id, qname, next_contig_ord AS c, next_pos AS np, false AS want FROM e JOIN s ON e.contig_ord = s.contig_ord AND pos < p AND ref_end > p - 250 WHERE NOT is_reverse
 UNION ALL SELECT site_id, qname, next_contig_ord, next_pos, true FROM e JOIN s ON e.contig_ord = s.contig_ord AND pos < p + 250 AND ref_end > p WHERE is_reverse)
SELECT site_id, a.qname, CASE WHEN m.is_reverse <> want THEN seq ELSE reverse(translate(seq, 'ACGTN', 'TGCAN')) END AS mate_seq FROM a JOIN fx_reads m ON m.qname = a.qname AND m.contig_ord = c AND abs(m.pos - np) <= 1""")
def _(t):
    return R.mate_lookup(t.fx_reads, places(t).drop("side"))
