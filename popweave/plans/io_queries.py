"""Queries over sources and sinks: tables written in a format and read back, and the registration stream."""

from pyspark.sql import functions as F

from popweave.functions.scratch import shared_dir
from popweave.operators import reads as R
from popweave.operators import variants as V
from popweave.operators.registry import anti_join_done
from popweave.plans.fixtures import SAMPLES, Catalog
from popweave.plans.read_queries import CLASSIFIED
from popweave.sources import readers as S
from popweave.sources import writers as K
from popweave.streaming.register import register_runs_stream

C = Catalog()
ROWS_PER_FILE = 500_000  # of compressed text, whose files are read by one task each
RUNS = "Run string, BioSample long, Note string, Bases long, Files string"


def runs(t):
    note = F.concat(F.lit('lab "'), F.col("BioProject"), F.lit('", one\\ two'))
    return t.fx_runs.select("Run", F.col("BioSample").cast("long").alias("BioSample"), note.alias("Note"), "Bases", F.concat("Run", F.lit("_1.fq,,"), "Run", F.lit("_2.fq")).alias("Files"))


RUNS_SQL = r"""SELECT Run, BioSample, 'lab "' || BioProject || '", one\ two' AS Note, Bases, Run || '_2.fq' AS second FROM fx_runs"""


def _back(df):
    return df.select("Run", "BioSample", "Note", "Bases", F.get(S.split_files(), 1).alias("second"))


@C.query("scan_csv", RUNS_SQL)
def _(t):
    path = f"{shared_dir(t.spark)}/runs"
    runs(t).write.option("header", True).option("escape", "\\").option("quoteAll", True).csv(path)
    return _back(S.scan_csv(t.spark, path, RUNS))


@C.query("scan_sheet", RUNS_SQL)
def _(t):
    path = f"{shared_dir(t.spark)}/sheet.parquet"
    runs(t).write.parquet(path)
    return _back(S.scan_sheet(t.spark, path, RUNS))


@C.query("write_csv", "SELECT site_id, contig_ord, pos FROM fx_sites")
def _(t):
    path = f"{shared_dir(t.spark)}/sites"
    K.write_csv(t.fx_sites.select("site_id", "contig_ord", "pos"), path)
    return S.scan_csv(t.spark, path, "site_id long, contig_ord long, pos long")


@C.query("scan_tsv_named", "SELECT 'q' || CAST(q_ord AS VARCHAR) AS Q_Name, q_start AS Q_Start, strand AS Q_Strand, aln_len AS AlignmentLength, aln_type AS AlignmentType FROM fx_paf")
def _(t):
    path = f"{shared_dir(t.spark)}/paf"
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = t.fx_paf.select(name("q_ord", "q"), F.lit(0), "q_start", "q_stop", "strand", name("r_ord", "r"), F.lit(0), "r_start", "r_stop", "residues_match", "aln_len", "mapq", "aln_type", *[F.lit("x").alias(c) for c in "cdefg"])
    rows.write.option("sep", "\t").csv(path)
    return S.scan_tsv_named(t.spark, path).select("Q_Name", "Q_Start", "Q_Strand", "AlignmentLength", "AlignmentType")


@C.query("scan_tsv_pruned", "SELECT CAST(contig_ord AS VARCHAR) AS \"#CHROM\", CAST(pos AS VARCHAR) AS POS FROM fx_sites")
def _(t):
    path = f"{shared_dir(t.spark)}/afreq"
    t.fx_sites.select(F.col("contig_ord").alias("#CHROM"), F.col("pos").alias("POS"), "ref", "alt").write.option("sep", "\t").option("header", True).csv(path)
    return S.scan_tsv_pruned(t.spark, path, ["#CHROM", "POS"])


def _vcf(t):
    samples = [f"S{k}" for k in SAMPLES]
    s = t.fx_sites.join(F.broadcast(t.fx_contigs.select("contig_ord", "contig")), "contig_ord")
    size = F.when(F.col("site_id") % 10 == 0, 25_000).otherwise(F.length("ref") - 1)
    events = s.select(F.col("site_id").alias("event"), "contig", F.col("pos"), "ref", "alt", F.col("pos").alias("start"), (F.col("pos") + size).alias("stop"), F.when(F.col("site_id") % 2 == 0, "inv").otherwise("del").alias("svtype"))
    g = V.called(t.fx_genotypes)
    calls = g.select(F.col("site_id").alias("event"), F.concat(F.lit("S"), F.col("sample_idx").cast("string")).alias("sample"), F.concat_ws("/", F.col("a1").cast("string"), F.col("a2").cast("string")).alias("gt"), F.col("ad_ref").alias("rr"), F.col("ad_alt").alias("ar"), F.lit(0).alias("br"))
    contigs = [(r.contig, r.contig_len) for r in t.fx_contigs.orderBy("contig_ord").collect()]  # one row per contig
    path = f"{shared_dir(t.spark)}/vcf"
    K.write_vcf(events, calls, contigs, samples, "20000101", path)
    return S.scan_vcf(t.spark, f"{path}/*")


@C.query("scan_vcf", "SELECT contig, pos - 1 AS pos, CASE WHEN s.site_id % 10 = 0 THEN left(ref, 1) ELSE ref END AS ref, CASE WHEN s.site_id % 10 <> 0 THEN alt WHEN s.site_id % 2 = 0 THEN '<INV>' ELSE '<DEL>' END AS alt, k AS sample_idx, coalesce(CASE WHEN a1 IS NOT NULL THEN CAST(a1 AS VARCHAR) || '/' || CAST(a2 AS VARCHAR) END, './.') AS gt, CASE WHEN a1 IS NULL THEN 0 ELSE ad_ref END AS rr FROM fx_sites s JOIN fx_contigs c ON c.contig_ord = s.contig_ord CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(0, 125)) r LEFT JOIN fx_genotypes g ON g.site_id = s.site_id AND sample_idx = k")
def _(t):
    _, calls = _vcf(t)
    f = F.col("fields")
    return calls.select("contig", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), F.substring("sample", 2, 9).cast("int").alias("sample_idx"), f["GT"].alias("gt"), f["RR"].cast("int").alias("rr"))


@C.query("write_vcf", "SELECT contig, pos - 1 AS pos, CASE WHEN s.site_id % 10 = 0 THEN left(ref, 1) ELSE ref END AS ref, CASE WHEN s.site_id % 10 <> 0 THEN alt WHEN s.site_id % 2 = 0 THEN '<INV>' ELSE '<DEL>' END AS alt, CASE WHEN s.site_id % 2 = 0 THEN 'INV' ELSE 'DEL' END AS svtype, pos + CASE WHEN s.site_id % 10 = 0 THEN 25000 ELSE length(ref) - 1 END AS stop, CAST(CASE WHEN s.site_id % 10 = 0 THEN 25000 ELSE length(ref) - 1 END + 1 AS BIGINT) AS svlen, coalesce(n, 0) AS ns FROM fx_sites s JOIN fx_contigs c ON c.contig_ord = s.contig_ord LEFT JOIN (SELECT site_id, count(*) AS n FROM fx_genotypes WHERE a1 IS NOT NULL GROUP BY 1) k ON k.site_id = s.site_id")
def _(t):
    sites, _ = _vcf(t)
    return sites.select("contig", "pos", "ref", F.get("alt", F.lit(0)).alias("alt"), "svtype", "stop", F.col("info")["SVLEN"].cast("long").alias("svlen"), F.col("info")["NS"].cast("long").alias("ns"))


def _text(df, path, rows=ROWS_PER_FILE):
    """Compressed text, in files of at most so many rows."""
    df.write.option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


FLAGS = [("is_paired", 1), ("is_proper_pair", 2), ("is_unmapped", 4), ("mate_is_unmapped", 8), ("is_reverse", 16), ("mate_is_reverse", 32), ("is_secondary", 256), ("is_duplicate", 1024)]


def _sam(t):
    flag = sum(F.when(F.col(c), b).otherwise(0) for c, b in FLAGS)
    mate = F.when(F.col("contig_ord") == F.col("next_contig_ord"), "=").otherwise(F.concat(F.lit("c"), F.col("next_contig_ord").cast("string")))
    text = lambda c: F.col(c).cast("string")
    cells = ["qname", flag.cast("string"), F.concat(F.lit("c"), text("contig_ord")), (F.col("pos") + 1).cast("string"), text("mapq"), "cigar", mate, (F.col("next_pos") + 1).cast("string"), text("isize"), "seq", "qual", F.concat(F.lit("SA:Z:"), "sa"), F.when(F.col("has_xm"), "XM:i:1")]
    path = f"{shared_dir(t.spark)}/sam"
    _text(t.fx_reads.select(F.concat_ws("\t", *cells).alias("value")).where("not value like '@%'"), path)
    return S.scan_sam(t.spark, path)


@C.query("scan_sam", "SELECT qname, 'c' || CAST(contig_ord AS VARCHAR) AS contig, pos, 'c' || CAST(next_contig_ord AS VARCHAR) AS next_contig, next_pos, is_proper_pair, is_secondary, is_duplicate, sa, has_xm, qual FROM fx_reads")
def _(t):
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return _sam(t).select("qname", "contig", "pos", "next_contig", "next_pos", "is_proper_pair", "is_secondary", "is_duplicate", tag("SA").alias("sa"), tag("XM").isNotNull().alias("has_xm"), "qual")


@C.query("fetch_region", "SELECT qname FROM fx_reads WHERE contig_ord = 3 AND pos < 7000 AND pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) > 4000")
def _(t):
    return S.fetch(_sam(t), "c3", 4000, 7000).select("qname")


@C.query("scan_fastq", "SELECT qname AS name, CASE WHEN mapq % 7 = 0 THEN '' ELSE seq END AS seq1, seq AS seq2 FROM fx_reads")
def _(t):
    path = shared_dir(t.spark)
    for k, seq in ((1, F.when(F.col("mapq") % 7 == 0, "").otherwise(F.col("seq"))), (2, F.col("seq"))):  # both sides of a pair in the order of one table
        _text(t.fx_reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname", F.lit(f"/{k} x")), seq, F.lit("+"), "qual")), f"{path}/{k}")
    pair = S.scan_fastq_pair(t.spark, f"{path}/1", f"{path}/2")
    return pair.select(F.regexp_replace("name", "/1$", "").alias("name"), "seq1", "seq2")


def _fasta(t):
    path = f"{shared_dir(t.spark)}/fasta"
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    t.fx_seqs.select(F.concat(F.lit(">s"), F.col("seq_id").cast("string"), F.lit(" about\n"), wrapped)).write.text(path)
    return path


@C.query("scan_fasta", "SELECT 's' || CAST(seq_id AS VARCHAR) AS contig, seq, CAST(length(seq) AS INTEGER) AS contig_len FROM fx_seqs")
def _(t):
    return S.scan_fasta(t.spark, _fasta(t))


@C.query("fasta_pieces", "WITH k AS (SELECT seq_id, seq, unnest(range(CAST(ceil(length(seq) / 60.0) AS BIGINT))) * 60 AS off FROM fx_seqs WHERE length(seq) > 0), b AS (SELECT seq_id, seq, CAST(min(off) AS BIGINT) AS start, max(off) + 60 AS stop FROM k GROUP BY seq_id, seq, off // 1000) SELECT 's' || CAST(seq_id AS VARCHAR) AS contig, start, substr(seq, CAST(start + 1 AS INT), CAST(stop - start AS INT)) AS seq FROM b")
def _(t):
    return S.scan_fasta_pieces(t.spark, _fasta(t), 1000).select("contig", "start", "seq")


@C.query("region_slice", "SELECT 's' || CAST(seq_id AS VARCHAR) AS contig, substr(seq, 11, 20) AS seq FROM fx_seqs")
def _(t):
    path = _fasta(t)
    regions = t.fx_seqs.select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("contig"), F.lit(10).alias("start"), F.lit(30).alias("stop"))
    return S.region_slice(S.scan_fasta_pieces(t.spark, path), regions).select("contig", "seq")


@C.query("scan_gtf", "SELECT 'c' || CAST(contig_ord AS VARCHAR) AS chrom, start_pos AS start, stop_pos AS stop, strand, 'G' || CAST(gene_id AS VARCHAR) AS name, biotype FROM fx_genes WHERE gene_id % 4 <> 0")
def _(t):
    path = f"{shared_dir(t.spark)}/gtf"
    feature = F.when(F.col("gene_id") % 4 == 0, "exon").otherwise("gene")
    attributes = F.concat(F.lit('gene_id "G'), F.col("gene_id").cast("string"), F.lit('"; gene_biotype "'), "biotype", F.lit('";'))
    cells = [F.concat(F.lit("c"), F.col("contig_ord").cast("string")), F.lit("src"), feature, F.col("start_pos").cast("string"), F.col("stop_pos").cast("string"), F.lit("."), F.col("strand"), F.lit("."), attributes]
    t.fx_genes.select(F.concat_ws("\t", *cells).alias("value")).unionByName(t.spark.createDataFrame([("#!comment",)], "value string")).write.text(path)
    return S.scan_gtf(t.spark, path)


@C.query("scan_runinfo_xml", "SELECT 'F' || min(Run) AS flowcell, 'I' || BioProject AS instrument, '2000-01-01' AS date FROM fx_runs GROUP BY BioProject")
def _(t):
    path = f"{shared_dir(t.spark)}/xml"
    one = t.fx_runs.groupBy("BioProject").agg(F.min("Run").alias("r"))  # a handful of projects, a file each
    xml = F.concat(F.lit("<Info><Run><Flowcell>F"), "r", F.lit("</Flowcell><Instrument>I"), "BioProject", F.lit("</Instrument><Date>2000-01-01</Date></Run><Run><Flowcell>x</Flowcell></Run></Info>"))
    one.select("BioProject", xml.alias("value")).repartition("BioProject").write.partitionBy("BioProject").text(path)
    return S.scan_runinfo_xml(t.spark, f"{path}/*").select("flowcell", "instrument", "date")


@C.query("scan_samplesheet", "SELECT sample_id, ecogroup FROM fx_samples")
def _(t):
    path = f"{shared_dir(t.spark)}/sheet"
    lines = F.concat_ws(",", "sample_id", "ecogroup")
    rows = t.fx_samples.agg(F.array_join(F.sort_array(F.collect_list(lines)), "\n").alias("x"))  # one small sheet
    preamble = "\n".join(f"preamble {i}" for i in range(19)) + "\nSample_ID,Group\n"
    rows.select(F.concat(F.lit(preamble), "x")).coalesce(1).write.text(path)
    return S.scan_samplesheet(t.spark, path, ["sample_id", "ecogroup"])


@C.query("scan_freq_bins", "SELECT site_id, sample_idx, CAST(coalesce(a1, 0) AS INTEGER) AS alt, 2 AS total FROM fx_genotypes")
def _(t):
    g = t.fx_genotypes.select("site_id", "sample_idx", F.concat(F.lit("("), F.coalesce("a1", F.lit(0)).cast("string"), F.lit(", 2)")).alias("cell"))
    x = S.decode_tuple("cell")
    return g.select("site_id", "sample_idx", x[0].alias("alt"), x[1].alias("total"))


@C.query("html_tables", r"WITH u AS (SELECT page_id, regexp_extract_all(html, '(?is)<ul\b[^>]*>(.*?)</ul>', 1) AS x FROM pages), v AS (SELECT page_id, unnest(x) AS l, generate_subscripts(x, 1) - 1 AS table_no FROM u), w AS (SELECT page_id, table_no, regexp_extract_all(l, '(?is)<li\b[^>]*>(.*?)</li>', 1) AS y FROM v), z AS (SELECT page_id, table_no, unnest(y) AS c, generate_subscripts(y, 1) - 1 AS row_no FROM w) SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS cells FROM z")
def _(t):
    html = F.col("html")  # the pages have lists: each is read as a table of one column
    for mark, to in ((r"(?i)<ul\b[^>]*>", "<table>"), (r"(?i)</ul>", "</table>"), (r"(?i)<li\b[^>]*>", "<tr><td>"), (r"(?i)</li>", "</td></tr>")):
        html = F.regexp_replace(html, mark, to)
    return S.html_tables(t.pages.select("page_id", html.alias("html"))).withColumn("cells", F.array_join("cells", "|"))


@C.query("html_items", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1)) AS INTEGER) AS n FROM pages WHERE len(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1)) > 0")
def _(t):
    return S.html_items(t.pages).groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


@C.query("write_by_key", "SELECT interval_name, count(*) AS n FROM fx_genes g JOIN fx_intervals v ON g.contig_ord = v.contig_ord AND start_pos > out_start AND stop_pos < out_stop GROUP BY 1")
def _(t):
    from popweave.operators.intervals import interval_contains

    path = f"{shared_dir(t.spark)}/by_interval"
    K.write_by_key(interval_contains(t.fx_genes, t.fx_intervals), path, "interval_name")
    return t.spark.read.parquet(path).groupBy("interval_name").agg(F.count("*").alias("n"))


@C.query("write_bed", "SELECT contig, pos - 1 AS start, pos AS stop FROM fx_sites s JOIN fx_contigs c ON c.contig_ord = s.contig_ord")
def _(t):
    path = f"{shared_dir(t.spark)}/bed"
    K.write_bed(t.fx_sites.join(F.broadcast(t.fx_contigs), "contig_ord"), path)
    return S.scan_tsv_named(t.spark, path, S.BED_SCHEMA)


@C.query("write_read_classes", f"WITH {CLASSIFIED.strip()} SELECT class, count(*) AS n FROM cl GROUP BY class")
def _(t):
    path = f"{shared_dir(t.spark)}/classes"
    K.write_read_classes(R.classify_reads(t.fx_reads), path)
    return t.spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("n"))


@C.query("write_phylip", "SELECT CAST(sample_idx AS VARCHAR) AS sample, (SELECT count(*) FROM (SELECT site_id FROM fx_genotypes WHERE a1 IS NOT NULL GROUP BY site_id HAVING count(*) >= 20)) AS n FROM fx_samples")
def _(t):
    path = f"{shared_dir(t.spark)}/phylip"
    K.write_phylip(V.iupac_tiles(t.fx_genotypes, t.fx_sites, 20, t.fx_samples, 50).withColumn("sample", F.col("sample_idx").cast("string")), path)
    return S.scan_phylip(t.spark, path).groupBy("sample").agg(F.sum(F.length("sequence")).alias("n"))


@C.query("append_registry", "SELECT Run, BioSample FROM fx_runs")
def _(t):
    path = f"{shared_dir(t.spark)}/registry"
    r = t.fx_runs.select("Run", "BioSample", "already_registered")
    for job, rows in (("first", r.where("already_registered")), ("second", r), ("second", r)):  # the second job runs twice
        K.append_registry(rows, path, job, "Run")
    return K.read_registry(t.spark, path).select("Run", "BioSample")


@C.query("register_runs_stream", "SELECT Run, BioSample, LibraryLayout FROM fx_runs WHERE LibraryLayout IN ('PAIRED', 'SINGLE')")
def _(t):
    base = shared_dir(t.spark)
    r = t.fx_runs.select("Run", F.col("BioSample").cast("long").alias("BioSample"), "LibraryLayout")
    r.unionByName(r.where("BioSample % 3 = 0")).repartition(3).write.parquet(f"{base}/new")  # some runs arrive twice
    register_runs_stream(t.spark, f"{base}/new", "Run string, BioSample long, LibraryLayout string", f"{base}/registry", f"{base}/stream").awaitTermination()
    return t.spark.read.parquet(f"{base}/registry").select("Run", "BioSample", "LibraryLayout")
