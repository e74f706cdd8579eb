"""Queries over chimeric reads, junctions and structural-variant candidates."""

from pyspark.sql import functions as F

from popweave.functions.ordering import running_sum
from popweave.operators import junctions as J
from popweave.operators import reads as R
from popweave.plans.fixtures import Catalog

C = Catalog()
JUNCTIONS = """
a AS (SELECT *, CAST(split_part(sa, ',', 1) AS INT) AS c2_, CAST(split_part(sa, ',', 2) AS BIGINT) AS sp, split_part(sa, ',', 3) AS st, split_part(sa, ',', 4) AS sc, regexp_matches(cigar, '^[0-9]+M') AS front, CAST(regexp_extract(cigar, '([0-9]+)M', 1) AS INT) AS m1
 FROM fx_reads WHERE sa IS NOT NULL AND NOT is_secondary AND mapq > 10 AND regexp_matches(cigar, '^([0-9]+M[0-9]+S|[0-9]+S[0-9]+M)$')),
b AS (SELECT *, front = (st = CASE WHEN is_reverse THEN '-' ELSE '+' END) AS tail, CAST(regexp_extract(sc, '([0-9]+)M', 1) AS INT) AS m2 FROM a),
c AS (SELECT *, contig_ord AS ca, pos + CASE WHEN front THEN m1 - 1 ELSE 0 END AS pa, CASE WHEN front THEN 'r' ELSE 'l' END AS da, sp + CASE WHEN tail THEN -1 ELSE m2 - 2 END AS pb, CASE WHEN tail THEN 'l' ELSE 'r' END AS db, length(seq) - m1 - m2 AS gap FROM b WHERE CASE WHEN tail THEN sc LIKE '%M' ELSE regexp_matches(sc, '^[0-9]+M') END),
d AS (SELECT *, CASE WHEN ca = c2_ THEN pa > pb ELSE ca > c2_ END AS flip, CASE WHEN gap > 0 THEN substr(seq, CASE WHEN front THEN m1 ELSE m2 END + 1, gap) ELSE '' END AS ins FROM c),
f AS (SELECT *, CASE WHEN flip THEN db ELSE da END AS d1, CASE WHEN flip THEN da ELSE db END AS d2, CASE WHEN flip THEN c2_ ELSE ca END AS c1, CASE WHEN flip THEN ca ELSE c2_ END AS c2 FROM d),
j AS (SELECT qname, sample_idx, c1, c2, d1, d2, ins, CASE WHEN flip THEN pb ELSE pa END + CASE WHEN gap > 0 THEN 0 WHEN d1 = 'l' THEN -gap ELSE gap END AS p1, CASE WHEN flip THEN pa ELSE pb END AS p2,
 CASE WHEN c1 <> c2 THEN 'cf' WHEN d1 = 'r' AND d2 = 'l' THEN 'del' WHEN d1 = 'l' AND d2 = 'r' THEN 'dup' ELSE 'inv' END AS type FROM f)"""
KEY = "c1, p1, d1, c2, p2, d2, ins, type"
W = f"WITH {JUNCTIONS.strip()} "


def found(t):
    return J.junctions(R.filter_sv_reads(t.fx_reads))


def reference(t):
    """Contigs made of all documents' sequences in order of their ids, in pieces: places are summed over narrow rows, texts join afterwards."""
    s = t.fx_seqs.withColumn("contig_ord", F.col("seq_id") % 22)
    at = running_sum(s.select("contig_ord", "seq_id", F.length("seq").cast("long").alias("n")), ["contig_ord", "seq_id"], "n", "upto").withColumn("start", F.col("upto") - F.col("n"))
    first = at.groupBy("contig_ord").agg(F.min("start").alias("_first"))  # a row per contig
    at = at.join(F.broadcast(first), "contig_ord").select("seq_id", (F.col("start") - F.col("_first")).alias("start"))
    return s.join(at, "seq_id").select("contig_ord", "start", "seq")


GENOME = "ge AS (SELECT seq_id % 22 AS contig_ord, string_agg(seq, '' ORDER BY seq_id) AS g FROM fx_seqs GROUP BY 1)"


@C.query("junctions", W + f"SELECT qname, {KEY} FROM j")
def _(t):
    return found(t).select("qname", *J.KEY)


@C.query("junction_type", W + "SELECT type, count(*) AS n FROM j GROUP BY type")
def _(t):
    return found(t).groupBy("type").agg(F.count("*").alias("n"))


@C.query("junction_counts", W + f"SELECT {KEY}, count(*) AS n, {', '.join(f'count(*) FILTER (sample_idx = {s}) AS s{s}' for s in range(10))} FROM j GROUP BY {KEY}")
def _(t):
    return J.junction_counts(found(t), list(range(10)))


@C.query("recurrent_short_events", W + f"SELECT {KEY}, count(*) AS n FROM j WHERE type <> 'cf' AND abs(p2 - p1) < 100000 GROUP BY {KEY} HAVING count(*) >= 3")
def _(t):
    return J.recurrent_short_events(J.junction_counts(found(t)), 3)


@C.query("long_event_alleles", W[:-1] + f""", {GENOME}, n AS (SELECT {KEY} FROM j WHERE type <> 'cf' GROUP BY {KEY} HAVING count(*) >= 3),
x AS (SELECT c1, p1, type, ins, substr(g, CAST(p1 + 1 AS INT), CAST(p2 - p1 AS INT)) AS part, substr(g, CAST(p1 + 1 AS INT), 1) AS base FROM n LEFT JOIN ge ON ge.contig_ord = c1 WHERE p2 - p1 >= 100 AND p1 >= 0)
SELECT DISTINCT c1 AS contig_ord, p1 AS pos, type, CASE WHEN type = 'dup' THEN base ELSE part END AS ref, CASE type WHEN 'del' THEN base || ins WHEN 'dup' THEN base || part ELSE reverse(translate(part, 'ACGTN', 'TGCAN')) END AS alt FROM x""")
def _(t):
    return J.long_event_alleles(J.junction_counts(found(t)), reference(t), 3, 100)


@C.query("private_junctions", W + f"SELECT {KEY}, count(*) AS n_in, CAST(0 AS BIGINT) AS n_out FROM j GROUP BY {KEY} HAVING count(*) FILTER (sample_idx < 5) > 1 AND count(*) FILTER (sample_idx >= 5) = 0")
def _(t):
    return J.private_junctions(found(t), F.col("sample_idx") < 5, 1)


@C.query("segregating_deletions", W + f"SELECT {KEY}, count(*) FILTER (sample_idx = 1) AS n_seed, least(count(*) FILTER (sample_idx = 1), count(*) FILTER (sample_idx = 3)) AS n_least, greatest(count(*) FILTER (sample_idx = 0), count(*) FILTER (sample_idx = 2)) AS n_most FROM j WHERE type = 'del' AND ins = '' AND p2 - p1 > 80 AND p2 - p1 < 400 GROUP BY {KEY} HAVING count(*) FILTER (sample_idx = 1) >= 1 AND count(*) FILTER (sample_idx = 3) > 0 AND count(*) FILTER (sample_idx IN (0, 2)) = 0")
def _(t):
    return J.segregating_deletions(found(t), 1, [1, 3], [0, 2], 80, 400, 1)


@C.query("marked_deletions", W[:-1] + f", {GENOME}, n AS (SELECT {KEY}, count(*) AS n_seed FROM j WHERE type = 'del' AND ins = '' AND p2 - p1 > 80 AND p2 - p1 < 400 AND sample_idx = 1 GROUP BY {KEY}) SELECT c1, p1, p2, n_seed, CASE WHEN g IS NULL THEN '[]' ELSE substr(g, CAST(greatest(p1 - 400, 0) + 1 AS INT), CAST(p1 - greatest(p1 - 400, 0) AS INT)) || '[' || substr(g, CAST(p1 + 1 AS INT), CAST(p2 - p1 AS INT)) || ']' || substr(g, CAST(p2 + 1 AS INT), 400) END AS context FROM n LEFT JOIN ge ON ge.contig_ord = c1")
def _(t):
    d = J.segregating_deletions(found(t), 1, [1], [], 80, 400, 1)
    return J.with_marked_segment(d, reference(t)).select("c1", "p1", "p2", "n_seed", "context")


@C.query("set_difference", W + f"SELECT {KEY}, count(*) AS n FROM j x WHERE sample_idx < 8 AND NOT EXISTS (SELECT 1 FROM j y WHERE y.sample_idx >= 8 AND y.c1 = x.c1 AND y.p1 = x.p1 AND y.d1 = x.d1 AND y.c2 = x.c2 AND y.p2 = x.p2 AND y.d2 = x.d2 AND y.ins = x.ins AND y.type = x.type) GROUP BY {KEY} HAVING count(*) > 2")
def _(t):
    j = found(t)
    return J.keys_only_in(J.junction_counts(j.where("sample_idx < 8")), j.where("sample_idx >= 8"), 2)


@C.query("name_match_filter", "SELECT qname, sample_idx, contains(qname, '_1_') AS in_class FROM fx_reads WHERE contains(qname, '7')")
def _(t):
    return t.fx_reads.where(F.col("qname").contains("7")).select("qname", "sample_idx", F.col("qname").contains("_1_").alias("in_class"))


@C.query("linear_position", "SELECT qname, CAST(contig_ord AS BIGINT) * 25000000 + pos AS x FROM fx_reads")
def _(t):
    return t.fx_reads.select("qname", J.linear_position("contig_ord", "pos").alias("x"))


def events(t):
    """Junctions within a contig that at least two reads show, of at most 1000 bases."""
    at = [F.col(c).cast("string") for c in ("c1", "p1", "p2")]
    e = J.junction_counts(found(t)).where("n >= 2 and type <> 'cf' and p1 >= 50 and p2 >= p1 and p2 - p1 <= 1000")
    return e.select(F.concat(at[0], F.lit(":"), at[1], F.lit("-"), at[2], "type").alias("event"), F.col("c1").alias("contig_ord"), F.col("p1").alias("start"), F.col("p2").alias("stop"), F.col("type").alias("kind")).distinct()


EVENTS = f"n2 AS (SELECT {KEY} FROM j WHERE type <> 'cf' AND p1 >= 50 AND p2 >= p1 AND p2 - p1 <= 1000 GROUP BY {KEY} HAVING count(*) >= 2), ev AS (SELECT DISTINCT CAST(c1 AS VARCHAR) || ':' || CAST(p1 AS VARCHAR) || '-' || CAST(p2 AS VARCHAR) || type AS event, c1 AS contig_ord, p1 AS start, p2 AS stop, type AS kind FROM n2)"


@C.query("reads_at_breakpoint", W[:-1] + f", e AS (SELECT *, pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS ref_end FROM fx_reads), {EVENTS} SELECT event, qname, max(e.pos) AS pos FROM e JOIN ev ON e.contig_ord = ev.contig_ord AND ((pos - 5 < start AND ref_end > start) OR (pos - 5 < stop AND ref_end > stop)) GROUP BY event, qname")
def _(t):
    return J.reads_at_breakpoint(t.fx_reads, events(t)).select("event", "qname", "pos")


@C.query("allele_context", W[:-1] + f""", {GENOME},
ev AS (SELECT DISTINCT CAST(c1 AS VARCHAR) || ':' || CAST(p1 AS VARCHAR) || '-' || CAST(p2 AS VARCHAR) || type AS event, c1 AS contig_ord, p1 AS start, p2 AS stop, type AS kind FROM j WHERE type <> 'cf' AND p1 >= 50 AND p2 >= p1),
x AS (SELECT *, substr(g, CAST(start - 49 AS INT), 50) AS l, substr(g, CAST(start + 1 AS INT), CAST(stop - start + 1 AS INT)) AS m, substr(g, CAST(stop + 2 AS INT), 50) AS r FROM ev JOIN ge ON ge.contig_ord = ev.contig_ord),
y AS (SELECT *, reverse(translate(m, 'ACGTN', 'TGCAN')) AS v, kind = 'inv' AND stop - start > 150 AS long FROM x)
SELECT event, CASE WHEN long THEN l || left(m, 100) || right(m, 100) || r ELSE l || m || r END AS ref_seq, CASE WHEN kind = 'del' THEN l || r WHEN kind = 'dup' THEN l || m || m || r WHEN long THEN l || left(v, 100) || right(v, 100) || r ELSE l || v || r END AS alt_seq FROM y""")
def _(t):
    at = [F.col(c).cast("string") for c in ("c1", "p1", "p2")]
    e = found(t).where("type <> 'cf' and p1 >= 50 and p2 >= p1")
    e = e.select(F.concat(at[0], F.lit(":"), at[1], F.lit("-"), at[2], "type").alias("event"), F.col("c1").alias("contig_ord"), F.col("p1").alias("start"), F.col("p2").alias("stop"), F.col("type").alias("kind")).distinct()
    return J.allele_context(e, reference(t)).select("event", "ref_seq", "alt_seq")


_MERS = "list_distinct(list_transform(range(1, length({0}) - 13), lambda i: substr({0}, CAST(i AS INT), 15)))"


@C.query("genotype_by_support", W[:-1] + f""", {GENOME}, {EVENTS}, ex AS (SELECT *, substr(g, CAST(start - 49 AS INT), 50) AS l, substr(g, CAST(start + 1 AS INT), CAST(stop - start + 1 AS INT)) AS m, substr(g, CAST(stop + 2 AS INT), 50) AS r FROM ev JOIN ge ON ge.contig_ord = ev.contig_ord),
ey AS (SELECT *, reverse(translate(m, 'ACGTN', 'TGCAN')) AS v, kind = 'inv' AND stop - start > 150 AS long FROM ex),
al AS (SELECT event, contig_ord, start, stop, CASE WHEN long THEN l || left(m, 100) || right(m, 100) || r ELSE l || m || r END AS ref_seq, CASE WHEN kind = 'del' THEN l || r WHEN kind = 'dup' THEN l || m || m || r WHEN long THEN l || left(v, 100) || right(v, 100) || r ELSE l || v || r END AS alt_seq FROM ey),
ak AS (SELECT *, {_MERS.format('ref_seq')} AS rk, {_MERS.format('alt_seq')} AS bk FROM al),
re AS (SELECT *, pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS ref_end, {_MERS.format('seq')} AS k FROM fx_reads WHERE NOT is_secondary AND mapq > 10),
df AS (SELECT event, sample_idx, len(list_intersect(k, rk)) - len(list_intersect(k, bk)) AS d FROM re e JOIN ak ON e.contig_ord = ak.contig_ord AND ((pos - 5 < start AND ref_end > start) OR (pos - 5 < stop AND ref_end > stop))),
gn AS (SELECT event, sample_idx, count(*) FILTER (d > 10) AS ref_reads, count(*) FILTER (d < -10) AS alt_reads, count(*) FILTER (abs(d) <= 10) AS ambiguous FROM df GROUP BY 1, 2)
SELECT *, CASE WHEN ref_reads = 0 AND alt_reads = 0 THEN './.' WHEN ref_reads > 4 * alt_reads THEN '0/0' WHEN ref_reads < alt_reads / 4.0 THEN '1/1' ELSE '0/1' END AS gt FROM gn""")
def _(t):
    e = events(t)
    return J.genotype_by_support(J.reads_at_breakpoint(t.fx_reads, e), J.allele_context(e, reference(t)))


@C.query("genotype_by_alignment")
def _(t):
    e = events(t)
    return J.genotype_by_alignment(J.reads_at_breakpoint(t.fx_reads, e), J.allele_context(e, reference(t)))


@C.query("geno_vector", "SELECT site_id, sample_idx, CAST(coalesce(a1, 0) + coalesce(a2, 0) AS INTEGER) AS n FROM fx_genotypes")
def _(t):
    gt = F.concat_ws("/", F.coalesce(F.col("a1").cast("string"), F.lit(".")), F.coalesce(F.col("a2").cast("string"), F.lit(".")))
    return t.fx_genotypes.withColumn("gt", gt).select("site_id", "sample_idx", J.geno_vector("gt").alias("n"))
