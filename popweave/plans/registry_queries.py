"""Queries over registries of runs and samples."""

from pyspark.sql import functions as F

from popweave.operators import registry as R
from popweave.functions import values
from popweave.plans.fixtures import Catalog

C = Catalog()


@C.query("rename_reselect", "SELECT Run AS RunID, BioSample AS SampleID, Bases AS TotalBases FROM fx_runs")
def _(t):
    return R.rename_reselect(t.fx_runs, {"Run": "RunID", "BioSample": "SampleID", "Bases": "TotalBases"})


@C.query("require_columns", "SELECT count(*) AS n FROM fx_runs")
def _(t):
    return R.require_columns(t.fx_runs, ["Run", "BioSample", "LibraryLayout"]).agg(F.count("*").alias("n"))


@C.query("require_unique", "SELECT BioSample, count(*) AS n FROM fx_runs GROUP BY BioSample HAVING count(*) > 1")
def _(t):
    return R.duplicate_keys(R.require_unique(t.fx_runs, "Run"), "BioSample")


@C.query("require_known", "SELECT DISTINCT BioSample FROM fx_runs WHERE BioSample NOT IN (SELECT sample_idx FROM fx_samples)")
def _(t):
    return R.unknown_ids(t.fx_runs, t.fx_samples.withColumnRenamed("sample_idx", "BioSample"), "BioSample")


@C.query("filter_samples", "SELECT sample_id, 'project' AS by FROM fx_samples WHERE project_id IN ('PRJ1', 'PRJ3') UNION ALL SELECT sample_id, 'sample' FROM fx_samples WHERE sample_id = 'S0007' UNION ALL SELECT sample_id, 'ecogroup' FROM fx_samples WHERE ecogroup = 'BUILDING' UNION ALL SELECT sample_id, 'all' FROM fx_samples")
def _(t):
    s, one = t.fx_samples, lambda d, by: d.select("sample_id", F.lit(by).alias("by"))
    out = one(R.filter_samples(s, projects=["PRJ1", "PRJ3"], samples=["S0001"]), "project")
    for by, arg in (("sample", {"samples": ["S0007"]}), ("ecogroup", {"ecogroups": ["BUILDING"]}), ("all", {})):
        out = out.unionByName(one(R.filter_samples(s, **arg), by))
    return out


@C.query("filter_exclude", "SELECT gene_id, human_relationship FROM fx_genes WHERE (human_relationship IS NULL OR human_relationship NOT IN ('Brand#11', 'Brand#12')) AND strand <> '-'")
def _(t):
    return R.filter_exclude(t.fx_genes, human_relationship=["Brand#11", "Brand#12"], strand=["-"]).select("gene_id", "human_relationship")


@C.query("filter_layout", "SELECT LibraryLayout, LibraryLayout NOT IN ('PAIRED', 'SINGLE') AS rejected, count(*) AS n FROM fx_runs GROUP BY 1, 2")
def _(t):
    good, bad = R.filter_layout(t.fx_runs)
    both = good.withColumn("rejected", F.lit(False)).unionByName(bad.withColumn("rejected", F.lit(True)))
    return both.groupBy("LibraryLayout", "rejected").agg(F.count("*").alias("n"))


@C.query("with_overrides", "SELECT sample_id, project_id, organism FROM fx_samples UNION ALL SELECT 'Test', 'Test', organism FROM fx_samples WHERE sample_idx = (SELECT min(sample_idx) FROM fx_samples)")
def _(t):
    return R.with_overrides(t.fx_samples, ["sample_idx"], sample_id="Test", project_id="Test").select("sample_id", "project_id", "organism")


@C.query("manifest_from_listing", "SELECT 'P' || CAST(o_custkey AS VARCHAR) AS sample, count(*) AS n_files, CAST(sum(floor(o_totalprice * 100)) AS BIGINT) AS bytes, string_agg('/d/x_P' || CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) || '.fq', ',,' ORDER BY '/d/x_P' || CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) || '.fq') AS files FROM orders WHERE floor(o_totalprice * 100) > 10000000 GROUP BY o_custkey")
def _(t):
    path = F.concat(F.lit("/d/x_P"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".fq"))
    return R.manifest_from_listing(t.orders.select(path.alias("path"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("length")))


@C.query("natural_join", "SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def _(t):
    return R.natural_join(t.nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), t.region.select("r_regionkey", "r_name")).drop("r_regionkey")


@C.query("inner_join_renamed", "SELECT Run, sample_id, organism FROM fx_runs JOIN fx_samples ON BioSample = sample_idx")
def _(t):
    return R.inner_join_renamed(t.fx_runs, t.fx_samples, "BioSample", "sample_idx").select("Run", "sample_id", "organism")


@C.query("anti_join_done", "SELECT Run, BioSample FROM fx_runs WHERE NOT already_registered")
def _(t):
    runs = t.fx_runs
    return R.anti_join_done(runs, runs.where("already_registered"), "Run").select("Run", "BioSample")


@C.query("metadata_lookup", "SELECT g.sample_idx, count(*) AS n, any_value(s.sex) AS sex, any_value(s.ecogroup) AS ecogroup FROM fx_genotypes g JOIN fx_samples s ON g.sample_idx = s.sample_idx GROUP BY g.sample_idx")
def _(t):
    calls = t.fx_genotypes.groupBy("sample_idx").agg(F.count("*").alias("n"))
    return R.metadata_lookup(calls, t.fx_samples, "sample_idx", ["sex", "ecogroup"], "sample_id")


@C.query("distinct_pairs", "SELECT DISTINCT BioSample, BioProject FROM fx_runs")
def _(t):
    return R.distinct_pairs(t.fx_runs, "BioSample", "BioProject")


@C.query("sample_coverage", "WITH n AS (SELECT sample_idx, count(*) AS all_reads FROM fx_reads GROUP BY 1) SELECT n.sample_idx, all_reads, round(all_reads * read_length / 2 / (SELECT sum(contig_len) FROM fx_contigs), 12) AS coverage FROM n JOIN fx_samples s ON s.sample_idx = n.sample_idx")
def _(t):
    counts = t.fx_reads.groupBy("sample_idx").agg(F.count("*").alias("all_reads"))
    return R.sample_coverage(counts, t.fx_samples, t.fx_contigs).withColumn("coverage", F.round("coverage", 12))


@C.query("usage_summary", "SELECT event_type, round(avg(value), 6) AS mean_value, max(value) AS max_value, round(avg(user_id), 6) AS mean_user_id, max(user_id) AS max_user_id FROM events GROUP BY event_type")
def _(t):
    out = R.usage_summary(t.events, "event_type", ["value", "user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "mean_user_id")})


@C.query("rank_by_size", "SELECT BioSample, CAST(sum(Bases) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY sum(Bases) DESC, BioSample) AS INTEGER) AS rank FROM fx_runs GROUP BY BioSample")
def _(t):
    return R.rank_by_size(t.fx_runs, "BioSample", "Bases")


@C.query("head_n", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 400")
def _(t):
    return R.head_n(t.orders, "o_orderkey", 400).select("o_orderkey", "o_custkey")


@C.query("set_union_members", "SELECT DISTINCT sample_id FROM fx_samples WHERE ecogroup IN ('BUILDING', 'MACHINERY') OR project_id = 'PRJ2'")
def _(t):
    return R.union_members(t.fx_samples, "sample_id", F.col("ecogroup") == "BUILDING", F.col("ecogroup") == "MACHINERY", F.col("project_id") == "PRJ2")


@C.query("date_stamps", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d') AS shipped, CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 60) AS BIGINT) AS minutes FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    both = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.stamp("l_shipdate").alias("shipped"), values.minutes_between("o_orderdate", "l_shipdate").alias("minutes"))


@C.query("absent_values", "SELECT l_suppkey, count(*) FILTER (d IS NULL OR isnan(d)) AS n_absent, count(*) AS n FROM (SELECT l_suppkey, CASE WHEN l_discount < 0.02 THEN NULL WHEN l_tax < 0.02 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS d FROM lineitem) GROUP BY l_suppkey")
def _(t):
    d = F.when(F.col("l_discount") < 0.02, F.lit(None).cast("double")).when(F.col("l_tax") < 0.02, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return t.lineitem.withColumn("d", d).groupBy("l_suppkey").agg(F.count_if(values.absent("d")).alias("n_absent"), F.count("*").alias("n"))
