"""Fixture views: tables of the library's data model, computed from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SAMPLES = list(range(125))
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Contigs, their lengths and the intervals are fixed values that results must match. Samples are the groups of
#: customers by nation and segment (at most 125); a sample is typed at the sites (parts) that its customers ordered.
#: Accepted by Spark and DuckDB, but for the mark /*G*/ (see ``in_duckdb``).
SQL = {
    "fx_contigs": r"""
SELECT * FROM (VALUES
(0,'NC_036780.1','LG1',38676823),(1,'NC_036781.1','LG2',32660920),(2,'NC_036782.1','LG3',37314939),(3,'NC_036783.1','LG4',30518969),(4,'NC_036784.1','LG5',36170306),(5,'NC_036785.1','LG6',39774503),(6,'NC_036786.1','LG7',64916660),(7,'NC_036787.1','LG8',23971387),(8,'NC_036788.1','LG9',21023328),(9,'NC_036789.1','LG10',32356376),(10,'NC_036790.1','LG11',32446080),(11,'NC_036791.1','LG12',34086040),(12,'NC_036792.1','LG13',32072427),(13,'NC_036793.1','LG14',37870038),(14,'NC_036794.1','LG15',34548429),(15,'NC_036795.1','LG16',34742138),(16,'NC_036796.1','LG17',35776103),(17,'NC_036797.1','LG18',29505383),(18,'NC_036798.1','LG19',25963618),(19,'NC_036799.1','LG20',29789237),(20,'NC_036800.1','LG22',34725690),(21,'NC_036801.1','LG23',42088218))
t(contig_ord, contig, lg, contig_len)
""",
    "fx_intervals": r"""
SELECT * FROM (VALUES
(1,'LG2',19743639,20311160,43254805,43658853),(8,'LG9',14453796,15649299,32255605,33496468),(9,'LG10',11674905,11855817,29898615,29898615),(10,'LG11a',8302039,8309764,18425216,18425216),(10,'LG11b',18425216,18425216,30371888,30459686),(12,'LG13',2249541,2453698,23046928,23131968),(19,'LG20a',19614379,19689710,29716509,29673642),(19,'LG20b',29716509,29673642,32872827,33764042))
t(contig_ord, interval_name, out_start, in_start, in_stop, out_stop)
""",
    "fx_samples": r"""
SELECT sample_idx, 'S' || lpad(CAST(sample_idx AS STRING), 4, '0') AS sample_id,
 CASE WHEN sample_idx % 2 = 0 THEN 'm' ELSE 'f' END AS sex, ecogroup,
 'Genus species' || CAST(nation AS STRING) AS organism,
 'PRJ' || CAST(nation % 5 AS STRING) AS project_id,
 CASE sample_idx % 4 WHEN 0 THEN 'Inverted' WHEN 2 THEN 'Heterozygous' ELSE 'Normal' END AS karyotype,
 200 + sample_idx % 100 AS read_length
FROM (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS ecogroup,
  c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS sample_idx
 FROM customer) q
""",
    "fx_sites": r"""
SELECT p_partkey AS site_id, p_partkey % 22 AS contig_ord,
 1 + (p_partkey * 15485863) % 32000000 AS pos,
 substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) AS ref,
 CASE WHEN p_partkey % 13 = 0 THEN substr('ACGT', CAST(1 + p_partkey % 4 AS INT), 1) || 'AC'
      ELSE substr('ACGT', CAST(1 + (p_partkey + 1 + p_partkey % 3) % 4 AS INT), 1) END AS alt,
 CASE WHEN p_partkey % 17 = 0 THEN 2 ELSE 1 END AS n_alt_alleles,
 p_retailprice / 4 AS qual
FROM part
""",
    "fx_genotypes": r"""
SELECT site_id, sample_idx,
 CASE WHEN miss THEN NULL WHEN g < t THEN 1 ELSE 0 END AS a1,
 CASE WHEN miss THEN NULL WHEN h < t THEN 1 ELSE 0 END AS a2,
 gq, 
 CASE WHEN miss THEN 0 ELSE (2 - (CASE WHEN g < t THEN 1 ELSE 0 END) - (CASE WHEN h < t THEN 1 ELSE 0 END)) * depth END AS ad_ref,
 CASE WHEN miss THEN 0 ELSE ((CASE WHEN g < t THEN 1 ELSE 0 END) + (CASE WHEN h < t THEN 1 ELSE 0 END)) * depth END AS ad_alt
FROM (SELECT site AS site_id, sample AS sample_idx,
  (site * 131 + sample * 71 + ((site * sample) % 53) * 13) % 100 AS g,
  (site * 57 + sample * 199 + ((site * sample) % 47) * 29) % 100 AS h,
  10 + (site * 37) % 80 + (CASE WHEN sample % 2 = 0 THEN 8 ELSE 0 END) AS t,
  (site + 3 * sample) % 23 = 0 AS miss,
  (site * 7 + sample * 11) % 60 AS gq,
  1 + (evidence + site * 3 + sample * 5) % 6 AS depth
 FROM (SELECT l_partkey AS site, sample, CAST(sum(l_quantity) AS BIGINT) AS evidence
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT c_custkey AS ck, c_nationkey * 5 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS sample FROM customer) c ON ck = o_custkey
  GROUP BY l_partkey, sample) e) q
""",
    "fx_reads": r"""
SELECT qname, sample_idx, contig_ord, pos, mapq, is_reverse, mate_is_reverse, is_unmapped, mate_is_unmapped, is_duplicate, is_secondary,
 ok % 41 <> 0 AS is_paired, ok % 5 <> 0 AS is_proper_pair, pk % 23 = 0 AS has_xm,
 CASE WHEN ok % 5 = 0 THEN (contig_ord + 1) % 22 ELSE contig_ord END AS next_contig_ord,
 pos + (ok % 700) - 200 AS next_pos, (ok % 700) - 200 AS isize, cigar,
 CASE WHEN ln IN (1, 2) AND ok % 3 <> 0 THEN
   CAST(CASE WHEN ok % 11 = 0 THEN (contig_ord + 1) % 22 ELSE contig_ord END AS STRING) || ',' ||
   CAST(pos + 150 + 50 * (pk % 4) AS STRING) || ',' || CASE WHEN is_reverse <> opp THEN '-' ELSE '+' END || ',' ||
   CASE WHEN (ln = 1) <> opp THEN CAST(100 - m2 AS STRING) || 'S' || CAST(m2 AS STRING) || 'M'
        ELSE CAST(m2 AS STRING) || 'M' || CAST(100 - m2 AS STRING) || 'S' END || ',60,0;' END AS sa,
 repeat(substr('ACGT', CAST(1 + pk % 4 AS INT), 1), 60) || repeat(substr('ACGT', CAST(1 + ok % 4 AS INT), 1), 40) AS seq,
 repeat(chr(CAST(33 + ok % 41 AS INT)), 50) || repeat(chr(CAST(33 + pk % 41 AS INT)), 50) AS qual
FROM (SELECT 'o' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS qname,
  l_orderkey AS ok, l_partkey AS pk, l_linenumber AS ln, l_orderkey % 10 AS sample_idx, l_suppkey % 22 AS contig_ord,
  CASE WHEN l_linenumber IN (1, 2) THEN 1000 + (l_partkey % 8) * 3000 ELSE (l_partkey * 7919) % 50000 END AS pos,
  CASE l_linenumber WHEN 1 THEN 65 ELSE 40 END - CASE l_partkey % 8 WHEN 5 THEN 10 WHEN 6 THEN -5 ELSE 0 END AS m2,
  l_orderkey % 7 = 0 AS opp,
  CAST(floor(l_quantity) AS INT) AS mapq, l_returnflag = 'R' AS is_reverse, l_linestatus = 'F' AS mate_is_reverse,
  (l_partkey + l_orderkey) % 29 = 0 AS is_unmapped, (l_partkey + 2 * l_orderkey) % 31 = 0 AS mate_is_unmapped,
  l_orderkey % 19 = 0 AS is_duplicate, (l_orderkey + 3 * l_partkey) % 37 = 0 AS is_secondary,
  CASE l_linenumber WHEN 1 THEN '35M65S' WHEN 2 THEN '40S60M' WHEN 3 THEN '100M' WHEN 4 THEN '4S96M' WHEN 5 THEN '50M2D50M' WHEN 6 THEN '10S80M10S' ELSE '30S70M' END AS cigar
 FROM lineitem) q
""",
    "fx_paf": r"""
SELECT 'GV' || CAST(ok % 3 AS STRING) AS genome_version, contig_ord AS r_ord, q_ord, r_start, r_start + len AS r_stop,
 q_start, q_start + len AS q_stop, strand, CAST(floor(len * (0.2 + disc * 8)) AS BIGINT) AS residues_match, len AS aln_len, mapq, aln_type
FROM (SELECT l_orderkey AS ok, l_suppkey % 22 AS contig_ord, (l_suppkey + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END) % 22 AS q_ord,
  (l_partkey * 7919) % 30000000 AS r_start, (l_partkey * 104729 + l_orderkey) % 30000000 AS q_start,
  CAST(floor(l_extendedprice) AS BIGINT) AS len, l_discount AS disc, CAST(floor(l_quantity) AS INT) AS mapq,
  CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CASE WHEN l_linestatus = 'F' THEN 'tp:A:P' ELSE 'tp:A:S' END AS aln_type
 FROM lineitem) q
""",
    "fx_genes": r"""
SELECT p_partkey AS gene_id, p_partkey % 22 AS contig_ord, (p_partkey * 7368787) % 32000000 AS start_pos,
 (p_partkey * 7368787) % 32000000 + 500 + p_size * 100 AS stop_pos, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
 p_type AS biotype, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS human_relationship, p_name AS gene_name
FROM part
""",
    "fx_runs": r"""
SELECT 'RUN' || CAST(o_orderkey AS STRING) AS Run, o_custkey % 130 AS BioSample, 'PRJ' || CAST(o_custkey % 5 AS STRING) AS BioProject,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'SINGLE' WHEN '5-LOW' THEN 'OTHER' ELSE 'PAIRED' END AS LibraryLayout,
 CAST(floor(o_totalprice * 100000) AS BIGINT) AS Bases, o_orderstatus AS Platform, o_orderdate AS ReleaseDate, o_orderkey % 4 = 0 AS already_registered
FROM orders
""",
    "fx_seqs": r"""
SELECT doc_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', ''/*G*/), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents
""",
}


def in_duckdb(name: str) -> str:
    return SQL[name].replace("/*G*/", ", 'g'")


class Tables:
    """Attribute access to base tables and fixture views below ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in SQL:
            raise AttributeError(name)
        used = {x: getattr(self, x) for x in BASE if re.search(rf"\b(FROM|JOIN) {x}\b", SQL[name])}
        sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", r"\1 {\2}", SQL[name].replace("/*G*/", ""))
        return self.spark.sql(sql, **used) if used else self.spark.sql(sql)


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """All base tables and fixture views as temporary views, so that everything is reachable from SQL."""
    t = Tables(spark, sf_dir)
    for name in (*BASE, *SQL):
        getattr(t, name).createOrReplaceTempView(name)


class Catalog:
    """Queries by name, each with the SQL that checks it where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle:
                self.oracles[name] = with_fixtures(oracle)
            return f

        return add


def with_fixtures(sql: str) -> str:
    """``sql`` led by the fixture views that it names, as common table expressions."""
    sql = sql.strip()
    ctes = [f"{n} AS ({in_duckdb(n)})" for n in SQL if re.search(rf"\b{n}\b", sql)]
    if not ctes:
        return sql
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {own and own[1] or ''}{', '.join(ctes)}{', ' + sql[own.end():] if own else ' ' + sql}"
