"""Writers: tables, BED, VCF, classified reads, alignment matrices, registries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.functions.scratch import stored

SYMBOLIC = 20_000
VCF_INFO = ("NS", "END", "SVTYPE", "SVLEN")


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("errorifexists").option("header", header).csv(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """One folder per category."""
    df.write.mode("errorifexists").partitionBy(key).parquet(path)


def write_bed(df: DataFrame, path: str) -> None:
    """contig, pos - 1, pos of 1-based positions."""
    bed_rows(df).write.mode("errorifexists").option("sep", "\t").csv(path)


def bed_rows(df: DataFrame) -> DataFrame:
    return df.select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("stop"))


def vcf_header(contigs: list[tuple[str, int]], samples: list[str], date: str) -> str:
    lines = ["##fileformat=VCFv4.2", f"##fileDate={date}", *[f"##contig=<ID={c},length={n}>" for c, n in contigs]]
    lines += ['##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples with data">', '##INFO=<ID=END,Number=1,Type=Integer,Description="End position">', '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type">', '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length">']
    lines += [f'##FORMAT=<ID={k},Number=1,Type={t},Description="{d}">' for k, t, d in (("GT", "String", "Genotype"), ("RR", "Integer", "Reference reads"), ("AR", "Integer", "Alternative reads"), ("BR", "Integer", "Ambiguous reads"))]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])])


def vcf_records(events: DataFrame, calls: DataFrame, samples: list[str]) -> DataFrame:
    """(contig, pos, value): lines of events (event, contig, pos, ref, alt, start, stop, svtype) and their calls
    (event, sample, gt, rr, ar, br), sample columns in the order of ``samples``; long events get symbolic alleles."""
    cell = F.concat_ws(":", "gt", F.col("rr").cast("string"), F.col("ar").cast("string"), F.col("br").cast("string"))
    place = F.broadcast(events.sparkSession.createDataFrame([(x, i) for i, x in enumerate(samples)], "sample string, _place int"))  # a row per sample
    per = calls.join(place, "sample").groupBy("event").agg(F.array_sort(F.collect_list(F.struct("_place", cell.alias("c")))).alias("_cells"))  # a cell per sample
    per = per.withColumn("_cells", F.filter("_cells", lambda x, i: (i == 0) | (F.get("_cells", i - 1)["_place"] != x["_place"])))  # of repeated ones the least
    e = events.join(per, "event", "left").withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<_place:int,c:string>>")))
    before = lambda i: F.when(i > 0, F.get("_cells", i - 1)["_place"]).otherwise(-1)
    gap = lambda n: F.repeat(F.lit("\t./.:0:0:0"), n)
    filled = F.array_join(F.transform("_cells", lambda x, i: F.concat(gap(x["_place"] - before(i) - 1), F.lit("\t"), x["c"])), "")
    cells = F.concat(filled, gap(F.lit(len(samples)) - 1 - before(F.size("_cells"))))
    size = F.col("stop") - F.col("start")
    n = F.size(F.filter("_cells", lambda x: ~x["c"].startswith("./.")))
    long_ = size >= SYMBOLIC
    alt = F.when(long_, F.concat(F.lit("<"), F.upper("svtype"), F.lit(">"))).otherwise(F.col("alt"))
    ref = F.when(long_, F.substring("ref", 1, 1)).otherwise(F.col("ref"))
    info = F.concat(F.lit("NS="), n.cast("string"), F.lit(";END="), F.col("stop").cast("string"), F.lit(";SVTYPE="), F.upper("svtype"), F.lit(";SVLEN="), (size + 1).cast("string"))
    fixed = [F.col("contig"), F.col("pos").cast("string"), F.lit("."), ref, alt, F.lit("."), F.lit("PASS"), info, F.lit("GT:RR:AR:BR")]
    return e.select("contig", "pos", F.concat(F.concat_ws("\t", *fixed), cells).alias("value"))


def write_vcf(events: DataFrame, calls: DataFrame, contigs: list[tuple[str, int]], samples: list[str], date: str, path: str) -> None:
    """Sorted parts below ``path``: the header is the first."""
    names = sorted(samples)
    rows = stored(vcf_records(events, calls, names), "records")  # worked out once: ranges and lines read it
    rows.orderBy("contig", "pos", "value").select("value").write.mode("errorifexists").text(f"{path}/records")
    events.sparkSession.createDataFrame([(vcf_header(contigs, names, date),)], "value string").coalesce(1).write.text(f"{path}/header")


def write_read_classes(classified: DataFrame, path: str) -> None:
    """One folder per class; a read may be in several."""
    classified.write.mode("errorifexists").partitionBy("class").parquet(path)


def write_phylip(tiles: DataFrame, path: str) -> None:
    """An interleaved alignment from tiles (tile, sample, sequence): ``path``/header has the counts, ``path``/rows a line per tile and sample, in order.

    Lines of the first tile begin with the sample's name. A line holds a tile's sites only, so none grows with the genome.
    """
    tiles = stored(tiles, "tiles")  # worked out once: counts, the first tile, ranges and lines read it
    sizes = tiles.groupBy("tile").agg(F.max(F.length("sequence")).alias("n"), F.count("*").alias("samples"))
    head = sizes.agg(F.concat_ws(" ", F.coalesce(F.max("samples"), F.lit(0)).cast("string"), F.coalesce(F.sum("n"), F.lit(0)).cast("string")).alias("value"))
    head.write.mode("errorifexists").text(f"{path}/header")
    first = tiles.agg(F.min("tile")).first()[0]
    line = F.when(F.col("tile") == first, F.concat_ws("  ", "sample", "sequence")).otherwise(F.col("sequence")) if first is not None else F.col("sequence")
    tiles.orderBy("tile", "sample").select(line.alias("value")).write.text(f"{path}/rows")


def append_registry(rows: DataFrame, path: str, job: str, key: str) -> None:
    """Adds the rows whose ``key`` no other job has added, as the batch of this ``job``: written first, named in the list of commits last.

    A job that runs again replaces its batch, so its rows come up once; what a job that broke off left behind is in no commit and not
    read. One row per key (that of the least content hash), none for a null key. Jobs of one registry run one after the other.
    """
    spark = rows.sparkSession
    known = read_registry(spark, path)
    if known is not None:
        done = known.where(F.col("job") != job).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    columns = [c for c in rows.columns if c != key]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.xxhash64(*rows.columns).alias("_h"), *columns)).alias("_r"))
    one.select(key, *[F.col("_r")[c].alias(c) for c in columns]).write.mode("overwrite").parquet(f"{path}/batches/job={job}")
    spark.createDataFrame([(job,)], "job string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/name={job}")


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed jobs, with job; None where nothing is committed yet."""
    try:
        commits = [r.job for r in spark.read.parquet(f"{path}/commits").select("job").distinct().collect()]  # a row per job
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return spark.read.option("basePath", f"{path}/batches").parquet(*[f"{path}/batches/job={job}" for job in commits])
