"""Intervals, genes, windows and genome-to-genome alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.functions.sizes import MOST_ROWS, fits, small


#: Bits by which the cells of one level are wider than those of the level below, and levels: places up to 2**36.
STEP, LEVELS = 4, 9
#: Tasks of a join at most.
MOST_TASKS = 10_000


def cells_of(low: Column, high: Column) -> Column:
    """Array of (level, cell): the fewest aligned cells of 16**level places that make up [low, high); at most 30 per level."""
    up = 1 << STEP
    low, high = low.cast("long"), high.cast("long")

    def level(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k * STEP)
        a, b = F.ceil(low / width), F.floor(high / width)
        up_a, up_b = F.ceil(low / (width * up)) * up, F.floor(high / (width * up)) * up  # what wider cells take is left out
        taken = (up_a < up_b) & (k < LEVELS - 1)
        spans = F.array(F.struct(a.alias("a"), F.when(taken, up_a).otherwise(b).alias("b")), F.struct(F.when(taken, up_b).otherwise(b).alias("a"), b.alias("b")))
        return F.transform(F.filter(spans, lambda s: s["a"] < s["b"]), lambda s: F.struct(k.alias("level"), s["a"].alias("a"), s["b"].alias("b")))

    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: level(k)))
    cells = F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["a"], s["b"] - 1), lambda c: F.struct(s["level"].alias("level"), c.alias("cell")))))
    return F.when(low < high, cells)


def interval_label(points: DataFrame, intervals: DataFrame, default: str = "Normal", left: str = "out_start", right: str = "out_stop") -> DataFrame:
    """points (contig_ord, pos) with the label of the last interval (by interval_ord) that holds them strictly; else ``default``.

    An interval is cut into aligned cells of widths 1, 16, 256 ... of which it is made up; a cell keeps the last of its intervals only. A
    place looks up the one cell of each width that holds it, so neither many intervals on a contig nor long or nested ones
    gather in a row. Positions are whole and not negative; a null one has the default.
    """
    iv = intervals.select("contig_ord", "interval_ord", "interval_name", F.explode(cells_of(F.greatest(F.col(left) + 1, F.lit(0)), F.col(right))).alias("c"))
    cells = iv.groupBy("contig_ord", "c.level", "c.cell").agg(F.max(F.struct("interval_ord", "interval_name")).alias("v"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("pos") / F.pow(F.lit(1 << STEP), k)).alias("cell"))))
    places = points.select("contig_ord", "pos").distinct().select("contig_ord", "pos", at.alias("c")).select("contig_ord", "pos", "c.*")
    last = places.join(cells, ["contig_ord", "level", "cell"]).groupBy("contig_ord", "pos").agg(F.max("v").alias("_v"))
    return points.join(last, ["contig_ord", "pos"], "left").withColumn("label", F.coalesce("_v.interval_name", F.lit(default))).drop("_v").select(*points.columns, "label")


def interval_contains(genes: DataFrame, intervals: DataFrame) -> DataFrame:
    """(gene columns, interval_name): genes strictly inside intervals, by bins of a million bases."""
    width = 1_000_000
    iv = intervals.select(F.col("contig_ord").alias("_c"), "interval_name", F.col("out_start").alias("_a"), F.col("out_stop").alias("_b"))
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    g = genes.withColumn("_bin", F.floor(F.col("start_pos") / width))
    hit = g.join(iv, (F.col("contig_ord") == F.col("_c")) & (g["_bin"] == iv["_bin"])).where("start_pos > _a and stop_pos < _b")
    return hit.select(*genes.columns, "interval_name")


def region_subset(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(point columns, interval_name): points inside the inner boundaries, inclusive, once per interval."""
    width = 1_000_000
    low, high = F.least("in_start", "in_stop"), F.greatest("in_start", "in_stop")
    iv = intervals.select(F.col("contig_ord").alias("_c"), "interval_name", low.alias("_a"), high.alias("_b"))
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    p = points.withColumn("_bin", F.floor(F.col("pos") / width))
    hit = p.join(iv, (F.col("contig_ord") == F.col("_c")) & (p["_bin"] == iv["_bin"])).where("pos >= _a and pos <= _b")
    return hit.select(*points.columns, "interval_name")


def cut_regions(genome: DataFrame, regions: DataFrame, by: str = "contig_ord", width: int = 10_000) -> DataFrame:
    """regions (``by``, start, stop; 0-based, half open) with seq: their bases, as many as the genome has.

    genome: ``by``, seq and, where a contig comes in parts, start. It is cut into pieces of ``width`` bases that
    meet the regions by bins, so no row carries a contig; the pieces of a region are put together again.
    """
    at = F.col("start") if "start" in genome.columns else F.lit(0)
    cut = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))  # one pass, however long the text
    g = genome.select(by, at.cast("long").alias("_at"), F.posexplode(cut).alias("_k", "_s")).withColumn("_at", F.col("_at") + F.col("_k") * width)
    g = g.withColumn("_end", F.col("_at") + F.length("_s"))
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width)))
    g = g.withColumn("_bin", spread(F.col("_at"), F.col("_end")))
    want = regions.select(by, "start", "stop").distinct().withColumn("_bin", spread(F.col("start"), F.col("stop")))
    first = F.floor(F.greatest("_at", "start") / width)  # a pair that shares several bins meets in the first
    hit = want.join(g, [by, "_bin"]).where((F.col("_bin") == first) & (F.col("start") < F.col("_end")) & (F.col("stop") > F.col("_at")))
    low = F.greatest("_at", "start")
    text = F.substring("_s", (low - F.col("_at") + 1).cast("int"), (F.least("_end", "stop") - low).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("_at", text.alias("t"))))
    seqs = hit.groupBy(by, "start", "stop").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("seq"))
    return regions.join(seqs, [by, "start", "stop"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def fixed_bin(column: str, width: int = 500_000) -> Column:
    return F.floor(F.col(column) / width) * width


def running_bin(sites: DataFrame, size: int = 20) -> DataFrame:
    """sites with bin: every ``size`` sites along the genome, counted across contigs."""
    from popweave.operators.popgen import numbered

    return numbered(sites).withColumn("bin", F.floor((F.col("rn") - 1) / size))


def sliding_het(g: DataFrame, sites: DataFrame, contigs: DataFrame, width: int = 200_000, step: int = 20_000) -> DataFrame:
    """(contig_ord, win_start, sample_idx, n_sites, het): windows [s, s + width] with s + width below the contig's length."""
    s = sites.select("site_id", "contig_ord", "pos").join(small(contigs.select("contig_ord", "contig_len")), "contig_ord")
    low = F.greatest(F.ceil((F.col("pos") - width) / step), F.lit(0))
    high = F.least(F.floor(F.col("pos") / step), F.ceil((F.col("contig_len") - width) / step) - 1)
    s = s.withColumns({"_l": low, "_h": high}).where("_l <= _h").select("site_id", "contig_ord", F.explode(F.sequence(F.col("_l") * step, F.col("_h") * step, F.lit(step))).alias("win_start"))
    ok = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    x = g.join(s, "site_id").groupBy("contig_ord", "win_start", "sample_idx")
    return x.agg(F.count_if(ok).alias("n_sites"), F.try_divide(F.count_if(ok & (F.col("a1") != F.col("a2"))), F.count_if(ok)).alias("het"))


def pivot_individuals(df: DataFrame, key: list[str], samples: list[int], value: str) -> DataFrame:
    out = df.groupBy(*key).pivot("sample_idx", samples).agg(F.max(value))
    return out.select(*key, *[F.col(str(s)).alias(f"s{s}") for s in samples])


def strand_swap(paf: DataFrame) -> DataFrame:
    """paf with new_start, new_stop (exchanged on the minus strand) and percent_match."""
    minus = F.col("strand") == "-"
    return paf.withColumns({"new_start": F.when(minus, F.col("q_stop")).otherwise(F.col("q_start")), "new_stop": F.when(minus, F.col("q_start")).otherwise(F.col("q_stop")), "percent_match": F.try_divide("residues_match", "aln_len")})


def filter_paf(paf: DataFrame, least_match: float = 0.3, least_len: int = 10_000) -> DataFrame:
    return paf.where((F.col("percent_match") > least_match) & (F.col("aln_type") == "tp:A:P") & (F.col("aln_len") > least_len))


def sum_by_pair(paf: DataFrame) -> DataFrame:
    return paf.groupBy("r_ord", "q_ord").agg(F.sum("aln_len").alias("total_len"))


def keep_major_pairs(paf: DataFrame, least: int) -> DataFrame:
    """Alignments of contig pairs whose summed length passes ``least``."""
    return paf.join(sum_by_pair(paf).where(F.col("total_len") > least).select("r_ord", "q_ord"), ["r_ord", "q_ord"], "left_semi")


def melt_endpoints(paf: DataFrame, key: list[str]) -> DataFrame:
    """Two rows per alignment: R_Start and R_Stop with the other genome's place beside it."""
    ends = F.array(F.struct(F.lit("R_Start").alias("aln_loc"), F.col("r_start").alias("position"), F.col("new_start").alias("position2")), F.struct(F.lit("R_Stop").alias("aln_loc"), F.col("r_stop").alias("position"), F.col("new_stop").alias("position2")))
    return paf.select(*key, F.explode(ends).alias("e")).select(*key, "e.*")


def paf_summary(paf: DataFrame, key: list[str], least_match: float = 0.3, least_len: int = 10_000, least_pair: int = 2_000_000) -> DataFrame:
    """Swap, filter, keep major contig pairs, melt."""
    return melt_endpoints(keep_major_pairs(filter_paf(strand_swap(paf), least_match, least_len), least_pair), key)


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int = 3) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def category_counts(genes: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, category, n): non-null gene ids per non-null category of each dimension, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("category")) for d in dimensions]))
    return genes.select("gene_id", each.alias("x")).where("x.category is not null").groupBy("x.dimension", "x.category").agg(F.count("gene_id").alias("n"))


def category_by_interval(genes: DataFrame, intervals: DataFrame, dimension: str, names: list[str]) -> DataFrame:
    """A row per category, a column for all genes and for each interval; 0 where there are none."""
    g = genes.where(F.col(dimension).isNotNull())
    cells = g.select(F.col(dimension).alias("category"), F.lit("All").alias("_i")).unionByName(interval_contains(g, intervals).select(F.col(dimension).alias("category"), F.col("interval_name").alias("_i")))
    return cells.groupBy("category").pivot("_i", ["All", *names]).count().na.fill(0)


def first_per_group(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """The first non-null of each column by ``order``."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def left_join_genes(genes: DataFrame, orthologs: DataFrame, most: int = 8000) -> DataFrame:
    """genes with the orthologs of their name, or nulls. A pair of equal names is a row, so the result grows with the square of a name's genes.

    The genes of a name are dealt to parts, its orthologs to blocks (identical ones apart), of about ``most`` rows each. A part and a block
    meet by sorting, so a task holds one block at a time: neither its memory nor the work of such a pair depends on how many rows share
    one name, and what is sent beyond the tables is two rows per ``most`` of the result. Names are counted at planning, which sets the number of tasks.
    """
    n = genes.where(F.col("gene_name").isNotNull()).groupBy("gene_name").agg(F.count("*").alias("_n"))
    m = orthologs.groupBy(F.col("ortholog_name").alias("_name")).agg(F.count("*").alias("_m"))
    sizes = n.join(m, F.col("gene_name") == F.col("_name"), "left").select(F.col("gene_name").alias("_name"), "_n", F.coalesce("_m", F.lit(0)).alias("_m"))
    large = F.greatest("_n", "_m") > most
    names, rows = sizes.agg(F.count_if(large), F.sum(F.col("_n").cast("double") * F.col("_m"))).first()
    tasks = max(int(genes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int((rows or 0) / most**2), MOST_TASKS))
    cuts = sizes.where(large).select("_name", F.ceil(F.col("_n") / most).alias("_parts"), F.greatest(F.ceil(F.col("_m") / most), F.lit(1)).alias("_blocks"), (F.col("_m") > 0).alias("_shared"))
    cuts = F.broadcast(cuts) if names <= MOST_ROWS else cuts
    parts, blocks, each = F.coalesce("_parts", F.lit(1)), F.coalesce("_blocks", F.lit(1)), lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))

    row = F.xxhash64(*genes.columns)
    dealt = genes.join(cuts, F.col("gene_name") == F.col("_name"), "left").withColumn("_part", F.when(F.col("gene_name").isNull(), row).otherwise(F.pmod(row, parts)))
    dealt = dealt.withColumn("_block", each(blocks)).drop("_name").repartition(tasks, "_part", "_block", "gene_name")
    met = orthologs.where(F.col("ortholog_name").isNotNull()).withColumn("_row", F.xxhash64(*orthologs.columns))
    met = met.withColumn("_copy", F.row_number().over(W.partitionBy("ortholog_name", "_row").orderBy("_row"))).join(cuts, F.col("ortholog_name") == F.col("_name"), "left")
    met = met.withColumn("_in", F.pmod(F.xxhash64("_row", "_copy"), blocks)).withColumn("_of", each(parts))
    met = met.select(F.col("ortholog_name").alias("_name"), "_of", "_in", F.struct(*orthologs.columns).alias("_met")).repartition(tasks, "_of", "_in", "_name")
    both = dealt.join(met.hint("merge"), (F.col("_part") == F.col("_of")) & (F.col("_block") == F.col("_in")) & (F.col("gene_name") == F.col("_name")), "left")
    both = both.where(~F.coalesce("_shared", F.lit(False)) | F.col("_of").isNotNull())  # a block may be empty
    return both.select(*genes.columns, *[F.col("_met")[c].alias(c) for c in orthologs.columns])


def agg_mixed(df: DataFrame, key: list[str], sums: list[str], first: str, order: str, mean: str) -> DataFrame:
    return df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], F.min_by(first, order).alias(first), F.avg(mean).alias(mean))


def join_back_group(df: DataFrame, key: list[str], value: str, within: float = 0.1) -> DataFrame:
    """Rows whose value is within ``within`` of their group's mean."""
    return df.withColumn("group_mean", F.avg(value).over(W.partitionBy(*key))).where(F.abs(F.col(value) - F.col("group_mean")) < within)
