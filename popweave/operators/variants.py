"""Variant sites and genotypes in long form (site_id, sample_idx, a1, a2, gq, ad_ref, ad_alt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.functions.ordering import numbered, roots
from popweave.functions.scratch import stored

from popweave.functions.sizes import small

IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}  # fixed values: two-base codes


def membership(groups: dict[str, Column], samples: DataFrame) -> DataFrame:
    """(pop, sample_idx) from named predicates over the samples; populations may overlap."""
    pops = F.array_compact(F.array(*[F.when(c, n) for n, c in groups.items()]))
    return samples.select(F.explode(pops).alias("pop"), "sample_idx")


def called(g: DataFrame) -> DataFrame:
    return g.where("a1 is not null and a2 is not null")


def allele_counts(g: DataFrame, pops: DataFrame) -> DataFrame:
    """(site_id, pop, ref, alt, n): reference and alternative alleles, missing ones left out."""
    alt = F.sum(F.col("a1") + F.col("a2"))
    return called(g).join(small(pops), "sample_idx").groupBy("site_id", "pop").agg((2 * F.count("*") - alt).alias("ref"), alt.alias("alt"), (2 * F.count("*")).alias("n"))


def allele_frequency(g: DataFrame, pops: DataFrame, min_gq: int = 10) -> DataFrame:
    """(site_id, pop, obs_ct, alt_freq): genotypes under ``min_gq`` count as missing."""
    ok = (F.col("gq") >= min_gq) & F.col("a1").isNotNull() & F.col("a2").isNotNull()
    n = F.count_if(ok) * 2
    return g.join(small(pops), "sample_idx").groupBy("site_id", "pop").agg(n.alias("obs_ct"), F.try_divide(F.sum(F.when(ok, F.col("a1") + F.col("a2"))), n).alias("alt_freq"))


def depth_genotype(ref: str = "ad_ref", alt: str = "ad_alt") -> tuple[Column, Column]:
    """(alternative alleles, alleles) from read depths: none, two alternative, two reference, or one of each."""
    r, a = F.col(ref), F.col(alt)
    none = (r == 0) & (a == 0)
    return F.when(none, 0).when(r == 0, 2).when(a == 0, 0).otherwise(1), F.when(none, 0).otherwise(2)


def ad_allele_counts(g: DataFrame, pops: DataFrame) -> DataFrame:
    alt, total = depth_genotype()
    return g.join(small(pops), "sample_idx").groupBy("site_id", "pop").agg(F.sum(alt).alias("alt"), F.sum(total).alias("total"))


def heterozygosity(g: DataFrame, key: list[str]) -> DataFrame:
    """key, n (called genotypes), het (share of heterozygotes; null without calls)."""
    ok = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    return g.groupBy(*key).agg(F.count_if(ok).alias("n"), F.try_divide(F.count_if(ok & (F.col("a1") != F.col("a2"))), F.count_if(ok)).alias("het"))


def af_by_reads(g: DataFrame) -> DataFrame:
    """Share of reads with the first allele per site."""
    return g.groupBy("site_id").agg(F.try_divide(F.sum("ad_ref"), F.sum(F.col("ad_ref") + F.col("ad_alt"))).alias("af"))


def filter_biallelic_snps(sites: DataFrame, g: DataFrame, samples: DataFrame, least: int | None = 1) -> DataFrame:
    """Two-allele single-base sites whose minor allele occurs at least ``least`` times in the sample subset."""
    snps = sites.where("n_alt_alleles = 1 and length(ref) = 1 and length(alt) = 1")
    if least is None:
        return snps
    sub = called(g).join(small(samples.select("sample_idx").distinct()), "sample_idx")
    n = sub.groupBy("site_id").agg(F.sum(F.col("a1") + F.col("a2")).alias("ac"), (2 * F.count("*")).alias("an"))
    return snps.join(n.where(F.least("ac", F.col("an") - F.col("ac")) >= least).select("site_id"), "site_id", "left_semi")


def filter_snp_quality(sites: DataFrame, contigs: DataFrame, least: float = 300) -> DataFrame:
    ok = sites.where((F.col("n_alt_alleles") == 1) & (F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("qual") >= least))
    return ok.join(small(contigs.select("contig_ord")), "contig_ord", "left_semi")


def informative_sites(g: DataFrame, trio: list[int]) -> DataFrame:
    """Sites at which three named samples are called, homozygous, and not all equal."""
    one = lambda s, a: F.max(F.when(F.col("sample_idx") == s, F.col(a)))
    p = g.where(F.col("sample_idx").isin(trio)).groupBy("site_id").agg(*[one(s, a).alias(f"{a}_{i}") for i, s in enumerate(trio) for a in ("a1", "a2")])
    homozygous = [F.col(f"a1_{i}") == F.col(f"a2_{i}") for i in range(3)]
    differ = (F.col("a1_0") != F.col("a1_1")) | (F.col("a1_0") != F.col("a1_2"))
    return p.where(homozygous[0] & homozygous[1] & homozygous[2] & differ).select("site_id", *[F.col(f"a1_{i}").alias(f"g{i}") for i in range(3)])


def fixed_differences(counts: DataFrame, least: dict[str, int], reference: str) -> DataFrame:
    """(site_id, pop) whose frequency differs by 1 from the reference population's, all totals high enough."""
    total = lambda p, c: F.max(F.when(F.col("pop") == p, F.col(c)))
    w = counts.groupBy("site_id").agg(*[total(p, c).alias(f"{c}_{p}") for p in least for c in ("alt", "total")])
    for p, n in least.items():
        w = w.where(F.col(f"total_{p}") >= n)
    af = lambda p: F.try_divide(f"alt_{p}", f"total_{p}")
    others = [F.when(F.abs(af(p) - af(reference)) == 1, p) for p in least if p != reference]
    return w.select("site_id", F.explode(F.array_compact(F.array(*others))).alias("pop"))


def polarize_by_parent(g: DataFrame, parent: DataFrame, total: int = 4) -> DataFrame:
    """g with depths in parental order: kept where the parent is all alternative, swapped where all reference, else dropped."""
    p = parent.where((F.col("total") == total) & ((F.col("alt") == 0) | (F.col("alt") == F.col("total")))).select("site_id", (F.col("alt") == 0).alias("_swap"))
    d = g.join(p, "site_id").withColumns({"_r": F.col("ad_ref"), "_a": F.col("ad_alt")})
    return d.withColumns({"ad_ref": F.when(F.col("_swap"), F.col("_a")).otherwise(F.col("_r")), "ad_alt": F.when(F.col("_swap"), F.col("_r")).otherwise(F.col("_a"))}).drop("_swap", "_r", "_a")


def segregation_filter(g: DataFrame, low: float = 0.3, high: float = 0.7, depth: int = 100, calls: int = 30) -> DataFrame:
    """Sites (site_id, af, depth, n_called) with intermediate frequency, enough depth and calls."""
    s = g.groupBy("site_id").agg(F.try_divide(F.sum("ad_ref"), F.sum(F.col("ad_ref") + F.col("ad_alt"))).alias("af"), F.sum(F.col("ad_ref") + F.col("ad_alt")).alias("depth"), F.count_if(F.col("ad_ref") + F.col("ad_alt") > 0).alias("n_called"))
    return s.where(F.col("af").between(low, high) & (F.col("depth") >= depth) & (F.col("n_called") >= calls))


def ancestry_call(first: Column, total: Column) -> Column:
    share = F.try_divide(first, total)
    return F.when(share <= 0.2, "MC").when(share >= 0.8, "TI").when(share.isNotNull(), "Het")


def ancestry_call_three(first: Column, total: Column) -> Column:
    share = F.try_divide(first, total)
    return F.when(share > 0.85, "CV").when(share > 0.15, "Het").when(share.isNotNull(), "MC")


def differential_frequency(a: Column, b: Column) -> Column:
    return ((a > 0.95) & (b < 0.2)) | ((b > 0.8) & (a < 0.05))


def wide_frequencies(freq: DataFrame, pops: list[str], value: str = "alt_freq") -> DataFrame:
    """One row per site with a column per population; sites that lack one are dropped."""
    return freq.groupBy("site_id").pivot("pop", pops).agg(F.max(value)).dropna()


def position_semi(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Records at listed (contig_ord, pos)."""
    return df.join(positions.select("contig_ord", "pos"), ["contig_ord", "pos"], "left_semi")


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants of a that b has too."""
    return a.join(b.select("contig_ord", "pos", "ref", "alt"), ["contig_ord", "pos", "ref", "alt"], "left_semi")


def hard_filter_variants(df: DataFrame, exempt: list[str], most_depth: float = 3000) -> DataFrame:
    """Drop by INFO thresholds (map column info); two checks do not hold on the exempt contigs. Absent values pass."""
    v = lambda k: F.try_element_at("info", F.lit(k)).try_cast("double")
    free = F.col("contig").isin(exempt)
    bad = [v("InbreedingCoeff") < -0.6, v("DP") < 1000, (v("DP") > most_depth) & ~free, (v("FS") > 40) & ~free, v("QD") < 2, v("NCC") > 32, F.try_divide(v("MQ0"), v("DP")) > 0.1, v("MQ") < 40]
    for b in bad:
        df = df.where(~F.coalesce(b, F.lit(False)))
    return df


def to_long(wide: DataFrame) -> DataFrame:
    """(site_id, sample_ord, a1, a2) from an array column gt of (a1, a2)."""
    return wide.select("site_id", F.posexplode("gt").alias("sample_ord", "g")).select("site_id", "sample_ord", "g.a1", "g.a2")


def to_wide(g: DataFrame) -> DataFrame:
    """One row per site: gt, the genotypes in sample order."""
    rows = F.array_sort(F.collect_list(F.struct("sample_idx", "a1", "a2")))
    return g.groupBy("site_id").agg(F.transform(rows, lambda r: F.struct(r["a1"].alias("a1"), r["a2"].alias("a2"))).alias("gt"))


def iupac_code(ref: str, alt: str) -> Column:
    """The one-letter code of a genotype over the site's bases; N if missing."""
    letter = lambda a: F.when(F.col(a) == 0, F.col(ref)).otherwise(F.col(alt))
    pair = F.array_join(F.array_sort(F.array(letter("a1"), letter("a2"))), "")
    codes = F.create_map(*[F.lit(x) for kv in {**IUPAC, **{b + b: b for b in "ACGT"}}.items() for x in kv])
    return F.when(F.col("a1").isNull() | F.col("a2").isNull(), "N").otherwise(F.coalesce(F.try_element_at(codes, pair), F.lit("N")))


def iupac_tiles(g: DataFrame, sites: DataFrame, least: int, samples: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """(tile, contig_ord, sample_idx, sequence): codes of the sites with at least ``least`` called samples, in order, ``width`` sites of a contig to a tile.

    Tiles are numbered along the genome; the sites of a tile are a gapless range of numbers, so a gap in a sample's is so many N. With ``samples`` (sample_idx) every
    one of them has every tile, N where it has no genotype, and of a site's repeated genotypes the least code; without, a sample has the sites at which it has one.
    """
    n = called(g).groupBy("site_id").count().where(F.col("count") >= least).select("site_id")
    kept = sites.select("site_id", "contig_ord", "pos", "ref", "alt").join(n, "site_id", "left_semi")
    kept = stored(numbered(kept, ["contig_ord", "pos", "site_id"]), "sites")
    first = kept.groupBy("contig_ord").agg(F.min("rn").alias("_first"))  # a row per contig
    kept = kept.join(F.broadcast(first), "contig_ord").withColumn("_t", F.floor((F.col("rn") - F.col("_first")) / width))
    cells = g.join(kept, "site_id").select("contig_ord", "_t", "sample_idx", "rn", iupac_code("ref", "alt").alias("code"))
    codes = F.array_sort(F.collect_list(F.struct("rn", "code")))  # at most ``width``
    if samples is None:
        rows = cells.groupBy("contig_ord", "_t", "sample_idx").agg(F.array_join(F.transform(codes, lambda r: r["code"]), "").alias("sequence"))
    else:
        ends = kept.groupBy("contig_ord", "_t").agg(F.min("rn").alias("_low"), F.max("rn").alias("_high"))
        have = cells.groupBy("contig_ord", "_t", "sample_idx").agg(codes.alias("_codes"))
        panel = samples.select("sample_idx").distinct()
        grid = ends.join(panel)  # a row per tile and sample: the result's rows
        rows = grid.join(have, ["contig_ord", "_t", "sample_idx"], "left")
        until = lambda rn, after: F.repeat(F.lit("N"), (rn - F.coalesce(after, F.col("_low") - 1) - 1).cast("int"))
        at = lambda i: F.when(i >= 0, F.get("_codes", i)["rn"])
        code = lambda x, i: F.when(at(i - 1).eqNullSafe(x["rn"]), "").otherwise(F.concat(until(x["rn"], at(i - 1)), x["code"]))
        filled = F.coalesce(F.array_join(F.transform("_codes", code), ""), F.lit(""))
        rows = rows.select("contig_ord", "_t", "sample_idx", F.concat(filled, until(F.col("_high") + 1, at(F.size("_codes") - 1))).alias("sequence"))
    tiles = stored(numbered(kept.select("contig_ord", "_t").distinct(), ["contig_ord", "_t"], "tile"), "tiles")
    return rows.join(tiles, ["contig_ord", "_t"]).select("tile", "contig_ord", "sample_idx", "sequence")


def iupac_matrix(g: DataFrame, sites: DataFrame, least: int, samples: DataFrame | None = None) -> DataFrame:
    """(sample_idx, contig_ord, sequence): the tiles of ``iupac_tiles`` joined, for genomes whose contigs fit a row each."""
    parts = F.array_sort(F.collect_list(F.struct("tile", "sequence")))
    tiles = iupac_tiles(g, sites, least, samples)
    return tiles.groupBy("sample_idx", "contig_ord").agg(F.array_join(F.transform(parts, lambda p: p["sequence"]), "").alias("sequence"))


def phase_progeny(g: DataFrame, mother: int, father: int) -> DataFrame:
    """(site_id, sample_idx, status, maternal, paternal) of the progeny at sites with both parents called.

    phased if one assignment of the two alleles to the parents is possible, or both alleles are equal; unphased if
    both are; mendel_error if none is.
    """
    c = called(g)
    parent = lambda s, n: c.where(F.col("sample_idx") == s).select("site_id", F.array("a1", "a2").alias(n))
    kids = c.where(~F.col("sample_idx").isin(mother, father)).join(parent(mother, "m"), "site_id").join(parent(father, "f"), "site_id")
    has = lambda p, a: F.array_contains(p, F.col(a))
    one, two = has("m", "a1") & has("f", "a2"), has("m", "a2") & has("f", "a1")
    status = F.when(~one & ~two, "mendel_error").when(one & two & (F.col("a1") != F.col("a2")), "unphased").otherwise("phased")
    kids = kids.withColumn("status", status)
    pick = lambda x, y: F.when(F.col("status") == "phased", F.when(one, F.col(x)).otherwise(F.col(y)))
    return kids.select("site_id", "sample_idx", "status", pick("a1", "a2").alias("maternal"), pick("a2", "a1").alias("paternal"))


def parent_links(phased: DataFrame, g: DataFrame, sites: DataFrame, parent: int, side: str, window: int = 25, sizes: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rn, site_id, contig_ord) of the parent's heterozygous sites, numbered, and each one's votes on the ``window`` such sites of its contig before it.

    Votes: (rn, prev, net_<s> for every s of ``sizes``): progeny that took the same side at both sites less those that did
    not, among the first s progeny by sample_idx that inherit from both (all, as ``net``, without sizes). A banded self-join: sites meet
    those of their own and the preceding block of ``window`` numbers.
    """
    het = called(g).where((F.col("sample_idx") == parent) & (F.col("a1") != F.col("a2"))).select("site_id").distinct()
    s = stored(numbered(sites.select("site_id", "contig_ord", "pos").join(het, "site_id", "left_semi"), ["contig_ord", "pos", "site_id"]), "het_sites")
    took = phased.where(F.col(side).isNotNull()).select("site_id", "sample_idx", F.col(side).alias("a"))
    if sizes:
        kids = phased.select("sample_idx").distinct()
        took = took.join(stored(numbered(kids, ["sample_idx"], "place"), "progeny"), "sample_idx")
    here = stored(s.join(took, "site_id").select("rn", "contig_ord", "sample_idx", "a", *["place"] * bool(sizes)), "sides")
    block = F.floor(F.col("rn") / window)
    back = here.select(F.col("rn").alias("prev"), "contig_ord", "sample_idx", F.col("a").alias("b"), F.explode(F.array(block, block + 1)).alias("_block"))
    pairs = here.withColumn("_block", block).join(back, ["contig_ord", "sample_idx", "_block"]).where((F.col("prev") < F.col("rn")) & (F.col("prev") >= F.col("rn") - window))
    vote = F.when(F.col("a") == F.col("b"), 1).otherwise(-1)
    sums = [F.sum(F.when(F.col("place") <= n, vote).otherwise(0)).alias(f"net_{n}") for n in sizes] if sizes else [F.sum(vote).alias("net")]
    return s, pairs.groupBy("rn", "prev").agg(*sums)


def best_link(net: str) -> Column:
    """The link of most agreement either way, of equal ones the nearest; null where all votes cancel out."""
    n = F.col(net)
    return F.max(F.when(n != 0, F.struct(F.abs(n).alias("weight"), F.col("prev"), F.signum(n).cast("int").alias("sign"))))


def phase_parents(phased: DataFrame, g: DataFrame, sites: DataFrame, parent: int, side: str, window: int = 25) -> DataFrame:
    """(site_id, block, left, right): a parent's alleles in phase along each contig.

    Every heterozygous site is voted on against the ``window`` such sites before it by the progeny that inherit from both,
    and takes its order from the one on which the vote is clearest (of equal ones the nearest): the same order if
    most took the same side of each, else the other. So a site with few calls or with errors is stepped over. Orders are carried along
    these links by pointer doubling. A site on which no vote is decided begins a new block, numbered per
    contig from 1; sides compare within a block only, and blocks may interleave.
    """
    s, votes = parent_links(phased, g, sites, parent, side, window)
    links = votes.groupBy("rn").agg(best_link("net").alias("l")).where("l is not null").select(F.col("rn").alias("id"), F.col("l.prev").alias("parent"), F.col("l.sign").alias("sign"))
    led = roots(links)
    s = s.join(led, s["rn"] == led["id"], "left").withColumns({"root": F.coalesce("root", "rn"), "sign": F.coalesce("sign", F.lit(1))})
    starts = stored(numbered(s.where("root = rn").select("root", "contig_ord"), ["root"], "block"), "blocks")
    first = starts.groupBy("contig_ord").agg((F.min("block") - 1).alias("_before"))  # a row per contig
    starts = starts.join(F.broadcast(first), "contig_ord").select("root", (F.col("block") - F.col("_before")).alias("block"))
    left = (F.col("sign") < 0).cast("int")
    return s.join(starts, "root").select("site_id", "block", left.alias("left"), (1 - left).alias("right"))


def phase_subsets(phased: DataFrame, g: DataFrame, sites: DataFrame, parent: int, side: str, sizes: list[int], window: int = 25) -> DataFrame:
    """(size, n_phased): how many of a parent's sites are in a block of two or more if only the first ``size`` progeny are looked at; one pass for all sizes."""
    _, votes = parent_links(phased, g, sites, parent, side, window, sizes)
    best = votes.groupBy("rn").agg(*[best_link(f"net_{n}").alias(f"l{n}") for n in sizes])
    ends = F.explode(F.flatten(F.array(*[F.when(F.col(f"l{n}").isNotNull(), F.array(*[F.struct(F.lit(n).alias("size"), c.alias("rn")) for c in (F.col("rn"), F.col(f"l{n}.prev"))])).otherwise(F.array().cast("array<struct<size:int,rn:bigint>>")) for n in sizes])))
    found = best.select(ends.alias("e")).select("e.*").distinct().groupBy("size").agg(F.count("*").alias("n_phased"))
    every = g.sparkSession.createDataFrame([(n,) for n in sizes], "size int")
    return every.join(found, "size", "left").select("size", F.coalesce("n_phased", F.lit(0).cast("long")).alias("n_phased"))
