"""Population statistics: differentiation, blocks, distances, kinship, histograms, genome coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.functions import ordering
from popweave.functions.scratch import stored
from popweave.functions.sizes import small


def hudson_fst(counts: DataFrame, a: str, b: str) -> DataFrame:
    """(site_id, fst) of two populations from (site_id, pop, ref, alt, n); null where between is 0."""
    one = lambda p, c: F.max(F.when(F.col("pop") == p, F.col(c)))
    w = counts.where(F.col("pop").isin(a, b)).groupBy("site_id").agg(*[one(p, c).alias(f"{c}{i}") for i, p in enumerate((a, b)) for c in ("ref", "alt", "n")])
    inside = [1 - F.try_divide(F.col(f"ref{i}") * (F.col(f"ref{i}") - 1) + F.col(f"alt{i}") * (F.col(f"alt{i}") - 1), F.col(f"n{i}") * (F.col(f"n{i}") - 1)) for i in (0, 1)]
    between = 1 - F.try_divide(F.col("ref0") * F.col("ref1") + F.col("alt0") * F.col("alt1"), F.col("n0") * F.col("n1"))
    return w.select("site_id", F.try_divide(between - (inside[0] + inside[1]) / 2, between).alias("fst"))


def numbered(sites: DataFrame) -> DataFrame:
    """sites with rn: numbers along the genome from 1 on, by ranges of it."""
    return ordering.numbered(sites, ["contig_ord", "pos", "site_id"])


def block_rows(sites: DataFrame, size: int = 100) -> DataFrame:
    """Numbered sites with block (from 0), without the incomplete last one. Blocks run across contigs."""
    n = numbered(sites)
    return n.withColumn("block", F.floor((F.col("rn") - 1) / size)).where(F.col("block") < n.count() // size)


def weir_cockerham(g: DataFrame, pops: DataFrame) -> DataFrame:
    """(site_id, a, b, c): variance components of two populations (Weir and Cockerham 1984)."""
    ok = g.where("a1 is not null and a2 is not null").join(small(pops), "sample_idx")
    s = ok.groupBy("site_id", "pop").agg(F.count("*").cast("double").alias("n"), (F.sum(F.col("a1") + F.col("a2")) / (2.0 * F.count("*"))).alias("p"), (F.count_if(F.col("a1") != F.col("a2")) / F.count("*")).alias("h"))
    t = s.groupBy("site_id").agg(F.count("*").alias("r"), F.sum("n").alias("nt"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("p")).alias("np"), F.sum(F.col("n") * F.col("p") * F.col("p")).alias("npp"), F.sum(F.col("n") * F.col("h")).alias("nh")).where("r = 2")
    t = t.select("site_id", (F.col("nt") / 2).alias("nb"), (F.col("nt") - F.col("n2") / F.col("nt")).alias("nc"), (F.col("np") / F.col("nt")).alias("pb"), (F.col("nh") / F.col("nt")).alias("hb"), "nt", "npp")
    t = t.withColumn("s2", (F.col("npp") - F.col("nt") * F.col("pb") * F.col("pb")) / F.col("nb"))
    nb, pq, s2, hb = F.col("nb"), F.col("pb") * (1 - F.col("pb")), F.col("s2"), F.col("hb")
    a = F.try_divide(nb, "nc") * (s2 - F.try_divide(pq - s2 / 2 - hb / 4, nb - 1))
    b = F.try_divide(nb, nb - 1) * (pq - s2 / 2 - (2 * nb - 1) * hb / (4 * nb))
    return t.select("site_id", a.alias("a"), b.alias("b"), (hb / 2).alias("c"))


def weir_cockerham_blocks(g: DataFrame, pops: DataFrame, sites: DataFrame, size: int = 100) -> DataFrame:
    """(block, contig_ord, pos, fst): per block the summed a over the summed a + b + c, labelled by its first site."""
    x = block_rows(sites, size).join(weir_cockerham(g, pops), "site_id", "left")
    first = F.min(F.struct("rn", "contig_ord", "pos"))
    out = x.groupBy("block").agg(first.alias("f"), F.try_divide(F.sum("a"), F.sum(F.col("a") + F.col("b") + F.col("c"))).alias("fst"))
    return out.select("block", "f.contig_ord", "f.pos", "fst")


#: Samples of a block, and about how many sites are multiplied at once.
BLOCK, SITES_AT_ONCE = 256, 4096
_SUMS = ("n", "d", "both", "opposite", "hi", "hj")


def _products(x: dict[int, np.ndarray], y: dict[int, np.ndarray]) -> np.ndarray:
    """The sums of ``pair_counts`` for all pairs of two blocks' samples over some sites; x and y: a value's (sites x samples) places."""
    pairs = {(v, w): a.T @ b for v, a in x.items() for w, b in y.items()}
    zero = np.zeros_like(next(iter(pairs.values())))
    add = lambda weight: sum((weight(v, w) * m for (v, w), m in pairs.items() if weight(v, w)), zero)
    return np.stack([add(lambda v, w: 1), add(lambda v, w: abs(v - w)), add(lambda v, w: int(v == w == 1)), add(lambda v, w: int(abs(v - w) == 2)), add(lambda v, w: int(v == 1)), add(lambda v, w: int(w == 1))]).astype(np.int64)


def pair_counts(cells: DataFrame, block: int = BLOCK, sites_at_once: int = SITES_AT_ONCE) -> DataFrame:
    """(i, j, n, d, both, opposite, hi, hj) of samples i < j that share a site, from cells (site_id, sample_idx, n).

    n: shared sites; d: summed absolute differences of the cells' n; both: sites at which both are 1; opposite: at which they differ
    by 2; hi, hj: at which i (j) is 1. Samples are numbered and cut into blocks, sites dealt to groups by their hash; a task takes
    pairs of blocks, ``sites_at_once`` sites after sites, and multiplies (sites x samples) matrices of zeros and ones, adding up, so it
    passes on each pair of samples once, however many sites it saw. Cells are read twice: for the samples, then for this. A cell goes to as many tasks as there are blocks. Of
    repeated cells of a site and sample one counts; null n's are left out.
    """
    cells = cells.where("n is not null")
    samples = stored(ordering.numbered(cells.select("sample_idx").distinct(), ["sample_idx"], "_d"), "samples")
    blocks = -(-samples.count() // block)
    groups = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, blocks * (blocks + 1) // 2))
    c = cells.join(samples, "sample_idx").withColumns({"_d": F.col("_d") - 1, "part": F.pmod(F.xxhash64("site_id"), F.lit(groups))})
    own, other = F.floor(F.col("_d") / block), F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))))
    c = c.select("site_id", "sample_idx", "n", "part", "_d", own.alias("_own"), other.alias("_other"))
    c = c.select(F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "part", "site_id", F.col("_d").alias("d"), F.col("sample_idx").cast("long").alias("s"), F.col("n").cast("long").alias("n"))
    c = c.repartition("lo", "hi", "part").sortWithinPartitions("lo", "hi", "site_id").drop("part")

    def tile(cols: dict[str, np.ndarray], lo: int, hi: int, ids: np.ndarray) -> np.ndarray:
        site = np.unique(cols["site_id"], return_inverse=True)[1]
        sides = []
        for k, b in enumerate((lo, hi)):
            mine = cols["d"] // block == b
            d, n, at = cols["d"][mine] % block, cols["n"][mine], site[mine]
            ids[k, d] = cols["s"][mine]
            values = {}
            for v in np.unique(n).tolist() or [0]:
                values[v] = np.zeros((site.max() + 1, block), np.float32)
                values[v][at[n == v], d[n == v]] = 1
            sides.append(values)
        return _products(*sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lo", "hi", "site_id", "d", "s", "n"]
        held: list[dict] = []
        now = pair = sums = ids = before = None
        sites = 0

        def finish() -> None:
            nonlocal sums, held
            if held:
                cols = {c: np.concatenate([h[c] for h in held]) for c in names}
                sums += tile(cols, *pair, ids)
                held = []

        def passed_on() -> pa.RecordBatch:
            i, j = np.nonzero(sums[0] * ((pair[0] < pair[1]) | (np.arange(block)[:, None] < np.arange(block))))
            return pa.RecordBatch.from_arrays([pa.array(ids[0, i]), pa.array(ids[1, j]), *[pa.array(m[i, j]) for m in sums]], names=["i", "j", *_SUMS])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            key = np.stack([cols["lo"], cols["hi"], cols["site_id"]], axis=1)
            new = (np.diff(key, axis=0, prepend=key[:1] - 1 if before is None else before) != 0).any(axis=1)
            before, upto = key[-1:], sites + np.cumsum(new)
            sites = int(upto[-1])
            key = np.column_stack([key[:, :2], upto // sites_at_once])
            cut = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                here = tuple(key[a].tolist())
                if here != now:
                    finish()
                    if pair is not None and here[:2] != pair:
                        yield passed_on()
                    if here[:2] != pair:
                        pair, sums, ids = here[:2], np.zeros((len(_SUMS), block, block), np.int64), np.full((2, block), -1, np.int64)
                    now = here
                held.append({c: v[a:b] for c, v in cols.items()})
        finish()
        if pair is not None:
            yield passed_on()

    out = c.mapInArrow(run, "i long, j long, " + ", ".join(f"{s} long" for s in _SUMS)).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])
    kind = cells.schema["sample_idx"].dataType
    return out.withColumns({"i": F.col("i").cast(kind), "j": F.col("j").cast(kind)})


def pairwise_distance(g: DataFrame, size: float) -> DataFrame:
    """(i, j, distance) for all ordered pairs of different samples: summed absolute differences of alternative-allele counts, missing as 0."""
    cells = g.select("site_id", "sample_idx", (F.coalesce("a1", F.lit(0)) + F.coalesce("a2", F.lit(0))).alias("n"))
    half = pair_counts(cells).select("i", "j", (F.col("d") / size).alias("distance"))
    ways = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    return half.select(F.explode(ways).alias("w"), "distance").select("w.i", "w.j", "distance")


def kinship_king(g: DataFrame) -> DataFrame:
    """(i, j, n, phi, relatedness2) for i < j over sites at which both are called (KING-robust; Manichaikul 2010)."""
    n = pair_counts(g.select("site_id", "sample_idx", (F.col("a1") + F.col("a2")).alias("n")))
    top, m, both = F.col("both") - 2 * F.col("opposite"), F.least("hi", "hj"), F.col("hi") + F.col("hj")
    return n.select("i", "j", "n", (F.try_divide(top, 2 * m) + 0.5 - F.try_divide(both, 4 * m)).alias("phi"), F.try_divide(top, both).alias("relatedness2"))


def kinship_matrix(king: DataFrame, samples: list[int]) -> DataFrame:
    """Square table: a row per i, a column per j, 0.5 on the diagonal."""
    ends = king.select(F.col("i").alias("s")).union(king.select("j")).distinct()
    cells = king.select("i", "j", "phi").unionByName(king.select(F.col("j").alias("i"), F.col("i").alias("j"), "phi")).unionByName(ends.select(F.col("s").alias("i"), F.col("s").alias("j"), F.lit(0.5).alias("phi")))
    out = cells.groupBy("i").pivot("j", samples).agg(F.max("phi"))
    return out.select("i", *[F.col(str(s)).alias(f"s{s}") for s in samples])


def hist_proportion(df: DataFrame, value: str, hue: str, high: float, bins: int = 100, low: float = 0.0) -> DataFrame:
    """(hue, bin, n, proportion): equal bins of [low, high], the upper edge inside the last, normalised per hue."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins) + 1, F.lit(bins))
    n = df.where(F.col(value).between(low, high)).groupBy(F.col(hue), b.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy(hue)))


def hist_density(df: DataFrame, value: str, hue: str, width: float = 0.1) -> DataFrame:
    """(hue, bin, n, density): bins of ``width`` from 0 on (bin k: k * width to (k + 1) * width), shares per hue divided by the width; nulls are left out."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(hue), F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(hue)) * width))


def _smooth(places: DataFrame, key: list[str], value: str, width: int) -> DataFrame:
    """places (``key``, _at, value) with the mean over _at - width/2 ... _at + width/2 - 1: blocks of 100 * width places, each with those around it."""
    half, size = width // 2, 100 * width
    d = places.withColumn("_block", F.explode(F.array_distinct(F.array(*[F.floor((F.col("_at") + k) / size) for k in (-half, 0, half)]))))
    w = W.partitionBy(*key, "_block").orderBy("_at").rowsBetween(-half, half - 1)
    return d.withColumn("smooth", F.avg(value).over(w)).where(F.floor(F.col("_at") / size) == F.col("_block")).drop("_block")


def moving_average(df: DataFrame, value: str, width: int = 100) -> DataFrame:
    """df (contig_ord, rn) with the mean of rows rn - width/2 ... rn + width/2 - 1, per contig, cut at its ends. Numbers have no gaps."""
    return _smooth(df.withColumn("_at", F.col("rn")), ["contig_ord"], value, width).drop("_at")


def moving_average_reflected(df: DataFrame, value: str, width: int = 100) -> DataFrame:
    """As ``moving_average``, but along the whole genome with mirrored ends."""
    half = width // 2
    top = df.agg(F.max("rn")).first()[0] or 0
    mirrored = F.array(F.col("rn"), F.when(F.col("rn") <= half, 1 - F.col("rn")), F.when(F.col("rn") > top - half, 2 * top + 1 - F.col("rn")))
    d = _smooth(df.select(value, F.explode(F.array_compact(mirrored)).alias("_at")), [], value, width)
    return df.join(d.select(F.col("_at").alias("rn"), "smooth"), "rn")


def contig_offsets(df: DataFrame) -> DataFrame:
    """(contig_ord, offset): the summed last positions of the contigs before; one row per contig."""
    last = df.groupBy("contig_ord").agg(F.max("pos").alias("last"))
    before = F.sum("last").over(W.orderBy("contig_ord").rowsBetween(W.unboundedPreceding, -1))
    return last.select("contig_ord", F.coalesce(before, F.lit(0)).alias("offset"))


def cumulative_offset(df: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """df with x = pos + offset, from its own or another data set's offsets."""
    o = offsets if offsets is not None else contig_offsets(df)
    return df.join(F.broadcast(o), "contig_ord").withColumn("x", F.col("pos") + F.col("offset")).drop("offset")


def group_midpoint(df: DataFrame) -> DataFrame:
    return df.groupBy("contig_ord").agg((F.max("x") - (F.max("x") - F.min("x")) / 2).alias("mid"))


def pairwise_samples(samples: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """All ordered pairs of different samples; a sample list is small, and its pairs are the result."""
    a = samples.select(F.col(key).alias("i"), *[F.col(c).alias(f"{c}_i") for c in columns])
    b = samples.select(F.col(key).alias("j"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return a.join(b, F.col("i") != F.col("j"))


def conditional_assign(default: Column | None, *steps: tuple[Column, object]) -> Column:
    """Later steps overwrite earlier ones where their condition is true."""
    out = default if default is not None else F.lit(None)
    for condition, value in steps:
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def dict_recode(column: str, mapping: dict) -> Column:
    """Mapped labels; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(column))
