"""Alignment records: predicates, classes, CIGAR arithmetic, pileups, coverage, duplicates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.functions.ordering import running_sums
from popweave.functions.sizes import small

_INT = "int"


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def _byte_sums(quals: pa.Array) -> pa.Array:
    """The sum of character code - 33 of each string, read off running sums over all bytes; null for null."""
    quals = quals.cast(pa.large_binary())
    _, offsets, data = quals.buffers()
    n = len(quals)
    ends = np.frombuffer(offsets, np.int64)[quals.offset : quals.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and n else np.zeros(0, np.uint8)
    upto = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    sums = upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]] - 33 * np.diff(ends)
    return pa.array(sums, mask=quals.is_null().to_numpy(zero_copy_only=False))


def quality_sum(qual: str | Column) -> Column:
    """Summed qualities of a text of ASCII characters from 33 on, by Arrow batches; null for null."""
    return F.arrow_udf(_byte_sums, "bigint")(qual)


def mean_phred(qual: str | Column) -> Column:
    """Mean of character code - 33; null for an empty string."""
    return F.try_divide(quality_sum(qual), F.length(qual))


def cigar_ops(cigar: str | Column) -> Column:
    """Array of (len, op)."""
    numbers = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast(_INT))
    return F.arrays_zip(numbers.alias("len"), F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1)).alias("op"))


def op_count(cigar: str, op: str) -> Column:
    return F.length(cigar) - F.length(F.replace(cigar, F.lit(op)))


def cigar_length(cigar: str | Column, ops: str) -> Column:
    """Bases under the named operations."""
    found = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast(_INT))


def reference_end(pos: str = "pos", cigar: str = "cigar") -> Column:
    """One past the last aligned reference base."""
    return F.col(pos) + cigar_length(cigar, "MDN=X")


def read_group_string(run: str, library: str, sample: str, platform: str) -> Column:
    parts = [F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("ID", run), ("LB", library), ("SM", sample), ("PL", platform))]
    return F.concat_ws("\\t", F.lit("@RG"), *parts)


def lane_token(name: str | Column) -> Column:
    """First '_' token that starts with L."""
    return F.get(F.filter(F.split(name, "_"), lambda x: x.startswith("L")), 0)


def filter_qtl_reads(reads: DataFrame) -> DataFrame:
    """Proper pairs with both mates mapped, at most 3000 apart, quality 40 or more, and one M operation."""
    return reads.where("is_paired and not is_unmapped and not mate_is_unmapped and is_proper_pair and abs(isize) <= 3000 and mapq >= 40 and cigar rlike '^[0-9]+M$'")


def filter_sv_reads(reads: DataFrame, min_mapq: int = 10) -> DataFrame:
    return reads.where(~F.col("is_secondary") & (F.col("mapq") > min_mapq) & F.col("sa").isNotNull())


def filter_nonempty_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with both sequences, names rewritten."""
    kept = pairs.where("length(seq1) > 0 and length(seq2) > 0")
    return kept.withColumns({"name1": F.concat("name", F.lit(" 1:N:0:2")), "name2": F.concat("name", F.lit(" 2:N:0:2"))})


def front_clip(cigar: str = "cigar") -> Column:
    """Bases of a soft clip that leads the CIGAR; else null."""
    return F.substring_index(cigar, "S", 1).try_cast(_INT)


def back_clip(cigar: str = "cigar") -> Column:
    """Bases of a soft clip that ends the CIGAR; else null. The pattern is tried on such CIGARs alone."""
    return F.when(F.endswith(F.col(cigar), F.lit("S")), F.regexp_extract(cigar, "([0-9]+)S$", 1).try_cast(_INT))


def _clip() -> Column:
    """The qualities of the soft clip at the first, else the last operation, if over 5 bases; else null."""
    n, m = front_clip(), back_clip()
    return F.when(n > 5, F.substring("qual", F.lit(1), n)).when(n.isNull() & (m > 5), F.right("qual", m))


def _clippable() -> Column:
    """Whether a read is clipped if its clip's quality is high enough."""
    return (op_count("cigar", "S") == 1) & ~F.col("has_xm") & ~F.col("is_secondary") & (F.col("mapq") != 0)


def read_classes() -> Column:
    """The classes of a read: it may have several; none if it is a duplicate."""
    clipped = _clippable() & (F.col("clip_quality") > 25)
    same = F.col("contig_ord") == F.col("next_contig_ord")
    mated = ~F.col("mate_is_unmapped")
    turned = ((F.col("pos") < F.col("next_pos")) & F.col("is_reverse")) | ((F.col("pos") > F.col("next_pos")) & F.col("mate_is_reverse"))
    first = F.when(F.col("sa").isNotNull(), "chimeric").when(clipped, "clipped")
    pair = F.when(mated & ~same, "discordant").when(mated & (F.col("is_reverse") == F.col("mate_is_reverse")), "inversion").when(mated & turned & (F.abs("isize") > 102), "duplication")
    unmapped = F.array_compact(F.array(F.when(F.col("phred") > 25, "unmapped")))
    return F.when(F.col("is_duplicate"), F.array().cast("array<string>")).when(F.col("is_unmapped"), unmapped).otherwise(F.array_compact(F.array(first, pair)))


def classify_reads(reads: DataFrame) -> DataFrame:
    """One row per read and class. A read's quality is that of the whole where it is unmapped, else that of its clip where this decides: one sum each."""
    q = reads.withColumn("_part", F.when(F.col("is_duplicate"), None).when(F.col("is_unmapped"), F.col("qual")).when(F.col("sa").isNull() & _clippable(), _clip()))
    q = q.withColumn("_mean", mean_phred("_part")).withColumns({"phred": F.when(F.col("is_unmapped"), F.col("_mean")), "clip_quality": F.when(~F.col("is_unmapped"), F.col("_mean"))})
    return q.withColumn("class", F.explode(read_classes())).drop("phred", "clip_quality", "_part", "_mean")


def category_counts(classified: DataFrame, key: str, classes: list[str]) -> DataFrame:
    return classified.groupBy(key).pivot("class", classes).count().na.fill(0)


#: Places are packed with their contig's number and letter into 63 bits: 17 for contigs of a task, 38 for places, 8 for letters.
_PLACE_BITS, _MOST_CONTIGS = 38, 1 << 17
#: Bases that a task takes at once, and distinct (place, letter) cells that it gathers before it passes their counts on.
_MOST_CELLS = 1 << 22


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, their counts summed."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _runs(cigars: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first, runs) of distinct CIGARs: runs first[i] to first[i + 1] are those of aligned bases of the i-th, as
    (reference length before it, read length before it, length, what follows: bases inserted > 0, deleted < 0)."""
    first, runs = [0], []
    for cigar in cigars:
        ref = read = 0
        ops = [(int(n), o) for n, o in re.findall("([0-9]+)([MIDNSHP=X])", cigar)]
        for (n, o), (m, p) in zip(ops, [*ops[1:], (0, "")]):
            if o in "M=X" and n:
                runs.append((ref, read, n, m if p == "I" else -m if p and p in "DN" else 0))
            ref += n if o in "MDN=X" else 0
            read += n if o in "MIS=X" else 0
        first.append(len(runs))
    return np.array(first), np.array(runs, np.int64).reshape(-1, 4)


def _upto(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _by_bases(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bases, so that long reads take no more memory than short ones."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("seq")).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *np.flatnonzero(np.diff(upto // most, prepend=0)).tolist(), len(batch)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _counted_bases(batches: Iterator[pa.RecordBatch], most: int = _MOST_CELLS) -> Iterator[pa.RecordBatch]:
    """Reads (keys, pos, cigar, seq) as (keys, pos, shown, n): what they show at a place, counted over the batches of a task; with _low and _high, at places from _low on and before _high."""
    letter = pa.array([chr(c) for c in range(256)], pa.string())
    half = 1 << (_PLACE_BITS - 1)
    numbers: dict[tuple, int] = {}
    keys, counts, held = [], [], 0
    by: list[pa.Field] = []

    def named(number: np.ndarray, rest: dict[str, pa.Array]) -> pa.Table:
        known = list(numbers)
        return pa.table({f.name: pa.array([k[i] for k in known], f.type).take(pa.array(number)) for i, f in enumerate(by)} | rest)

    def passed_on() -> Iterator[pa.RecordBatch]:
        key, n = _merged(keys, counts)
        places = ((key >> 8) & ((1 << _PLACE_BITS) - 1)) - half
        yield from named(key >> (_PLACE_BITS + 8), {"pos": pa.array(places), "shown": letter.take(pa.array(key & 255)), "n": pa.array(n)}).to_batches()

    for batch in _by_bases(batches, most):
        by = [f for f in batch.schema if f.name not in ("_low", "_high", "pos", "cigar", "seq")]
        cigars = batch.column("cigar").dictionary_encode()
        first, runs = _runs(cigars.dictionary.to_pylist())
        code = cigars.indices.to_numpy(zero_copy_only=False)
        many = first[code + 1] - first[code]
        read = np.repeat(np.arange(len(code)), many)
        ref, before, size, follows = runs[np.repeat(first[code], many) + _upto(many)].T
        raw = batch.column("seq").cast(pa.large_binary())
        length = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        letters = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        there = np.clip(length[read] - before, 0, size)  # seq may lack bases
        start, at = batch.column("pos").to_numpy(zero_copy_only=False)[read] + ref, (np.cumsum(length) - length)[read] + before
        whole = there == size
        if "_low" in batch.schema.names:  # what lies outside of the read's bin is counted in others
            low, high = (batch.column(c).to_numpy(zero_copy_only=False)[read] for c in ("_low", "_high"))
            skip = np.clip(low - start, 0, there)
            whole &= (start + size <= high) & (skip < there)
            start, at, there = start + skip, at + skip, np.clip(high - start, skip, there) - skip
        if not there.any():
            continue
        if start[there > 0].min() < -half or (start + there)[there > 0].max() > half:
            raise ValueError(f"a place is outside of +-{half}")
        owner = np.zeros(len(batch), np.int64)
        coded = [batch.column(f.name).dictionary_encode("encode") for f in by]
        for c in coded:
            owner = owner * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
        seen, owner = np.unique(owner, return_inverse=True)
        names, left = [], seen
        for c in coded[::-1]:
            left, i = np.divmod(left, len(c.dictionary))
            names.append([c.dictionary[k].as_py() for k in i.tolist()])
        names = list(zip(*names[::-1]))
        if keys and len(numbers) + len(names) > _MOST_CONTIGS:
            yield from passed_on()
            numbers, keys, counts, held = {}, [], [], 0
        number = np.array([numbers.setdefault(c, len(numbers)) for c in names], np.int64)[owner][read]
        last = (follows != 0) & whole
        plain = there - last  # the last base is shown with what follows
        key = np.repeat((number << (_PLACE_BITS + 8)) + ((start + half) << 8), plain) + (_upto(plain) << 8) + letters[np.repeat(at, plain) + _upto(plain)]
        if last.any():
            text, ends = letters.tobytes(), np.cumsum(length)[read]
            shown = [text[e - 1 : e if n < 0 else min(e + n, m)].decode("latin-1") + (str(n) if n < 0 else "") for e, n, m in zip((at + there)[last].tolist(), follows[last].tolist(), ends[last].tolist())]
            marked = pa.table({"k": number[last], "pos": (start + there - 1)[last], "shown": shown}).group_by(["k", "pos", "shown"]).aggregate([([], "count_all")])
            yield from named(marked["k"].to_numpy(), {"pos": marked["pos"], "shown": marked["shown"], "n": marked["count_all"]}).to_batches()
        key, n = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > most:
            key, n = _merged(keys, counts)
            keys, counts, held = [key], [n], len(key)
            if held > most // 2:
                yield from passed_on()
                keys, counts, held = [], [], 0
    if keys:
        yield from passed_on()


def _shown(reads: DataFrame, by: list[str], sites: DataFrame | None, width: int) -> DataFrame:
    """(``by``, contig_ord, pos, shown, n) of reads (``by``, contig_ord, pos, cigar, seq): what they show at their places, in partial counts.

    Whole reads, not their single bases, are brought together by bins of ``width`` places, which may be split (the hint ``rebalance``). With
    sites, a read goes to every bin that it meets and that has a site, and shows there the places of that bin only.
    """
    keys = [f for f in reads.schema if f.name in (*by, "contig_ord")]
    r = reads.withColumn("pos", F.col("pos").cast("long")).dropna(subset=["contig_ord", "pos", "cigar", "seq"])
    if sites is None:
        r = r.withColumn("_bin", F.floor(F.col("pos") / width))
    else:
        last = F.floor((F.greatest(reference_end(), F.col("pos") + 1) - 1) / width)
        r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), last)))
        r = r.join(sites.select("contig_ord", F.floor(F.col("pos") / width).alias("_bin")).distinct(), ["contig_ord", "_bin"], "left_semi")
        r = r.withColumns({"_low": F.col("_bin") * width, "_high": (F.col("_bin") + 1) * width})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "pos long, shown string, n long"])
    return r.hint("rebalance", "contig_ord", "_bin").select(*[f.name for f in keys], *(c for c in ("_low", "_high") if c in r.columns), "pos", "cigar", "seq").mapInArrow(_counted_bases, schema)


def pileup_bases(reads: DataFrame, sites: DataFrame | None = None, width: int = 1 << 14) -> DataFrame:
    """Bases over the sites (contig_ord, pos), or all covered positions: deletions left out, followed by -n or inserted bases; counted per text.

    Tasks count what whole reads show by place, and a last sum over these counts makes the result independent of where a read
    was counted. Reads without a contig, place, CIGAR or sequence show nothing, nor do bases that seq lacks.
    """
    r = reads.select("contig_ord", "pos", "cigar", "seq")
    n = _shown(r, [], sites, width).groupBy("contig_ord", "pos", "shown").agg(F.sum("n").alias("n"))
    return n if sites is None else n.join(sites.select("contig_ord", "pos").distinct(), ["contig_ord", "pos"], "left_semi")


def site_allele_depths(reads: DataFrame, sites: DataFrame, key: str, width: int = 1 << 12) -> DataFrame:
    """Depths of the reference and alternative base per site (contig_ord, pos, ref, alt) and ``key``; sites of one place are summed.

    Bases are counted by place before they meet the sites, so neither the depth nor equal sites multiply rows. Bases that seq lacks count as neither.
    """
    full = F.rpad("seq", F.greatest(F.length("seq"), cigar_length("cigar", "MIS=X")), " ")
    r = reads.select(key, "contig_ord", "pos", "cigar", full.alias("seq"))
    s = sites.groupBy("contig_ord", "pos", "ref", "alt").agg(F.count("*").alias("_many"))
    depth = lambda allele: F.coalesce(F.sum(F.when(F.substring("shown", 1, 1) == F.col(allele), F.col("n") * F.col("_many"))), F.lit(0).cast("long"))
    return _shown(r, [key], sites, width).join(s, ["contig_ord", "pos"]).groupBy("contig_ord", "pos", key).agg(depth("ref").alias("ad_ref"), depth("alt").alias("ad_alt"))


def _met(spans: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Spans (contig_ord, pos, _end) joined with the regions (contig_ord, start, stop; half open) that they overlap, by bins of ``width``."""
    r = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("_end") - 1) / width))))
    g = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    both = r.join(g, ["contig_ord", "_bin"]).where("pos < stop and _end > start")
    first = F.greatest(F.floor(F.col("pos") / width), F.floor(F.col("start") / width))
    return both.where(F.col("_bin") == first).drop("_bin")  # a pair that shares several bins counts in the first


def reads_in(reads: DataFrame, regions: DataFrame, width: int = 1000) -> DataFrame:
    """Reads joined with the regions (contig_ord, start, stop; half open) that they overlap: as many rows as there are such pairs."""
    return _met(reads.withColumn("_end", F.greatest(reference_end(), F.col("pos") + 1)), regions, width)


def region_counts(reads: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(``key``, n_reads, bases): reads over the regions (``key``, contig_ord, start, stop; half open) and their places inside, summed per ``key``; none for a region without places.

    Reads and regions never meet. Along the genome run how many reads began before a place and how many ended up to it; a region's reads are those
    that began before its stop less those that ended up to its start, and its places a difference of sums too. What earlier contigs hold cancels out.
    """
    begins = F.struct((F.col("pos") + 1).cast("long").alias("at"), F.lit(1).alias("b"), F.lit(0).alias("e"), F.col("pos").cast("long").alias("m"))
    end = F.greatest(reference_end(), F.col("pos") + 1).cast("long")
    ends = F.struct(end.alias("at"), F.lit(0).alias("b"), F.lit(1).alias("e"), (-end).alias("m"))
    steps = reads.where("contig_ord is not null and pos is not null").select("contig_ord", F.explode(F.array(begins, ends)).alias("x")).select("contig_ord", "x.*")
    sides = F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(-1).alias("side")), F.struct(F.col("stop").cast("long").alias("at"), F.lit(1).alias("side"))))
    bounds = regions.where("start < stop").select(key, "contig_ord", sides.alias("x")).select(key, "contig_ord", "x.*")
    none = F.lit(0)
    places = steps.unionByName(bounds.select("contig_ord", "at", none.alias("b"), none.alias("e"), none.cast("long").alias("m")))
    places = places.groupBy("contig_ord", "at").agg(F.sum("b").alias("b"), F.sum("e").alias("e"), F.sum("m").alias("m"))
    upto = running_sums(places, ["contig_ord", "at"], ["b", "e", "m"])
    n = F.when(F.col("side") > 0, F.col("b")).otherwise(-F.col("e"))
    bases = F.col("side") * (F.col("at") * (F.col("b") - F.col("e")) - F.col("m"))
    return bounds.join(upto, ["contig_ord", "at"]).groupBy(key).agg(F.sum(n).alias("n_reads"), F.sum(bases).alias("bases"))


def mean_coverage_region(reads: DataFrame, regions: DataFrame, read_len: float) -> DataFrame:
    """Coverage per region (region, contig_ord, start, stop): reads * length over 10,000 bases, else aligned bases, per length + 1."""
    n = region_counts(reads, regions.withColumns({"stop": F.col("stop") + 1}), "region")
    size = F.col("stop") - F.col("start")
    out = regions.join(n, "region", "left").na.fill(0, ["n_reads", "bases"])
    return out.select("region", F.when(size > 10_000, F.col("n_reads") * read_len / (size + 1)).otherwise(F.col("bases") / (size + 1)).alias("coverage"))


def mean_coverage(reads: DataFrame, contigs: DataFrame, read_len: float) -> DataFrame:
    """(n_reads, coverage) of a whole file: mapped reads * length over all contigs' bases."""
    total = contigs.agg(F.sum("contig_len").alias("_bases"))  # one row
    n = reads.where("not is_unmapped").agg(F.count("*").alias("n_reads"))
    return n.join(F.broadcast(total)).select("n_reads", F.try_divide(F.col("n_reads") * read_len, "_bases").alias("coverage"))


def median_read_length(reads: DataFrame, order: str, n: int = 100_001) -> DataFrame:
    """Median length of the first n reads by ``order``."""
    return reads.orderBy(order).limit(n).agg(F.median(F.length("seq")).alias("median_length"))


def nearby_regions(breakpoints: DataFrame, delta: int) -> DataFrame:
    """The ``delta`` bases before a right-hand breakpoint or after a left-hand one, as regions."""
    left = F.col("side") == "left"
    return breakpoints.select("region", "contig_ord", F.when(left, F.col("pos")).otherwise(F.greatest(F.col("pos") - delta, F.lit(0))).alias("start"), F.when(left, F.col("pos") + delta).otherwise(F.col("pos")).alias("stop"))


def overlapping_bins(reads: DataFrame, contigs: DataFrame, size: int = 500, step: int = 250) -> DataFrame:
    """reads with bin: every bin start b (multiple of step, below contig length - size) with b < end and b + size > pos."""
    r = reads.join(small(contigs.select("contig_ord", "contig_len")), "contig_ord")  # one row per contig
    low = F.greatest(F.floor((F.col("pos") - size) / step) + 1, F.lit(0))
    high = F.least(F.floor((reference_end() - 1) / step), F.floor((F.col("contig_len") - size - 1) / step))
    return r.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("bin", F.explode(F.sequence(F.col("_low") * step, F.col("_high") * step, F.lit(step)))).drop("_low", "_high")


def strand_counts(binned: DataFrame) -> DataFrame:
    """Forward and reverse unclipped reads per bin."""
    clear = binned.where("not cigar rlike '[SH]'")
    return clear.groupBy("contig_ord", "bin").agg(F.count_if(~F.col("is_reverse")).alias("forward"), F.count_if("is_reverse").alias("reverse"))


def insertion_islands(counts: DataFrame, contigs: DataFrame, least: int, size: int = 500, step: int = 250) -> DataFrame:
    """(contig_ord, mid) of runs of hits: forward bins with reverse bins 500 to 1500 bases on; the run ends at the first bin without."""
    c = counts.join(small(contigs.select("contig_ord", "contig_len")), "contig_ord")
    forward = (F.col("forward") > least) & (F.col("forward") > 5 * F.col("reverse"))
    reverse = (F.col("reverse") > least) & (F.col("reverse") > 5 * F.col("forward"))
    by = W.partitionBy("contig_ord").orderBy("bin")
    ahead = F.max(F.when(reverse, F.col("bin")))
    found = [ahead.over(by.rangeBetween(k * size, k * size)).isNotNull() for k in (1, 2, 3)]
    hit = forward & (F.col("bin") + 4 * size < F.col("contig_len")) & (found[0] | found[1] | found[2])
    hits = c.withColumn("hit", hit).where("hit")
    run = F.col("bin") - step * F.row_number().over(by)
    ends = hits.withColumn("run", run).groupBy("contig_ord", "run").agg((F.max("bin") + step).alias("stop"))
    return ends.select("contig_ord", (F.col("stop") + size // 2).alias("mid"))


def read_end_distance(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site (site_id, contig_ord, pos): least distance to the nearer aligned end of a read over it, and clipped reads.

    Clipped reads are counted by ``region_counts``. The nearest end is that of the read that begins last, or ends first, of those over the site: of
    reads that begin at one place only the longest matters, of those that end at one place that too, and equal sites are one place. So a
    place meets twice as many reads as the longest read has bases at most, whatever the depth.
    """
    ok = reads.where("not is_unmapped and not is_secondary and mapq > 0 and contig_ord is not null and pos is not null")
    spans = ok.select("contig_ord", "pos", F.greatest(reference_end(), F.col("pos") + 1).alias("_end"))
    longest = spans.groupBy("contig_ord", "pos").agg(F.max("_end").alias("_end")).unionByName(spans.groupBy("contig_ord", "_end").agg(F.min("pos").alias("pos")))
    g = sites.select("site_id", "contig_ord", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
    near = F.least(F.col("start") - F.col("pos"), F.col("_end") - 1 - F.col("start"))
    least = _met(longest, g.select("contig_ord", "start", "stop").distinct(), 1000).groupBy("contig_ord", "start").agg(F.min(near).alias("least_distance"))
    per_site = g.join(least, ["contig_ord", "start"]).groupBy("site_id").agg(F.min("least_distance").alias("least_distance"))
    clipped = region_counts(ok.where(F.col("cigar").rlike("[SH]")), g, "site_id").select("site_id", F.col("n_reads").alias("clipped"))
    return per_site.join(clipped, "site_id", "left").select("site_id", "least_distance", F.coalesce("clipped", F.lit(0).cast("long")).alias("clipped"))


def clips(reads: DataFrame) -> DataFrame:
    """(contig_ord, clip_pos, side, clip, qname): soft clips of reads with one of them; left-hand ones read backward."""
    front, back = front_clip(), back_clip()
    one = reads.where(op_count("cigar", "S") == 1).withColumns({"_f": front, "_k": back})
    side = F.when(F.col("_f") > 0, "left").when(F.col("_k") > 0, "right")
    clip = F.when(F.col("_f") > 0, F.reverse(F.substring("seq", F.lit(1), F.col("_f")))).otherwise(F.expr("right(seq, _k)"))
    return one.select("contig_ord", F.when(F.col("_f") > 0, F.col("pos")).otherwise(reference_end()).alias("clip_pos"), side.alias("side"), clip.alias("clip"), "qname").where("side is not null")


def clip_consensus(clipped: DataFrame, share: float = 0.74) -> DataFrame:
    """Per clip position the majority base of each place if its share reaches ``share`` and depth is over 1; '' at depth 1; else N.

    Equal clips of a position are counted before they are cut into bases, so a deep position is as many rows as it has different clips.
    """
    key = ["contig_ord", "clip_pos", "side"]
    same = clipped.groupBy(*key, "clip").agg(F.count("*").alias("_many"))
    bases = same.select(*key, "_many", F.posexplode(F.split("clip", "")).alias("i", "base")).where("base <> ''")
    n = bases.groupBy(*key, "i", "base").agg(F.sum("_many").alias("n"))
    best = n.groupBy(*key, "i").agg(F.sum("n").alias("depth"), F.max(F.struct("n", (-F.ascii("base")).alias("o"), "base")).alias("b"))
    letter = F.when(F.col("depth") == 1, "").when(F.col("b.n") / F.col("depth") >= share, F.col("b.base")).otherwise("N")
    return best.groupBy(*key).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("i", letter.alias("x")))), lambda s: s["x"])).alias("consensus"))


def longest_clip(clipped: DataFrame) -> DataFrame:
    """The longest clip per position, of equal ones the first by name."""
    w = W.partitionBy("contig_ord", "clip_pos", "side").orderBy(F.desc(F.length("clip")), "qname")
    return clipped.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """reads with duplicate: same sample, unclipped 5' end, strand and mate place as a read of higher quality sum."""
    front, back = F.coalesce(front_clip(), F.lit(0)), F.coalesce(back_clip(), F.lit(0))
    five = F.when(F.col("is_reverse"), reference_end() + back).otherwise(F.col("pos") - front)
    w = W.partitionBy("sample_idx", "contig_ord", "_five", "is_reverse", "next_contig_ord", "next_pos").orderBy(F.desc("_q"), "qname")
    return reads.withColumns({"_five": five, "_q": quality_sum("qual")}).withColumn("duplicate", F.row_number().over(w) > 1).drop("_five", "_q")


def mate_lookup(reads: DataFrame, sites: DataFrame, reach: int = 250) -> DataFrame:
    """(site_id, qname, mate_seq): mates of forward reads left of a site and of reverse reads right of it, oriented.

    Reads meet their mates first, so that a read without one never meets the sites.
    """
    g = sites.select("site_id", "contig_ord", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), F.col("pos").alias("stop"), F.lit(False).alias("want"))
    g = g.unionByName(sites.select("site_id", "contig_ord", F.col("pos").alias("start"), (F.col("pos") + reach).alias("stop"), F.lit(True).alias("want")))
    mates = reads.select("qname", F.col("contig_ord").alias("next_contig_ord"), F.col("pos").alias("_at"), F.col("is_reverse").alias("_turned"), F.col("seq").alias("_seq"))
    a = reads.select("qname", "contig_ord", "pos", "cigar", F.col("is_reverse").alias("want"), "next_contig_ord", "next_pos")
    both = a.join(mates, ["qname", "next_contig_ord"]).where(F.abs(F.col("_at") - F.col("next_pos")) <= 1)
    seq = F.when(F.col("_turned") != F.col("want"), F.col("_seq")).otherwise(reverse_complement("_seq"))
    both = both.select("qname", "contig_ord", "pos", "cigar", F.col("want").alias("_want"), seq.alias("mate_seq"))
    return reads_in(both, g).where("_want = want").select("site_id", "qname", "mate_seq")
