"""Chimeric reads as junctions between two places, and structural-variant candidates from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popweave.functions.scratch import stored
from popweave.functions.sizes import small
from popweave.operators.intervals import cut_regions
from popweave.operators.reads import reference_end, reverse_complement

BATCH = 256
_TURN = str.maketrans("ACGTN", "TGCAN")
KEY = ["c1", "p1", "d1", "c2", "p2", "d2", "ins", "type"]
_NUMBER = "int"


def _first(pattern: str, column: str) -> Column:
    return F.regexp_extract(column, pattern, 1).try_cast(_NUMBER)


def _worked_out(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns as results of a generator of one row, so that no filter or later column repeats their expressions."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_x")).select(*rest, "_x.*")


def junctions(reads: DataFrame, one_contig: bool = False) -> DataFrame:
    """reads with the junction of their two alignments: c1, p1, d1, c2, p2, d2, ins, type.

    Kept are reads whose CIGAR is one M and one S and whose first other alignment (tag SA, position 1-based) is
    one M and one S too. Bases read by neither alignment are inserted; bases read by both are taken off the lower end.
    """
    sa = F.split("sa", ",")
    r = reads.where(F.col("sa").isNotNull()).withColumns({"_c2": F.get(sa, 0).try_cast(_NUMBER), "_sp": F.get(sa, 1).try_cast(_NUMBER), "_same": F.get(sa, 2) == F.when(F.col("is_reverse"), "-").otherwise("+"), "_sc": F.get(sa, 3)})
    r = r.where(F.col("cigar").rlike("^([0-9]+M[0-9]+S|[0-9]+S[0-9]+M)$") & F.col("_sc").rlike("^([0-9]+M[0-9]+S|[0-9]+S[0-9]+M)$"))
    if one_contig:
        r = r.where("_c2 = contig_ord")
    r = _worked_out(r.withColumns({"_front": F.col("cigar").rlike("^[0-9]+M"), "_m1": _first("([0-9]+)M", "cigar"), "_m2": _first("([0-9]+)M", "_sc")}), ["_c2", "_sp", "_same", "_sc", "_front", "_m1", "_m2"])
    # the other alignment must hold the other part of the read: its match comes last or first as the strands tell
    tail = F.col("_front") == F.col("_same")
    want = F.when(tail, F.col("_sc").rlike("M$")).otherwise(F.col("_sc").rlike("^[0-9]+M"))
    r = r.withColumn("_tail", tail).where(want & F.col("_sp").isNotNull())
    r = r.withColumns({"_c1": F.col("contig_ord"), "_p1": F.col("pos") + F.when(F.col("_front"), F.col("_m1") - 1).otherwise(0), "_d1": F.when(F.col("_front"), "r").otherwise("l"), "_p2": F.col("_sp") + F.when(F.col("_tail"), -1).otherwise(F.col("_m2") - 2), "_d2": F.when(F.col("_tail"), "l").otherwise("r"), "_gap": F.length("seq") - F.col("_m1") - F.col("_m2")})
    flip = F.when(F.col("_c1") == F.col("_c2"), F.col("_p1") > F.col("_p2")).otherwise(F.col("_c1") > F.col("_c2"))
    begin = F.when(F.col("_front"), F.col("_m1")).otherwise(F.col("_m2"))
    r = r.withColumns({"_flip": flip, "ins": F.when(F.col("_gap") > 0, F.substring("seq", begin + 1, F.col("_gap"))).otherwise("")})
    r = _worked_out(r, ["_c1", "_p1", "_d1", "_c2", "_p2", "_d2", "_gap", "_flip", "ins"])
    lower = {c: F.when(F.col("_flip"), F.col(f"_{c}2")).otherwise(F.col(f"_{c}1")) for c in "cpd"}
    upper = {c: F.when(F.col("_flip"), F.col(f"_{c}1")).otherwise(F.col(f"_{c}2")) for c in "cpd"}
    shift = F.when(F.col("_gap") <= 0, F.when(lower["d"] == "l", -F.col("_gap")).otherwise(F.col("_gap"))).otherwise(0)
    out = r.withColumns({"c1": lower["c"], "p1": lower["p"] + shift, "d1": lower["d"], "c2": upper["c"], "p2": upper["p"], "d2": upper["d"]})
    out = out.withColumn("type", junction_type()).drop(*[c for c in out.columns if c.startswith("_")])
    return _worked_out(out, KEY)


def junction_type() -> Column:
    one = F.col("c1") == F.col("c2")
    return F.when(~one, "cf").when((F.col("d1") == "r") & (F.col("d2") == "l"), "del").when((F.col("d1") == "l") & (F.col("d2") == "r"), "dup").otherwise("inv")


def junction_counts(found: DataFrame, samples: list[int] | None = None) -> DataFrame:
    """Reads per junction, and per sample if samples are named."""
    per = [F.count_if(F.col("sample_idx") == s).alias(f"s{s}") for s in samples or []]
    return found.groupBy(*KEY).agg(F.count("*").alias("n"), *per)


def recurrent_short_events(counts: DataFrame, least: int = 5, longest: int = 100_000) -> DataFrame:
    return counts.where((F.col("n") >= least) & (F.abs(F.col("p2") - F.col("p1")) < longest) & (F.col("type") != "cf"))


def long_event_alleles(counts: DataFrame, reference: DataFrame, least: int = 5, shortest: int = 0) -> DataFrame:
    """(contig_ord, pos, type, ref, alt) of deletions, duplications and inversions from reference (contig_ord, seq)."""
    ev = counts.where((F.col("n") >= least) & (F.col("type") != "cf") & (F.col("p2") - F.col("p1") >= shortest) & (F.col("p1") >= 0) & (F.col("p1") <= F.col("p2")))
    ev = ev.withColumns({"contig_ord": F.col("c1"), "start": F.col("p1"), "stop": F.greatest(F.col("p2"), F.col("p1") + 1)})
    ev = cut_regions(reference, ev).withColumnRenamed("seq", "_seq")
    part = F.substring("_seq", F.lit(1), (F.col("p2") - F.col("p1")).cast("int"))
    base = F.substring("_seq", 1, 1)
    ref = F.when(F.col("type") == "dup", base).otherwise(part)
    alt = F.when(F.col("type") == "del", F.concat(base, "ins")).when(F.col("type") == "dup", F.concat(base, part)).otherwise(reverse_complement(part))
    return ev.select(F.col("c1").alias("contig_ord"), F.col("p1").alias("pos"), "type", ref.alias("ref"), alt.alias("alt")).distinct()


def private_junctions(found: DataFrame, inside: Column, least: int = 10) -> DataFrame:
    """Junctions seen more than ``least`` times inside the group and never outside."""
    n = found.groupBy(*KEY).agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    return n.where((F.col("n_in") > least) & (F.col("n_out") == 0))


def segregating_deletions(found: DataFrame, seed: int, carriers: list[int], others: list[int], shortest: int = 80, longest: int = 200, least: int = 5) -> DataFrame:
    """Clean deletions of the seed sample that all carriers share and none of the others has."""
    count = lambda s: F.count_if(F.col("sample_idx") == s)
    ends = lambda f, s: f(*[count(x) for x in s], *[count(s[0])] * (len(s) == 1)) if s else F.lit(0)
    n = found.groupBy(*KEY).agg(count(seed).alias("n_seed"), ends(F.least, carriers or [seed]).alias("n_least"), ends(F.greatest, others).alias("n_most"))
    size = F.col("p2") - F.col("p1")
    return n.where((F.col("type") == "del") & (F.col("ins") == "") & (size > shortest) & (size < longest) & (F.col("n_seed") >= least) & (F.col("n_least") > 0) & (F.col("n_most") == 0))


def with_marked_segment(deletions: DataFrame, reference: DataFrame, flank: int = 400) -> DataFrame:
    """deletions (KEY) with context: ``flank`` bases, [the deleted ones], ``flank`` bases."""
    p1, p2 = F.col("p1").cast("long"), F.col("p2").cast("long")
    part = lambda name, x, y: F.struct(F.lit(name).alias("part"), F.greatest(x, F.lit(0)).alias("start"), F.greatest(y, F.lit(0)).alias("stop"))
    cuts = deletions.select("c1", "p1", "p2").distinct()
    cuts = cuts.select("c1", "p1", "p2", F.col("c1").alias("contig_ord"), F.explode(F.array(part("l", p1 - flank, p1), part("m", p1, p2), part("r", p2, p2 + flank))).alias("p")).select("*", "p.*").drop("p")
    text = lambda name: F.coalesce(F.max(F.when(F.col("part") == name, F.col("seq"))), F.lit(""))
    shown = cut_regions(reference, cuts).groupBy("c1", "p1", "p2").agg(F.concat(text("l"), F.lit("["), text("m"), F.lit("]"), text("r")).alias("context"))
    return deletions.join(shown, ["c1", "p1", "p2"])


def keys_only_in(counts: DataFrame, other: DataFrame, least: int = 10) -> DataFrame:
    """Keys counted more than ``least`` times that the other table does not have."""
    return counts.where(F.col("n") > least).join(other.select(*KEY), KEY, "left_anti")


def linear_position(contig_ord: str, pos: str) -> Column:
    return F.col(contig_ord).cast("long") * 25_000_000 + F.col(pos)


def reads_at_breakpoint(reads: DataFrame, events: DataFrame, margin: int = 5) -> DataFrame:
    """(event, qname, and the read): reads near start or stop of the events, one per name and event.

    Events that fit are broadcast, so reads stay where they are; only reads whose name another one has (by 64-bit hash), or at an event that has several places,
    are shuffled to find the last one.
    """
    width = 1000
    places = stored(events.select("event", "contig_ord", "start", "stop").distinct(), "events")
    many = places.groupBy(F.col("event").alias("_of")).agg((F.count("*") > 1).alias("_many"))  # an event of several places
    at = F.col("at")
    ends = places.join(many, F.col("event").eqNullSafe(F.col("_of"))).select("event", "contig_ord", "_many", "start", F.explode(F.array(F.struct(F.lit(False).alias("_stop"), F.col("start").alias("at")), F.struct(F.lit(True).alias("_stop"), F.col("stop").alias("at")))).alias("e"))
    ends = small(stored(ends.select("event", "contig_ord", "_many", F.col("start").alias("_start"), "e.*").where(at.isNotNull()).withColumn("_bin", F.floor(at / width)), "ends"))
    name = F.xxhash64("qname")
    shared = small(stored(reads.groupBy(name.alias("_name")).agg(F.count("*").alias("_n")).where("_n > 1").select("_name", F.lit(True).alias("_shared")), "names"))
    near = lambda x: (F.col("pos") - margin < x) & (F.col("_end") > x)
    r = reads.withColumns({"_end": reference_end(), "_name": name})
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("pos") - margin) / width), F.floor((F.col("_end") + margin) / width))))
    hit = r.join(ends, ["contig_ord", "_bin"]).where(near(at)).join(shared, "_name", "left")
    keep = [c for c in reads.columns if c not in ("qname", "contig_ord")]
    lone = F.col("_shared").isNull() & ~F.col("_many")
    once = ~F.col("_stop") | ~F.coalesce(near(F.col("_start")), F.lit(False))  # a read at both ends of an event counts at its start
    alone = hit.where(lone & once).select("event", "qname", *keep)
    last = hit.where(~lone).groupBy("event", "qname").agg(F.max(F.struct("pos", "cigar", *[c for c in keep if c not in ("pos", "cigar")])).alias("r"))
    return alone.unionByName(last.select("event", "qname", *[F.col("r")[c].alias(c) for c in keep]))


def allele_context(events: DataFrame, reference: DataFrame, flank: int = 50) -> DataFrame:
    """events (contig_ord, start, stop, kind) with ref_seq and alt_seq: the alleles between flanks.

    Long inversions keep twice the flank at either end; the alternative resumes at the base after stop. Flanks and what is
    between them are fetched as cuts of their own, of a long inversion only its ends.
    """
    key = ["contig_ord", "start", "stop", "kind"]
    a, b = F.col("start").cast("long"), F.col("stop").cast("long")
    long_ = F.coalesce((F.col("kind") == "inv") & (b - a > 3 * flank), F.lit(False))
    part = lambda name, x, y: F.struct(F.lit(name).alias("part"), F.greatest(x, F.lit(0)).alias("start"), F.greatest(y, F.lit(0)).alias("stop"))
    ends = F.array(part("l", a - flank, a), part("r", b + 1, b + 1 + flank))
    inner = F.when(long_, F.array(part("h", a, a + 2 * flank), part("t", b + 1 - 2 * flank, b + 1))).otherwise(F.array(part("m", a, b + 1)))
    one = events.select(*key).distinct()
    cuts = one.select(*[F.col(c).alias(f"_{c}") for c in key], F.explode(F.concat(ends, inner)).alias("p")).select("*", F.col("_contig_ord").alias("contig_ord"), "p.*").drop("p")
    seqs = cut_regions(reference, cuts)
    text = lambda name: F.coalesce(F.max(F.when(F.col("part") == name, F.col("seq"))), F.lit(""))
    own = [f"_{c}" for c in key]
    x = seqs.groupBy(*own).agg(*[text(n).alias(f"_p{n}") for n in "lrhtm"])
    left, right, head, tail, mid = (F.col(f"_p{n}") for n in "lrhtm")
    is_long = F.coalesce((F.col("_kind") == "inv") & (F.col("_stop") - F.col("_start") > 3 * flank), F.lit(False))
    ref = F.when(is_long, F.concat(left, head, tail, right)).otherwise(F.concat(left, mid, right))
    alt = F.when(F.col("_kind") == "del", F.concat(left, right)).when(F.col("_kind") == "dup", F.concat(left, mid, mid, right)).when(is_long, F.concat(left, reverse_complement(tail), reverse_complement(head), right)).otherwise(F.concat(left, reverse_complement(mid), right))
    x = x.select(*[F.col(f"_{c}").alias(c) for c in key], ref.alias("ref_seq"), alt.alias("alt_seq"))
    return events.join(x, key)


def kmers(seq: str, k: int) -> Column:
    """Distinct k-mers of a string column."""
    n = F.length(seq)
    return F.when(n >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col(seq), i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def genotype_by_support(reads: DataFrame, alleles: DataFrame, k: int = 15, margin: int = 10) -> DataFrame:
    """(event, sample_idx, ref_reads, alt_reads, ambiguous, gt): reads at the events (event, ref_seq, alt_seq) by shared k-mers. Reads of one sequence at an event are compared once."""
    n = reads.where("not is_secondary and mapq > 10").groupBy("event", "seq", "sample_idx").agg(F.count("*").alias("n"))
    pairs = n.groupBy("event", "seq").agg(F.collect_list(F.struct("sample_idx", "n")).alias("_by")).withColumn("_k", kmers("seq", k))
    a = small(alleles.select("event", kmers("ref_seq", k).alias("_r"), kmers("alt_seq", k).alias("_a")))
    diff = F.size(F.array_intersect("_k", "_r")) - F.size(F.array_intersect("_k", "_a"))
    s = pairs.join(a, "event").select("event", diff.alias("_d"), F.explode("_by").alias("x")).select("event", "_d", "x.*")
    support = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    n = s.groupBy("event", "sample_idx").agg(support(F.col("_d") > margin).alias("ref_reads"), support(F.col("_d") < -margin).alias("alt_reads"), support(F.abs("_d") <= margin).alias("ambiguous"))
    return n.withColumn("gt", genotype_call("ref_reads", "alt_reads"))


#: Scores of a local alignment: equal bases, different ones, the first base of a gap, each further one; N counts 0 against anything.
MATCH, MISMATCH, GAP, LONGER = 2, -3, 5, 2


def local_scores(reads: list[str], targets: list[str]) -> np.ndarray:
    """The best local alignment score (affine gaps) of each pair of texts: all pairs of the batch step through their tables together, diagonal by diagonal."""
    m, n = max(map(len, reads), default=0), max(map(len, targets), default=0)
    if not m or not n:
        return np.zeros(len(reads), np.int32)
    q = np.zeros((len(reads), m), np.uint8)  # 0: past the end, matches nothing
    t = np.full((len(reads), n + 2 * m), 1, np.uint8)  # 1: outside
    for k, (x, y) in enumerate(zip(reads, targets, strict=True)):
        q[k, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        t[k, m : m + len(y)] = np.frombuffer(y.encode(), np.uint8)
    t, q = t[:, ::-1], np.ascontiguousarray(q)
    shape, low = (len(reads), m + 1), -(1 << 14)
    h1, h2, e, f = np.zeros(shape, np.int16), np.zeros(shape, np.int16), np.full(shape, low, np.int16), np.full(shape, low, np.int16)
    best = np.zeros(len(reads), np.int16)
    for d in range(m + n - 1):  # cell (i, d - i) for all i at once; column i + 1 of a table holds read place i
        other = t[:, n + m - 1 - d : n + 2 * m - 1 - d]  # target places d, d - 1, ..., d - m + 1
        score = np.where(q == other, MATCH, MISMATCH).astype(np.int16)
        score[(q == 78) | (other == 78)] = 0
        score[(q == 0) | (other == 1)] = low // 2
        e = np.maximum(h1 - GAP, e - LONGER)  # gap in the read: same place i, target one before
        f[:, 1:] = np.maximum(h1[:, :-1] - GAP, f[:, :-1] - LONGER)  # gap in the target: place i - 1
        h = np.zeros(shape, np.int16)
        h[:, 1:] = np.maximum(np.maximum(h2[:, :-1] + score, 0), np.maximum(e[:, 1:], f[:, 1:]))
        np.maximum(e, low, out=e)
        np.maximum(f, low, out=f)
        h2, h1 = h1, h
        np.maximum(best, h.max(axis=1), out=best)
    return best.astype(np.int32)


def genotype_by_alignment(reads: DataFrame, alleles: DataFrame, margin: int = 10) -> DataFrame:
    """(event, sample_idx, ref_reads, alt_reads, ambiguous, gt): reads at the events (event, ref_seq, alt_seq) by local alignment.

    A read supports the allele that it or its reverse complement, whichever fits better, scores higher with by more than ``margin``. Reads of
    one sequence at an event are aligned once; the alignments run by ``BATCH`` pairs of about equal length.
    """
    r = reads.where("not is_secondary and mapq > 10 and seq is not null")
    n = stored(r.groupBy("event", "seq", "sample_idx").agg(F.count("*").alias("n")), "sequences")  # reads are met once
    pairs = n.select("event", "seq").distinct().join(alleles.select("event", "ref_seq", "alt_seq").distinct(), "event")
    kind = pairs.schema["event"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, refs, alts = (batch.column(c).to_pylist() for c in ("seq", "ref_seq", "alt_seq"))
            order = np.argsort([max(len(a), len(b)) for a, b in zip(refs, alts, strict=True)], kind="stable")
            out, k = np.zeros(len(seqs), np.int64), 0
            while k < len(order):  # pairs of about equal length together
                take = order[k : k + BATCH]
                texts = [seqs[i] for i in take]
                turned = [s.translate(_TURN)[::-1] for s in texts]
                ref, alt = ([side[i] for i in take] for side in (refs, alts))
                a = np.maximum(local_scores(texts, ref), local_scores(turned, ref))
                b = np.maximum(local_scores(texts, alt), local_scores(turned, alt))
                out[take], k = a - b, k + BATCH
            yield pa.RecordBatch.from_arrays([batch.column("event"), batch.column("seq"), pa.array(out)], names=["event", "seq", "lead"])

    lead = pairs.mapInArrow(run, f"event {kind}, seq string, lead long")
    support = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    x = n.join(lead, ["event", "seq"]).groupBy("event", "sample_idx").agg(support(F.col("lead") > margin).alias("ref_reads"), support(F.col("lead") < -margin).alias("alt_reads"), support(F.abs("lead") <= margin).alias("ambiguous"))
    return x.withColumn("gt", genotype_call("ref_reads", "alt_reads"))


def genotype_call(ref: str, alt: str) -> Column:
    r, a = F.col(ref), F.col(alt)
    return F.when((r == 0) & (a == 0), "./.").when(r > 4 * a, "0/0").when(r < a / 4, "1/1").otherwise("0/1")


def geno_vector(gt: str) -> Column:
    """Number of alternative alleles in a genotype like 0/1."""
    return F.size(F.filter(F.split(gt, "/"), lambda x: x == "1"))
