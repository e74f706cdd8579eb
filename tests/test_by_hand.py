"""Operators that work in ranges, blocks and rounds, against plain loops."""

import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from popweave.functions.ordering import numbered, roots, running_sum
from popweave.operators import intervals, junctions, kmers, popgen, reads, variants
from popweave.sources import readers, writers

TURN = str.maketrans("ACGTN", "TGCAN")


def test_numbers_and_sums_along_an_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(9), i, r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    want = {i: n for n, (_, i, _) in enumerate(sorted(rows), 1)}
    assert {x.i: x.rn for x in numbered(df, ["k", "i"]).collect()} == want
    total, upto = 0, {}
    for _, i, v in sorted(rows):
        total += v
        upto[i] = total
    assert {x.i: x.s for x in running_sum(df, ["k", "i"], "v", "s").collect()} == upto
    assert numbered(df.where("false"), ["k"]).count() == 0


def test_chains_end_at_their_roots(spark):
    links = [(i, i - 1 - i % 3, -1 if i % 2 else 1) for i in range(5, 300)]
    parent = {i: (p, s) for i, p, s in links}
    want = {}
    for i in parent:
        at, sign = i, 1
        while at in parent:
            at, sign = parent[at][0], sign * parent[at][1]
        want[i] = (at, sign)
    got = roots(spark.createDataFrame(links, "id long, parent long, sign int"))
    assert {x.id: (x.root, x.sign) for x in got.collect()} == want


# ---------------------------------------------------------------- k-mers


@pytest.mark.parametrize("k,letters", [(3, "ACGTN"), (9, "AC"), (30, "ACGT"), (4, "ACGTR")])
def test_kmer_edges_by_hand(spark, monkeypatch, k, letters):
    monkeypatch.setattr(kmers, "PLACES", 50)
    monkeypatch.setattr(kmers, "MOST_EDGES", 40)
    r = random.Random(k)
    seqs = ["".join(r.choice(letters) for _ in range(r.randrange(0, 160))) for _ in range(60)] + [None, "", letters[0] * k, letters[0] * (k + 1)]
    forward, backward = Counter(), Counter()
    for s in filter(None, seqs):
        for way, count in ((s, forward), (s.translate(TURN)[::-1], backward)):
            count.update(way[i : i + k + 1] for i in range(len(way) - k))
    want = {(e[:-1], e[1:]): (forward[e], backward[e]) for e in forward | backward}
    got = kmers.kmer_edges(spark.createDataFrame([(s,) for s in seqs], "seq string"), k).collect()
    assert len(got) == len(want) and {(x.src, x.dst): (x.forward, x.backward) for x in got} == want


def test_kmer_windows_take_linear_time():
    r = random.Random(2)
    spent = []
    for n in (100_000, 400_000):
        text = bytes(r.choice(b"ACGT") for _ in range(n))
        begin = time.process_time()
        for _ in range(3):
            kmers._windows([text], 10)
        spent.append(time.process_time() - begin)
    assert spent[1] < 10 * spent[0]


def test_walks_by_hand(spark):
    chain = [(f"a{i:04d}", f"a{i + 1:04d}", 2, 1) for i in range(2100)]
    short = [(f"b{i}", f"b{i + 1}", 2, 1) for i in range(5)] + [("b2", "c0", 9, 0), ("b2", "b9", 5, 4), ("q0", "b3", 1, 1)]
    loop = [("s0", "l0", 1, 0), ("l0", "l1", 1, 0), ("l1", "l0", 1, 0)]
    edges = chain + short + loop
    best = {}
    for s, d, f, b in sorted(edges, key=lambda e: (-(e[2] + e[3]), e[1])):
        best.setdefault(s, d)
    want = {}
    for s in {e[0] for e in edges} - {e[1] for e in edges}:
        at, seq, steps = s, s, 0
        while at in best and steps < 2000:
            at, steps = best[at], steps + 1
            seq += at[-1]
        want[s] = (steps, seq if steps < 2000 else "")
    got = kmers.kmer_paths(spark.createDataFrame(edges, "src string, dst string, forward long, backward long"))
    assert {x.node: (x.steps, x.seq) for x in got.collect()} == want
    assert want["s0"] == (2000, "") and want["a0000"] == (2000, "") and want["b0"][0] == 3


def test_suppression_with_ties_and_long_runs(spark):
    r = random.Random(4)
    rows = [(0, 10, 500 + i, "del") for i in range(120)]  # one start, many stops: a long run is leapt over
    rows += [(0, 100 + 9 * i, 4000, r.choice(["del", "inv"])) for i in range(120)]  # one stop, many starts
    rows += [(1, a := r.randrange(60), a + r.randrange(30), r.choice(["inv", "del", None])) for _ in range(300)] + [(2, 5, 9, "inv")] * 3
    key = lambda e: (e[0], e[1], e[2], e[3] is not None, e[3] or "")
    want, last = [], {}
    for c, a, b, k in sorted(rows, key=key):
        p = last.get(c)
        if p and (abs(a - p[0]) <= 5 or abs(b - p[1]) <= 5) and not (k == "inv" and p[2] != "inv"):
            continue
        last[c] = (a, b, k)
        want.append((c, a, b, k))
    got = kmers.suppress_overlaps(spark.createDataFrame(rows, "contig_ord long, start long, stop long, kind string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert kmers.suppress_overlaps(got.where("false")).count() == 0


# ---------------------------------------------------------------- populations


@pytest.mark.parametrize("block,at_once", [(4, 7), (256, 4096), (3, 1000)])
def test_pair_counts_in_blocks(spark, block, at_once):
    r = random.Random(block)
    cells = {(s, i * 7): r.choice([0, 1, 1, 2, None]) for s in range(40) for i in range(11) if r.random() < 0.8}
    df = spark.createDataFrame([(s, i, n) for (s, i), n in cells.items()], "site_id long, sample_idx int, n int")
    want = defaultdict(lambda: [0] * 6)
    for s in range(40):
        here = sorted((i, n) for (t, i), n in cells.items() if t == s and n is not None)
        for a, (i, x) in enumerate(here):
            for j, y in here[a + 1 :]:
                for k, v in enumerate((1, abs(x - y), x == y == 1, abs(x - y) == 2, x == 1, y == 1)):
                    want[i, j][k] += v
    got = popgen.pair_counts(df, block, at_once).collect()
    assert len(got) == len(want) and {(x.i, x.j): [x.n, x.d, x.both, x.opposite, x.hi, x.hj] for x in got} == dict(want)
    assert popgen.pair_counts(df.where("false")).count() == 0


def test_moving_average_across_blocks(spark):
    r = random.Random(3)
    rows = [(c, n, float(r.randrange(100))) for c, n in zip([0] * 700 + [1] * 30 + [2] * 650, range(1, 1381), strict=True)]
    value = {n: (c, v) for c, n, v in rows}
    got = popgen.moving_average(spark.createDataFrame(rows, "contig_ord int, rn long, q double"), "q", 4).collect()
    assert len(got) == len(rows)
    for x in got:
        near = [value[m][1] for m in range(x.rn - 2, x.rn + 2) if m in value and value[m][0] == x.contig_ord]
        assert x.smooth == pytest.approx(sum(near) / len(near))


def phase_by_hand(sites, sides, window):
    """{site: (block, left)} from sites in order, {site: {progeny: side}}."""
    out, blocks = {}, 0
    for k, s in enumerate(sites):
        best = None
        for p in sites[max(0, k - window) : k]:
            net = sum(1 if sides[s][i] == sides[p][i] else -1 for i in sides[s].keys() & sides[p].keys())
            if net and (best is None or abs(net) >= abs(best[1])):
                best = (p, net)
        if best is None:
            blocks += 1
            out[s] = (blocks, 0)
        else:
            b, left = out[best[0]]
            out[s] = (b, left ^ (best[1] < 0))
    return out


def test_parent_phase_over_gaps_and_errors(spark):
    r = random.Random(8)
    rows, sides, orders = [], {}, {}
    for c in (0, 1):
        way = [r.randrange(2) for _ in range(12)]  # which side each progeny inherited; changes seldom
        for k in range(60):
            s, flip = 1000 * c + k, r.randrange(2)
            way = [w ^ (r.random() < 0.01) for w in way]
            orders[s] = flip
            sides[s] = {}
            rows += [(s, 0, 0, 1), (s, 1, 0, 0)]
            for i, w in enumerate(way):
                if 20 <= k < 24 and i > 1 or r.random() < 0.3 or c and 30 <= k < 57:  # few calls; on contig 1 a gap wider than the window
                    continue
                a = w ^ flip ^ (k == 9 and r.random() < 0.4) ^ (r.random() < 0.02)  # site 9 is full of errors
                sides[s][i] = a
                rows.append((s, 2 + i, a, 0))
    g = spark.createDataFrame(rows, "site_id long, sample_idx long, a1 int, a2 int")
    sites = spark.createDataFrame([(s, s // 1000, 10 * s) for s in orders], "site_id long, contig_ord long, pos long")
    phased = variants.phase_progeny(g, 0, 1)
    got = {x.site_id: (x.block, x.left) for x in variants.phase_parents(phased, g, sites, 0, "maternal").collect()}
    want = {s: v for c in (0, 1) for s, v in phase_by_hand([s for s in sorted(orders) if s // 1000 == c], sides, 25).items()}
    assert got == want
    first = [s for s in sorted(orders) if s < 1000 and got[s][0] == 1 and s != 9]
    assert len(first) >= 55 and sum((got[s][1] ^ orders[s]) == (got[first[0]][1] ^ orders[first[0]]) for s in first) >= len(first) - 2
    counts = {x.size: x.n_phased for x in variants.phase_subsets(phased, g, sites, 0, "maternal", [1, 5, 12]).collect()}
    for n in counts:
        ends, some = set(), {s: {i: a for i, a in v.items() if i < n} for s, v in sides.items()}
        for c in (0, 1):
            at = [s for s in sorted(orders) if s // 1000 == c]
            for k, s in enumerate(at):
                nets = [(abs(net), k2, p) for k2, p in enumerate(at[max(0, k - 25) : k]) if (net := sum(1 if some[s][i] == some[p][i] else -1 for i in some[s].keys() & some[p].keys()))]
                if nets:
                    ends |= {s, max(nets)[2]}
        assert counts[n] == len(ends)


# ---------------------------------------------------------------- intervals, sequences, alignments


def test_labels_of_nested_and_long_intervals(spark):
    r = random.Random(6)
    iv = [(c, k, f"i{k}", a := r.randrange(3000), a + r.choice([0, 1, 2, 40, 2500, 70_000])) for k in range(150) for c in (k % 2,)]
    points = [(c, p) for c in (0, 1, 2) for p in [*range(0, 3200, 7), 17, 17, 69_999, 80_000]] + [(0, None)]
    got = intervals.interval_label(spark.createDataFrame(points, "contig_ord int, pos long"), spark.createDataFrame(iv, "contig_ord int, interval_ord int, interval_name string, out_start long, out_stop long"))

    def label(c, p):
        inside = [(k, name) for d, k, name, a, b in iv if p is not None and d == c and a < p < b]
        return max(inside)[1] if inside else "Normal"

    assert sorted(map(str, [tuple(x) for x in got.collect()])) == sorted(str((c, p, label(c, p))) for c, p in points)


def test_fasta_in_any_splits(spark, tmp_path):
    r = random.Random(7)
    contigs = [(f"c{k}", "".join(r.choice("ACGTN") for _ in range(n))) for k, n in enumerate([0, 1, 59, 60, 61, 5000, 0, 123, 2000])]
    (tmp_path / "a.fa").write_text("stray\n" + "".join(f">{c} about > it\n" + "".join(f"{s[i:i + 60]}\n" for i in range(0, len(s), 60)) for c, s in contigs))
    (tmp_path / "b.fa").write_text(">c1\nAC GT\r\n\n  A\n>long\n" + contigs[5][1] + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = readers.scan_fasta(spark, str(tmp_path)).collect()
        pieces = readers.scan_fasta_pieces(spark, str(tmp_path), 500)
        assert pieces.rdd.getNumPartitions() >= 1 and readers._fasta_lines(spark, str(tmp_path)).where("value is null").count() == 11
        pieces = pieces.collect()
        cut = readers.region_slice(readers.scan_fasta_pieces(spark, str(tmp_path / "a.fa"), 500), spark.createDataFrame([("c5", 480, 1210)], "contig string, start long, stop long")).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [*contigs, ("c1", "ACGTA"), ("long", contigs[5][1])]
    assert sorted((x.contig, x.seq, x.contig_len) for x in got) == sorted((c, s, len(s)) for c, s in want)
    seqs = defaultdict(list)
    for x in pieces:
        assert len(x.seq) < 1000
        seqs[x.file, x.head, x.contig].append((x.start, x.seq))
    joined = []
    for (_, _, c), parts in seqs.items():
        text = ""
        for start, seq in sorted(parts):
            assert start == len(text)
            text += seq
        joined.append((c, text))
    assert sorted(joined) == sorted((c, s) for c, s in want if s)
    assert cut.seq == contigs[5][1][480:1210]


def score_by_hand(q, t):
    """Smith, Waterman and Gotoh, cell by cell."""
    low = -10_000
    h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    e = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    f = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
    best = 0
    for i, a in enumerate(q, 1):
        for j, b in enumerate(t, 1):
            e[i][j] = max(h[i][j - 1] - 5, e[i][j - 1] - 2)
            f[i][j] = max(h[i - 1][j] - 5, f[i - 1][j] - 2)
            s = 0 if "N" in (a, b) else 2 if a == b else -3
            h[i][j] = max(0, h[i - 1][j - 1] + s, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_local_alignment_scores():
    r = random.Random(9)
    pairs = [("", "ACGT"), ("ACGT", ""), ("A", "A"), ("ACGT", "TTTT"), ("NNNN", "ACGT")]
    for _ in range(60):
        t = "".join(r.choice("ACGT") for _ in range(r.randrange(1, 60)))
        q = list(t[r.randrange(len(t)) :][:25]) or ["A"]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(q) + 1)
            q[k : k + r.randrange(3)] = [r.choice("ACGTN") for _ in range(r.randrange(3))]
        pairs.append(("".join(q), t))
    got = junctions.local_scores([q for q, _ in pairs], [t for _, t in pairs])
    assert got.tolist() == [score_by_hand(q, t) for q, t in pairs]


def test_turned_reads_support_an_inversion(spark):
    r = random.Random(10)
    text = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    left, mid, right = text(50), text(120), text(50)
    turned = mid.translate(TURN)[::-1]
    ref, alt = left + mid + right, left + turned + right
    reads = [("e", 1, ref[20:90]), ("e", 1, ref[20:90]), ("e", 2, alt[20:90]), ("e", 2, alt[20:90].translate(TURN)[::-1]), ("e", 2, left), ("e", 3, None)]
    df = spark.createDataFrame([(*x, False, 60) for x in reads], "event string, sample_idx int, seq string, is_secondary boolean, mapq int")
    got = junctions.genotype_by_alignment(df, spark.createDataFrame([("e", ref, alt)], "event string, ref_seq string, alt_seq string")).collect()
    assert sorted((x.sample_idx, x.ref_reads, x.alt_reads, x.ambiguous, x.gt) for x in got) == [(1, 2, 0, 0, "0/0"), (2, 0, 2, 1, "1/1")]


def test_marked_segment(spark):
    genome = spark.createDataFrame([(0, 0, "ACGTACGTAC"), (0, 10, "GGGTTTCCCA")], "contig_ord int, start long, seq string")
    d = spark.createDataFrame([(0, 8, 13)], "c1 int, p1 long, p2 long")
    assert junctions.with_marked_segment(d, genome, 4).first().context == "ACGT[ACGGG]TTTC"
    assert junctions.with_marked_segment(d, genome, 400).select(F.length("context")).first()[0] == 22


# ---------------------------------------------------------------- reads, tiles, registries


def test_quality_sums(spark):
    quals = ["", "!", "I" * 50, None, "!~" * 20, "5"]
    got = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, q string").select("i", reads.quality_sum("q").alias("s"), reads.mean_phred("q").alias("m")).collect()
    for x in got:
        q = quals[x.i]
        total = None if q is None else sum(ord(c) - 33 for c in q)
        assert x.s == total and x.m == (None if not q else pytest.approx(total / len(q)))


def test_pileup_by_hand(spark):
    r = random.Random(12)
    rows = [(0, 5, "3M2D2M1I2M", "ACGTACGT"), (0, 5, "4S4M", "ACGTACGT"), (0, 5, "4S4M", "ACGTACGT"), (1, 1 << 33, "2M", "AC"), (2, 3, None, "AC"), (2, 3, "5M", "AC"), (2, 3, "2S", "AC")]
    for _ in range(200):
        ops = [(r.randrange(1, 6), "M")]
        for _ in range(r.randrange(3)):
            ops += [(r.randrange(1, 4), r.choice("IDN")), (r.randrange(1, 6), r.choice("M=X"))]
        size = sum(n for n, o in ops if o in "MI=X")
        rows.append((r.randrange(2), r.randrange(30), "".join(f"{n}{o}" for n, o in ops), "".join(r.choice("ACGT") for _ in range(size))))
    want = Counter()
    for c, pos, cigar, seq in rows:
        ops, at, k = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNS=X])", cigar or "")], pos, 0
        for i, (n, o) in enumerate(ops):
            if o in "M=X":
                for j in range(n):
                    after = ""
                    if j == n - 1 and i + 1 < len(ops):
                        m, p = ops[i + 1]
                        after = f"-{m}" if p in "DN" else seq[k + n : k + n + m] if p == "I" else ""
                    if k + j < len(seq):
                        want[c, at + j, seq[k + j] + after] += 1
            at += n if o in "MDN=X" else 0
            k += n if o in "MIS=X" else 0
    df = spark.createDataFrame(rows, "contig_ord int, pos long, cigar string, seq string")
    got = {(x.contig_ord, x.pos, x.shown): x.n for x in reads.pileup_bases(df.where("seq <> 'AC' or cigar <> '5M' or cigar is null")).collect()}
    assert got == {k: v for k, v in want.items() if k[0] != 2}
    assert {(x.pos, x.shown) for x in reads.pileup_bases(df.where("cigar = '5M' and seq = 'AC'")).collect()} == {(3, "A"), (4, "C")}
    assert reads.pileup_bases(df.where("false")).count() == 0
    nothing = spark.createDataFrame([(None, 3, "2M", "AC"), (0, None, "2M", "AC"), (0, 3, "2M", None), (0, 3, "*", "AC"), (0, 3, "2M", "")], df.schema)
    assert reads.pileup_bases(nothing).count() == 0
    batch = pa.RecordBatch.from_pylist([{"contig_ord": c, "pos": p, "cigar": g, "seq": s} for c, p, g, s in rows if g])
    for most in (1, 7, 100, 1 << 20):  # slices and counts that are passed on early change nothing
        counted = Counter()
        for part in reads._counted_bases(iter([batch, batch.slice(5, 60)]), most):
            for x in part.to_pylist():
                counted[x["contig_ord"], x["pos"], x["shown"]] += x["n"]
        once = Counter()
        for part in (batch, batch.slice(5, 60)):
            for x in (y for b in reads._counted_bases(iter([part])) for y in b.to_pylist()):
                once[x["contig_ord"], x["pos"], x["shown"]] += x["n"]
        assert counted == once


def test_alignment_tiles(spark, tmp_path):
    r = random.Random(13)
    sites = [(s, s % 2, r.randrange(1000), "A", r.choice("CGT")) for s in range(40)]
    cells = {(s, i): r.choice([(0, 0), (0, 1), (1, 1), (None, None)]) for s in range(40) for i in (3, 5, 8) if r.random() < 0.8}
    g = spark.createDataFrame([(s, i, *a) for (s, i), a in cells.items()], "site_id long, sample_idx int, a1 int, a2 int")
    st = spark.createDataFrame(sites, "site_id long, contig_ord int, pos long, ref string, alt string")
    panel = spark.createDataFrame([(3,), (5,), (8,), (9,)], "sample_idx int")
    kept = {s for s in range(40) if sum(cells.get((s, i), (None,))[0] is not None for i in (3, 5, 8)) >= 2}
    codes = {"CC": "C", "AA": "A", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W"}

    def text(i, c):
        out = ""
        for s, _, _, ref, alt in sorted((x for x in sites if x[0] in kept and x[1] == c), key=lambda x: (x[2], x[0])):
            a = cells.get((s, i), (None, None))
            out += "N" if a[0] is None else codes["".join(sorted((ref, alt)[x] for x in a))]
        return out

    tiles = variants.iupac_tiles(g, st, 2, panel, 7).withColumn("sample", F.col("sample_idx").cast("string"))
    assert max(len(x.sequence) for x in tiles.collect()) <= 7
    whole = {(x.sample_idx, x.contig_ord): x.sequence for x in variants.iupac_matrix(g, st, 2, panel).collect()}
    assert whole == {(i, c): text(i, c) for i in (3, 5, 8, 9) for c in (0, 1)}
    writers.write_phylip(tiles, str(tmp_path / "p"))
    joined = defaultdict(str)
    for x in readers.scan_phylip(spark, str(tmp_path / "p")).orderBy("tile").collect():
        joined[x.sample] += x.sequence
    assert dict(joined) == {str(i): text(i, 0) + text(i, 1) for i in (3, 5, 8, 9)}
    assert spark.read.text(str(tmp_path / "p/header")).first()[0] == f"4 {len(kept)}"


def test_registry_commits(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "Run string, n int")
    runs = lambda: sorted(x.Run for x in writers.read_registry(spark, path).collect())
    assert writers.read_registry(spark, path) is None
    writers.append_registry(rows("a", "b", "b", None), path, "one", "Run")
    writers.append_registry(rows("b", "c"), path, "two", "Run")
    writers.append_registry(rows("b", "c"), path, "two", "Run")  # the same job again
    assert runs() == ["a", "b", "c"]
    rows("x").write.parquet(f"{path}/batches/job=broken")  # a job that broke off before its commit
    assert runs() == ["a", "b", "c"]
    writers.append_registry(rows("x", "y"), path, "broken", "Run")
    assert runs() == ["a", "b", "c", "x", "y"]


def test_density_and_coverage(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.06), ("a", 0.15), ("b", -0.05), ("b", None)], "h string, v double")
    assert {(x.h, x.bin): round(x.density, 6) for x in popgen.hist_density(df, "v", "h").collect()} == {("a", 0): 6.666667, ("a", 1): 3.333333, ("b", -1): 10.0}
    r = spark.createDataFrame([(False,), (True,), (False,)], "is_unmapped boolean")
    assert reads.mean_coverage(r, spark.createDataFrame([(100,), (300,)], "contig_len long"), 50.0).first().coverage == 0.25


def test_depths_where_reads_cross_bins_and_sites_repeat(spark):
    r = random.Random(11)
    rows = [(r.choice(["a", "b", None]), 0, r.randrange(60), c, "".join(r.choice("ACGT") for _ in range(r.choice([20, 20, 4]))), 1) for c in ("20M", "3S8M2D9M", "5M3I12M") for _ in range(40)]
    rows += [("a", 0, 30, "20M", None, 1), ("a", None, 30, "20M", "A" * 20, 1)]
    sites = [(0, p, x, y) for p in (9, 10, 19, 20, 35) for x, y in (("A", "C"), ("A", "C"), ("G", "AAC"))]
    want = defaultdict(lambda: [0, 0])
    for key, contig, pos, cigar, seq, _ in rows:
        if seq is None or contig is None:
            continue
        at, ref = 0, pos
        for n, op in re.findall("([0-9]+)([MIDS])", cigar):
            for k in range(int(n)) if op == "M" else ():
                for _, p, x, y in sites:
                    if p == ref + k:
                        d = want[p, key]
                        d[0] += seq[at + k : at + k + 1] == x
                        d[1] += seq[at + k : at + k + 1] == y
            at, ref = at + (int(n) if op in "MIS" else 0), ref + (int(n) if op in "MD" else 0)
    df = spark.createDataFrame(rows, "s string, contig_ord int, pos long, cigar string, seq string, x int")
    places = spark.createDataFrame(sites, "contig_ord int, pos long, ref string, alt string")
    got = reads.site_allele_depths(df, places, "s", 10).collect()
    assert {(x.pos, x.s): [x.ad_ref, x.ad_alt] for x in got} == dict(want) and len(got) == len(want)
    full = {(x.pos, x.shown): x.n for x in reads.pileup_bases(df).collect()}
    some = {(x.pos, x.shown): x.n for x in reads.pileup_bases(df, places, 10).collect()}
    assert some == {k: n for k, n in full.items() if k[0] in (9, 10, 19, 20, 35)}


def test_equal_sites_do_not_multiply_bases(spark):
    df = spark.createDataFrame([(k % 2, 0, 0, "50M", "A" * 50) for k in range(400)], "s int, contig_ord int, pos long, cigar string, seq string")
    sites = spark.createDataFrame([(0, 7, "A", "C")] * 300, "contig_ord int, pos long, ref string, alt string")
    out = reads.site_allele_depths(df, sites, "s")
    assert sorted(map(tuple, out.collect())) == [(0, 7, 0, 60_000, 0), (0, 7, 1, 60_000, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("MapInArrow")  # counted before the join


def test_coverage_and_ends_by_hand(spark):
    r = random.Random(21)
    size = {"20M": 20, "5M3D9M2S": 17, "7S1M": 1, "4S": 1}
    rows = [(f"q{i}", r.choice([0, 1, 1, None]), r.choice([r.randrange(3000), 40, None]), r.choice(list(size)), r.random() < 0.1, False, r.randrange(2)) for i in range(300)]
    df = spark.createDataFrame(rows, "qname string, contig_ord int, pos long, cigar string, is_unmapped boolean, is_secondary boolean, mapq int")
    regions = [(f"r{i % 45}", r.choice([0, 1, 2]), a := r.choice([r.randrange(3000), 40]), a + r.choice([0, 1, 60, 2500])) for i in range(50)] + [("none", 1, 60, 20), ("null", 1, None, 5), ("long", 1, 0, 10_001)]
    spans = [(c, p, p + size[g]) for _, c, p, g, *_ in rows if c is not None and p is not None]
    n, bases = Counter(), Counter()
    for x, c, a, b in regions:
        for d, p, e in spans if a is not None and a <= b else ():
            if c == d and p < b + 1 and e > a:
                n[x] += 1
                bases[x] += min(e, b + 1) - max(p, a)
    want = sorted((x, None if a is None else n[x] * 9.0 / (b - a + 1) if b - a > 10_000 else bases[x] / (b - a + 1)) for x, _, a, b in regions)
    out = reads.mean_coverage_region(df, spark.createDataFrame(regions, "region string, contig_ord int, start long, stop long"), 9.0)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert "_bin" not in out._jdf.queryExecution().optimizedPlan().toString()  # reads and regions never meet pair by pair
    sites = [(i % 25, r.choice([0, 1]), r.choice([r.randrange(3000), 45])) for i in range(30)]
    near, clipped = {}, Counter()
    for i, c, at in sites:
        for _, d, p, g, unmapped, _, q in rows:
            if c == d and p is not None and p <= at < p + size[g] and not unmapped and q:
                near[i] = min(near.get(i, 99), at - p, p + size[g] - 1 - at)
                clipped[i] += "S" in g
    out = reads.read_end_distance(df, spark.createDataFrame(sites, "site_id int, contig_ord int, pos long"))
    assert {x.site_id: (x.least_distance, x.clipped) for x in out.collect()} == {i: (d, clipped[i]) for i, d in near.items()}
    assert "_end" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "max(_end" in plan  # one read per beginning, one per end


def test_mates_are_found_before_sites(spark):
    r = random.Random(22)
    rows = [(f"q{r.randrange(60)}", r.randrange(2), r.randrange(900), "20M", r.random() < 0.5, r.choice([0, 1, None]), r.randrange(900), r.choice(["ACCN", "GT", None])) for _ in range(250)]
    rows += [(f"q{i}", 0, 30 + i % 3, "20M", i % 2 == 0, 0, 31, "ACG") for i in range(60)]
    sites = [(i, r.randrange(2), r.choice([r.randrange(900), 40])) for i in range(20)]
    want = Counter()
    for i, c, at in sites:
        for q, d, p, _, turned, mc, mp, _ in rows:
            low, high = (at, at + 250) if turned else (max(at - 250, 0), at)
            if c == d and p < high and p + 20 > low:
                for q2, d2, p2, _, t2, _, _, s in rows:
                    if q2 == q and d2 == mc and abs(p2 - mp) <= 1:
                        want[i, q, None if s is None else s if t2 != turned else s.translate(TURN)[::-1]] += 1
    df = spark.createDataFrame(rows, "qname string, contig_ord int, pos long, cigar string, is_reverse boolean, next_contig_ord int, next_pos long, seq string")
    out = reads.mate_lookup(df, spark.createDataFrame(sites, "site_id int, contig_ord int, pos long"))
    assert Counter(map(tuple, out.collect())) == want
    assert "_bin" in next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)


@pytest.mark.parametrize("block,beyond", [(4, 1), (16, 8), (1 << 16, 1 << 13)])
def test_suppression_in_blocks(spark, monkeypatch, block, beyond):
    monkeypatch.setattr(kmers, "BLOCK", block)
    monkeypatch.setattr(kmers, "BEYOND", beyond)
    r = random.Random(block)
    rows = [(c, a := r.choice([r.randrange(200), None]), None if a is None else a + r.randrange(30), r.choice(["inv", "del", None])) for c in (0, 1, 1, 2, None) for _ in range(25)]
    rows += [(3, a, 900 + a % 3, "del") for a in range(0, 240, 7)] + [(3, 300, None, "del"), (3, 302, 7, "del"), (3, 400, 7, "inv")] + [(4, 3, 9, "del")] * 5
    key = lambda e: [x for v in e for x in (v is not None, v if v is not None else 0)]
    want, last = [], {}
    for e in sorted({(c, a, b, k == "inv"): (c, a, b, k) for c, a, b, k in sorted(rows, key=lambda e: [str(x) for x in (e[3] is not None, e[3])], reverse=True)}.values(), key=lambda e: key(e[:3]) + [e[3] is not None, e[3] or ""]):
        c, a, b, k = e
        p = last.get(c) if c is not None else None
        if p and ((None not in (a, p[1]) and abs(a - p[1]) <= 5) or (None not in (b, p[2]) and abs(b - p[2]) <= 5)) and not (k == "inv" and p[3] != "inv"):
            continue
        last[c] = e
        want.append(e)
    got = kmers.suppress_overlaps(spark.createDataFrame(rows, "contig_ord long, start long, stop long, kind string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_genes_of_one_name_are_dealt_to_parts(spark):
    genes = [(i, "a" if i < 900 else "b" if i < 950 else None if i % 2 else "c") for i in range(1000)]
    others = [(i, "a" if i < 20 else "b" if i < 30 else "z" if i < 40 else None) for i in range(50)]
    g = spark.createDataFrame(genes, "gene_id int, gene_name string")
    o = spark.createDataFrame(others, "ortholog_id int, ortholog_name string")
    want = Counter((i, n, j, n) for i, n in genes for j, m in others if n is not None and n == m) + Counter((i, n, None, None) for i, n in genes if n not in ("a", "b"))
    out = intervals.left_join_genes(g, o, 50)
    assert Counter((x.gene_id, x.gene_name, x.ortholog_id, x.ortholog_name) for x in out.collect()) == want
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(intervals.left_join_genes(g, o).groupBy().count().first()) == sum(want.values())


@pytest.mark.parametrize("most", [1, 3, 50, 8000])
def test_genes_and_orthologs_of_one_name_meet_in_blocks(spark, most):
    # no hash table of a name's orthologs; blocks of names with identical rows, without orthologs, without genes, and empty blocks
    genes = [(i, "a" if i < 90 else "b" if i < 95 else "c" if i < 160 else None if i % 2 else "d") for i in range(200)] + [(7, "a")] * 3
    others = [(i, "a" if i < 4 else "b" if i < 60 else "z" if i < 90 else None) for i in range(100)] + [(5, "b")] * 60 + [(None, "a")]
    g = spark.createDataFrame(genes, "gene_id int, gene_name string")
    o = spark.createDataFrame(others, "gene_id int, ortholog_name string")
    want = Counter((i, n, j, n) for i, n in genes for j, m in others if n is not None and n == m) + Counter((i, n, None, None) for i, n in genes if n not in ("a", "b"))
    out = intervals.left_join_genes(g, o, most)
    assert Counter(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "ShuffledHashJoin" not in plan
    same = g.select(F.col("gene_name").alias("ortholog_name"), F.col("gene_id").alias("ortholog_id"))
    assert intervals.left_join_genes(g, same, most).count() == sum(k * k for k in Counter(n for _, n in genes if n).values()) + sum(n is None for _, n in genes)
    assert intervals.left_join_genes(g, o.where("false"), most).count() == len(genes) and intervals.left_join_genes(g.where("false"), o, most).count() == 0


def test_reads_of_lone_and_shared_names_at_events(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # a shuffle leaves its partitions
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    # lone names are not shuffled; shared ones give their last read; a read at both ends counts once
    rows = [(q, 0, p, "50M", i) for i, (q, p) in enumerate([("a", 100), ("b", 130), ("b", 140), ("c", 100), ("d", 1990), ("a2", 5000), (None, 120), (None, 125)])]
    rd = spark.createDataFrame(rows, "qname string, contig_ord int, pos long, cigar string, i int")
    ev = spark.createDataFrame([("e", 0, 120, 140), ("f", 0, 2000, 2010), ("g", 0, 130, 9000), ("g", 0, 131, 9000), ("h", 0, None, 5010)], "event string, contig_ord int, start long, stop long")
    want = {}
    for q, _, p, _, i in rows:
        for e, _, a, b in ((r.event, 0, r.start, r.stop) for r in ev.collect()):
            if any(x is not None and p - 5 < x < p + 50 for x in (a, b)):
                want[e, q] = max(want.get((e, q), (0, 0)), (p, i))
    got = junctions.reads_at_breakpoint(rd, ev)
    assert sorted((str(r.qname), r.event, r.pos, r.i) for r in got.collect()) == sorted((str(q), e, *v) for (e, q), v in want.items())
    lone = rd.where("qname in ('a', 'c', 'd')").coalesce(1)
    plan = junctions.reads_at_breakpoint(lone, ev.where("event = 'e'"))
    assert len({r[0] for r in plan.select(F.spark_partition_id(), "qname").collect()}) == 1  # both stay in the one partition of the reads


def test_edges_in_small_batches(spark, monkeypatch):
    # windows merge as they come and are passed on in batches of a few rows: the same counts
    for name, value in (("PLACES", 64), ("MOST_EDGES", 200), ("EDGE_ROWS", 7)):
        assert getattr(kmers, name) > value
        monkeypatch.setattr(kmers, name, value)
    r = random.Random(12)
    seqs = ["".join(r.choice("ACGTN") for _ in range(n)) for n in (3, 5, 700, 90)] + ["ACGT" * 200, None]
    want = Counter(x[i : i + 5] for s in seqs if s for x in (s,) for i in range(len(x) - 4))
    got = kmers.kmer_edges(spark.createDataFrame([(s,) for s in seqs], "seq string"), 4).where("forward > 0").collect()
    assert {x.src + x.dst[-1]: x.forward for x in got} == dict(want)


def test_writers_work_their_rows_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    ev = spark.createDataFrame([(i, "c1", i, "A", "C", i, i + 1, "del") for i in range(40)], "event int, contig string, pos int, ref string, alt string, start int, stop int, svtype string")
    calls = spark.createDataFrame([(i, s, "0/1", i, 1, 0) for i in range(0, 40, 2) for s in "ace"] + [(0, "a", "0/0", 9, 9, 9)], "event int, sample string, gt string, rr int, ar int, br int").repartition(3)
    writers.write_vcf(ev, calls.withColumn("gt", counted("gt")), [("c1", 99)], list("abcde"), "d", str(tmp_path / "v"))
    assert seen.value == 61
    _, back = readers.scan_vcf(spark, str(tmp_path / "v/*"))
    cells = {(x.pos + 1, x["sample"]): x.fields["GT"] + ":" + x.fields["RR"] for x in back.collect()}
    want = {(i, s): f"0/1:{i}" if i % 2 == 0 and s in "ace" else "./.:0" for i in range(40) for s in "abcde"}
    assert cells == want | {(0, "a"): "0/0:9"}
    tiles = spark.createDataFrame([(t, s, "ACGT") for t in range(9) for s in "ab"], "tile long, sample string, sequence string").repartition(3)
    writers.write_phylip(tiles.withColumn("sequence", counted("sequence")), str(tmp_path / "p"))
    assert seen.value == 61 + 18
