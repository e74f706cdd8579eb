"""Hand-made fixtures for readers, writers, junction parsing, and stateful operators."""

import random

import pytest

from popweave.operators import junctions as J
from popweave.operators import kmers, popgen, reads, registry, variants
from popweave.sources import readers as S
from popweave.sources import writers as K
from popweave.streaming.register import new_runs, register_runs_stream


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_run_table_quotes_and_escapes(spark, tmp_path):
    path = put(tmp_path, "runs.csv", 'Run,Bases,Types,Center,Files\nR1,31415926535,"sra,bam","northern lab\\, x",a_1.fq,,a_2.fq\n'.replace("a_1.fq,,a_2.fq", '"a_1.fq,,a_2.fq"'))
    r = S.scan_csv(spark, path, "Run string, Bases long, Types string, Center string, Files string").withColumn("Files", S.split_files()).first()
    assert (r.Bases, r.Types, r.Files) == (31415926535, "sra,bam", ["a_1.fq", "a_2.fq"]) and r.Center.endswith(", x")


def test_vcf(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tb\ta\n" "c1\t10\t.\tA\tG,T\t50\tPASS\tDP=7;AC=1\tGT:AD\t0/1:3,4\t./.\n" "c1\t20\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=99\tGT\t1/1\t0/0\n"
    sites, calls = S.scan_vcf(spark, put(tmp_path, "x.vcf", text))
    a, b = sites.orderBy("pos").collect()
    assert (a.pos, a.alt, a.info["DP"], a.qual, a.stop) == (9, ["G", "T"], "7", 50.0, 10)
    assert (b.pos, b.svtype, b.stop, b.qual) == (19, "DEL", 99, None)
    got = {(r.pos, r["sample"]): r.fields for r in calls.collect()}
    assert got[9, "b"] == {"GT": "0/1", "AD": "3,4"} and got[9, "a"] == {"GT": "./.", "AD": "."} and got[19, "a"] == {"GT": "0/0"}


def test_sam_and_fetch(spark, tmp_path):
    text = "@HD\tx\nq1\t83\tc1\t101\t60\t30M70S\t=\t301\t-200\tACGT\t!!!!\tSA:Z:c1,5,+,30S70M,60,0;\tXM:i:3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t!\n"
    r = S.scan_sam(spark, put(tmp_path, "x.sam", text))
    a = r.where("qname = 'q1'").first()
    assert (a.pos, a.next_contig, a.is_reverse, a.is_proper_pair, a.is_unmapped, a.tags) == (100, "c1", True, True, False, {"SA": "c1,5,+,30S70M,60,0;", "XM": "3"})
    assert [x.qname for x in S.fetch(r, "c1", 129, 140).collect()] == ["q1"] and S.fetch(r, "c1", 130, 140).count() == 0


def test_sam_query_writes_compressed_text(spark, monkeypatch):
    import glob

    from oracle import SF
    from popweave.plans import io_queries

    monkeypatch.setattr(io_queries, "shared_dir", lambda s, f=io_queries.shared_dir: made.append(f(s)) or made[-1])
    made: list[str] = []
    assert io_queries.C.queries["scan_sam"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    files = glob.glob(f"{made[0].removeprefix('file://')}/sam/part-*")
    assert files and all(f.endswith(".txt.gz") for f in files)


def test_fastq_pair_with_an_empty_mate(spark, tmp_path):
    one = put(tmp_path, "a.fq", "@r1 x\nACGT\n+\n!!!!\n@r2\n\n+\n\n@r3\nA\n+\n!\n")
    two = put(tmp_path, "b.fq", "@r1 y\nCC\n+\n!!\n@r2\nGG\n+\n!!\n@r3\nT\n+\n!\n")
    rows = reads.filter_nonempty_pairs(S.scan_fastq_pair(spark, one, two)).orderBy("record_no").collect()
    assert [(r.name1, r.seq1, r.name2, r.seq2) for r in rows] == [("r1 1:N:0:2", "ACGT", "r1 2:N:0:2", "CC"), ("r3 1:N:0:2", "A", "r3 2:N:0:2", "T")]


def test_fastq_in_many_splits(spark, tmp_path):
    text = "".join(f"@r{i}\n{'ACGT'[i % 4] * 40}\n+\n{'!' * 40}\n" for i in range(500))
    path = put(tmp_path, "big.fq", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = S.scan_fastq(spark, path).orderBy("record_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.record_no, r.name, r.seq) for r in rows] == [(i, f"r{i}", "ACGT"[i % 4] * 40) for i in range(500)]


def test_records_stay_where_they_are_read(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # a shuffle leaves its partitions
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    (tmp_path / "gz").mkdir()
    df = spark.range(0, 400, 1, 1).selectExpr("concat('@r', id, '/1\n', repeat('ACGT', 9), '\n+\n', repeat('!', 36)) as value")
    df.write.option("compression", "gzip").option("maxRecordsPerFile", 90).text(str(tmp_path / "gz/1"))
    one = S.scan_fastq(spark, put(tmp_path, "o.fq", "".join(f"@r{i}/1\nACGT\n+\n!!!!\n" for i in range(400))))
    assert [r.name for r in one.collect()] == [f"r{i}/1" for i in range(400)]  # no shuffle has mixed them
    many = S.scan_fastq(spark, str(tmp_path / "gz/1"))
    assert sorted((r.record_no, r.name) for r in many.collect()) == [(i, f"r{i}/1") for i in range(400)]


def test_pieces_stay_where_they_are_read(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # a shuffle leaves its partitions
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    path = put(tmp_path, "o.fa", "".join(f">c{i} x\n{'ACGT' * 15}\nAC\n" for i in range(300)))
    want = [(f"c{i}", "ACGT" * 15 + "AC") for i in range(300)]
    got = [(r.contig, r.seq) for r in S.scan_fasta(spark, path).collect()]
    assert got[:-1] == want[:-1] and got[-1] == want[-1]  # in order: no shuffle has mixed them
    assert [(r.contig, r.start, r.seq) for r in S.scan_fasta_pieces(spark, path, 60).collect()][:598:2] == [(f"c{i}", 0, "ACGT" * 15) for i in range(299)]


def test_fasta_gtf_xml_sheet(spark, tmp_path):
    rows = S.scan_fasta(spark, put(tmp_path, "x.fa", ">c1 first\nACG\nTT\n>c2\nGG\n")).collect()
    assert {(r.contig, r.seq, r.contig_len) for r in rows} == {("c1", "ACGTT", 5), ("c2", "GG", 2)}
    gtf = '#!x\nc1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "g1"; gene_biotype "coding";\nc1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g1";\n'
    assert [tuple(r) for r in S.scan_gtf(spark, put(tmp_path, "x.gtf", gtf)).collect()] == [("c1", 1, 9, "+", "g1", "coding")]
    xml = "<RunInfo><Run><Flowcell>F1</Flowcell><Instrument>I1</Instrument><Date>20200101</Date></Run><Run><Flowcell>F2</Flowcell></Run></RunInfo>"
    r = S.scan_runinfo_xml(spark, put(tmp_path, "x.xml", xml)).first()
    assert (r.flowcell, r.instrument, r.date) == ("F1", "I1", "20200101")
    sheet = "\n".join([f"p{i}" for i in range(19)] + ["A,B", "1,x", '2,"y,z"']) + "\n"
    assert sorted(tuple(r) for r in S.scan_samplesheet(spark, put(tmp_path, "s.csv", sheet), ["A", "B"]).collect()) == [("1", "x"), ("2", "y,z")]


def test_html(spark):
    html = "<table><tr><th>a</th><th>b <i>c</i></th></tr><tr><td>1</td><td></td></tr></table><TABLE><tr><td>z</td></tr></TABLE><ul><li>x</li><LI class=q>y <b>z</b></LI></ul>"
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in S.html_tables(df).orderBy("table_no", "row_no").collect()] == [(1, 0, 0, ["a", "b c"]), (1, 0, 1, ["1", ""]), (1, 1, 0, ["z"])]
    assert [r.item for r in S.html_items(df).orderBy("item_no").collect()] == ["x", "y z"]


def read(**x):
    base = {"contig_ord": 1, "pos": 100, "is_reverse": False, "cigar": "35M65S", "sa": None, "seq": "A" * 35 + "C" * 65}
    return base | x


@pytest.mark.parametrize(
    ("x", "want"),
    [
        (read(sa="1,500,+,35S65M,60,0;"), (1, 134, "r", 1, 499, "l", "", "del")),
        (read(sa="1,500,+,40S60M,60,0;"), (1, 134, "r", 1, 499, "l", "CCCCC", "del")),
        (read(sa="1,500,+,30S70M,60,0;"), (1, 129, "r", 1, 499, "l", "", "del")),
        (read(sa="1,20,+,35S65M,60,0;"), (1, 19, "l", 1, 134, "r", "", "dup")),
        (read(sa="1,500,-,65M35S,60,0;"), (1, 134, "r", 1, 563, "r", "", "inv")),
        (read(sa="2,500,+,35S65M,60,0;"), (1, 134, "r", 2, 499, "l", "", "cf")),
        (read(cigar="40S60M", sa="1,20,+,40M60S,60,0;"), (1, 58, "r", 1, 100, "l", "", "del")),
        (read(sa="1,500,+,65M35S,60,0;"), None),
        (read(cigar="10S80M10S", sa="1,500,+,35S65M,60,0;"), None),
        (read(cigar="35M65H", sa="1,500,+,35S65M,60,0;"), None),
        (read(sa="1,500,+,30S5I65M,60,0;"), None),
        (read(), None),
    ],
)
def test_junctions_by_hand(spark, x, want):
    df = spark.createDataFrame([x], "contig_ord int, pos long, is_reverse boolean, cigar string, sa string, seq string")
    got = J.junctions(df).select(*J.KEY).collect()
    assert [tuple(r) for r in got] == ([want] if want else [])


def test_suppression_depends_on_what_was_kept(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), a := rng.randrange(300), a + rng.randrange(40), rng.choice(["inv", "del"])) for _ in range(400)]
    df = spark.createDataFrame(rows, "contig_ord long, start long, stop long, kind string")
    want, last = [], {}
    for c, a, b, k in sorted(rows):
        p = last.get(c)
        if p and (abs(a - p[0]) <= 5 or abs(b - p[1]) <= 5) and not (k == "inv" and p[2] != "inv"):
            continue
        last[c] = (a, b, k)
        want.append((c, a, b, k))
    assert sorted(tuple(r) for r in kmers.suppress_overlaps(df).collect()) == want


def test_distance_is_symmetric_and_kinship_bounded(spark):
    rng = random.Random(2)
    g = spark.createDataFrame([(s, i, *((None, None) if rng.random() < 0.1 else (rng.randint(0, 1), rng.randint(0, 1)))) for s in range(60) for i in range(6)], "site_id long, sample_idx long, a1 int, a2 int")
    d = {(r.i, r.j): r.distance for r in popgen.pairwise_distance(g, 10.0).collect()}
    assert len(d) == 30 and all(d[i, j] == d[j, i] for i, j in d)
    assert all(r.phi <= 0.5 for r in popgen.kinship_king(g).collect())


def test_parent_phase(spark):
    sites = spark.createDataFrame([(s, 0, 10 * s) for s in range(6)], "site_id long, contig_ord long, pos long")
    flips = [0, 1, 1, 0, 1, 0]  # which allele the parent's left chromosome has
    rows = []
    for s in range(6):
        rows += [(s, 0, 0, 1), (s, 1, 0, 0)] + [(s, 2 + k, flips[s] if k % 2 == 0 else 1 - flips[s], 0) for k in range(8)]
    g = spark.createDataFrame(rows, "site_id long, sample_idx long, a1 int, a2 int")
    got = variants.phase_parents(variants.phase_progeny(g, 0, 1), g, sites, 0, "maternal").orderBy("site_id").collect()
    left = [r.left for r in got]
    assert left in (flips, [1 - x for x in flips]) and all(r.left + r.right == 1 for r in got)


def test_registry_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "Run string, n long")
    with pytest.raises(ValueError, match="LibraryLayout, Bases"):
        registry.require_columns(df, ["Run", "LibraryLayout", "Bases"])
    with pytest.raises(ValueError, match="not unique"):
        registry.require_unique(df, "Run")


def test_registration_resumes(spark, tmp_path):
    schema = "Run string, LibraryLayout string"
    source, target, mark = (str(tmp_path / x) for x in ("new", "registry", "mark"))
    first = spark.createDataFrame([("r1", "PAIRED"), ("r2", "SINGLE"), ("r2", "SINGLE"), ("r3", "OTHER"), (None, "PAIRED")], schema)
    first.coalesce(1).write.parquet(source)
    register_runs_stream(spark, source, schema, target, mark).awaitTermination()
    spark.createDataFrame([("r2", "PAIRED"), ("r4", "PAIRED")], schema).coalesce(1).write.mode("append").parquet(source)
    register_runs_stream(spark, source, schema, target, mark).awaitTermination()
    assert sorted(r.Run for r in spark.read.parquet(target).collect()) == ["r1", "r2", "r4"]
    assert sorted(r.Run for r in new_runs(first, None).collect()) == ["r1", "r2"]


def test_vcf_lines(spark, tmp_path):
    events = spark.createDataFrame([(1, "c1", 5, "ACG", "A", 5, 7, "del"), (2, "c1", 9, "ACGT", "A", 9, 30_009, "dup")], "event long, contig string, pos long, ref string, alt string, start long, stop long, svtype string")
    calls = spark.createDataFrame([(1, "b", "0/1", 3, 4, 1)], "event long, sample string, gt string, rr int, ar int, br int")
    lines = [r.value for r in K.vcf_records(events, calls, ["a", "b"]).orderBy("pos").collect()]
    assert lines[0] == "c1\t5\t.\tACG\tA\t.\tPASS\tNS=1;END=7;SVTYPE=DEL;SVLEN=3\tGT:RR:AR:BR\t./.:0:0:0\t0/1:3:4:1"
    assert lines[1].split("\t")[3:5] == ["A", "<DUP>"]
