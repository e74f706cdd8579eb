"""Readers of the text formats of sequencing labs, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

PAF_SCHEMA = "Q_Name string, Q_Size long, Q_Start long, Q_Stop long, Q_Strand string, R_Name string, R_Size long, R_Start long, R_Stop long, ResiduesMatch long, AlignmentLength long, MappingQuality int, AlignmentType string, c string, d string, e string, f string, g string"
BED_SCHEMA = "contig string, start long, stop long"
GTF_SCHEMA = "chrom string, source string, feature string, start long, stop long, score string, strand string, frame string, attributes string"


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header, quotes, and backslash-escaped characters."""
    return spark.read.schema(schema).option("header", True).option("escape", "\\").option("quote", '"').csv(path)


def split_files(column: str = "Files") -> Column:
    """The paths of a ',,' list."""
    return F.split(column, ",,")


def scan_sheet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One sheet of a workbook, landed as a folder of CSV or Parquet."""
    return spark.read.schema(schema).parquet(path) if path.rstrip("/").endswith(".parquet") else scan_csv(spark, path, schema)


def scan_tsv_named(spark: SparkSession, path: str, schema: str | T.StructType = PAF_SCHEMA) -> DataFrame:
    """Tab-separated values without a header."""
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def scan_tsv_pruned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a tab-separated table with a header, as strings."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).select(*[F.col(f"`{c}`") for c in columns])


def scan_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sites, genotypes) of VCF text.

    Sites: contig, pos (0-based), id, ref, alt (array), qual, filter, info (map), svtype, stop. Genotypes: contig, pos, ref,
    alt, sample, and fields, a map by FORMAT names. The reference of a ``<DEL>`` is not known, its end is.
    """
    lines = spark.read.text(path)
    names = lines.where("value like '#CHROM%'").select(F.posexplode(F.expr("slice(split(value, '\t'), 10, greatest(size(split(value, '\t')) - 9, 0))")).alias("i", "sample")).distinct()
    f = F.split("value", "\t")
    info = F.str_to_map(F.get(f, 7), F.lit(";"), F.lit("="))
    rows = lines.where("not value like '#%' and value <> ''")
    rows = rows.select(F.get(f, 0).alias("contig"), (F.get(f, 1).cast("long") - 1).alias("pos"), F.get(f, 2).alias("id"), F.get(f, 3).alias("ref"), F.split(F.get(f, 4), ",").alias("alt"), F.get(f, 5).try_cast("double").alias("qual"), F.get(f, 6).alias("filter"), info.alias("info"), F.split(F.get(f, 8), ":").alias("format"), F.expr("slice(split(value, '\t'), 10, greatest(size(split(value, '\t')) - 9, 0))").alias("calls"))
    end = F.try_element_at("info", F.lit("END")).try_cast("long")
    sites = rows.drop("format", "calls").withColumns({"svtype": F.try_element_at("info", F.lit("SVTYPE")), "stop": F.coalesce(end, F.col("pos") + F.length("ref"))})
    calls = rows.select("contig", "pos", "ref", "alt", "format", F.posexplode("calls").alias("i", "call"))
    calls = calls.join(F.broadcast(names), "i")  # a row per sample
    cells, n = F.split("call", ":"), F.size("format")  # cells that are left out at the end are missing
    return sites, calls.select("contig", "pos", "ref", "alt", "sample", F.map_from_arrays("format", F.when(F.size(cells) == n, cells).otherwise(F.concat(F.slice(cells, 1, n), F.array_repeat(F.lit("."), F.greatest(n - F.size(cells), F.lit(0)))))).alias("fields"))


def scan_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: positions 0-based, flag bits as booleans, tags as a map."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("not value like '@%' and value <> ''")
    flag = F.get(f, 1).cast("int")
    bits = {"is_paired": 1, "is_proper_pair": 2, "is_unmapped": 4, "mate_is_unmapped": 8, "is_reverse": 16, "mate_is_reverse": 32, "is_secondary": 256, "is_duplicate": 1024}
    tags = F.transform(F.expr("slice(split(value, '\t'), 12, greatest(size(split(value, '\t')) - 11, 0))"), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.regexp_replace(t, "^..:.:", "").alias("v")))
    mate = F.when(F.get(f, 6) == "=", F.get(f, 2)).otherwise(F.get(f, 6))
    return rows.select(F.get(f, 0).alias("qname"), *[(flag.bitwiseAND(b) != 0).alias(n) for n, b in bits.items()], F.get(f, 2).alias("contig"), (F.get(f, 3).cast("long") - 1).alias("pos"), F.get(f, 4).cast("int").alias("mapq"), F.get(f, 5).alias("cigar"), mate.alias("next_contig"), (F.get(f, 7).cast("long") - 1).alias("next_pos"), F.get(f, 8).cast("long").alias("isize"), F.get(f, 9).alias("seq"), F.get(f, 10).alias("qual"), F.map_from_entries(tags).alias("tags"))


def fetch(reads: DataFrame, contig: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Reads that overlap a region (0-based, half open)."""
    from popweave.operators.reads import reference_end

    out = reads.where(F.col("contig") == contig)
    if start is not None:
        out = out.where((F.col("pos") < stop) & (reference_end() > start))
    return out


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, _before, _n): lines numbered by file name and place, however the files are split, with the lines before their split and in it.

    Within a split row ids are consecutive; a table of one row per split holds where its lines begin. Rows keep the order of the text.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_f", "_b").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_f", "_b", "_low", "_n", before.alias("_before"))
    return rows.join(F.broadcast(splits), ["_f", "_b"]).select((F.col("_id") - F.col("_low") + F.col("_before")).alias("line"), "value", "_before", "_n")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines numbered by file name and place."""
    return _split_lines(spark, path).select("line", "value")


def scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, name, seq, qual) of 4-line records.

    The records that lie whole in a split of a file are put together where they are read; only lines of those that a split cuts meet in a shuffle.
    """
    rows = _split_lines(spark, path).withColumns({"record_no": F.floor(F.col("line") / 4), "k": F.col("line") % 4})
    first = F.col("record_no") * 4
    whole = (first >= F.col("_before")) & (first + 4 <= F.col("_before") + F.col("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            n = len(table) // 4 * 4
            rest = table.slice(n).combine_chunks().to_batches()[0] if n < len(table) else None
            if not n:
                continue
            lines = table.column("line").slice(0, n).to_numpy().reshape(-1, 4)
            if ((lines - lines[:, :1] != np.arange(4)) | (lines[:, :1] % 4 != 0)).any():
                raise RuntimeError("lines of a split are out of order")
            value = [table.column("value").take(pa.array(np.arange(k, n, 4))).combine_chunks() for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(lines[:, 0] // 4), *[v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in value]], names=["record_no", "head", "seq", "qual"])

    inside = rows.where(whole).select("line", "value").mapInArrow(run, "record_no long, head string, seq string, qual string")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    cut = rows.where(~whole).groupBy("record_no").agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual")).where("seq is not null and qual is not null")
    return inside.unionByName(cut).select("record_no", F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), "seq", "qual")


def scan_fastq_pair(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two files record by record: name, seq1, qual1, seq2, qual2."""
    a, b = (scan_fastq(spark, p).select("record_no", F.col("name").alias(f"name{i}"), F.col("seq").alias(f"seq{i}"), F.col("qual").alias(f"qual{i}")) for i, p in ((1, first), (2, second)))
    return a.join(b, "record_no").select("record_no", F.col("name1").alias("name"), "seq1", "qual1", "seq2", "qual2")


def _fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of FASTA text in order, with their split's row of ``_fasta_splits``: value (null for a header), _id, and _head (id, name) of a header.

    Files are split anywhere; a table of one row per split carries the last header and the letters since then into the splits that follow.
    """
    value = F.trim(F.translate("value", "\t\r\n\x0b\x0c", " " * 5))
    head = F.when(F.col("value").startswith(">"), F.struct(F.col("_id").alias("id"), F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("name")))
    rows = spark.read.text(path).select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    rows = rows.where("value <> ''").withColumn("_head", head).withColumn("value", F.when(F.col("_head").isNull(), F.replace("value", F.lit(" "), F.lit(""))))
    return rows.join(F.broadcast(_fasta_splits(rows)), ["file", "_b"])


def _fasta_splits(rows: DataFrame) -> DataFrame:
    """A row per split of a file: its first line (_low), its first and last header (_first, _last), the header carried into it and the letters since that one (_carried, _offset)."""
    heads = rows.where("_head is not null").groupBy("file", "_b").agg(F.min("_head.id").alias("_first"), F.max("_head.id").alias("_end"))
    after = F.col("_end").isNull() | (F.col("_id") > F.col("_end"))
    letters = F.sum(F.when(after, F.length("value")).otherwise(0).cast("long"))
    last = F.collect_list(F.when(F.col("_id") == F.col("_end"), F.col("_head")))  # one: no sort of all lines for it
    splits = rows.join(F.broadcast(heads), ["file", "_b"], "left").groupBy("file", "_b").agg(F.min("_head.id").alias("_first"), F.get(last, 0).alias("_last"), F.min("_id").alias("_low"), F.coalesce(letters, F.lit(0)).alias("_n"))
    order = W.partitionBy("file").orderBy("_b")  # a row per split of a file
    before = order.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumns({"_carried": F.last("_last", ignorenulls=True).over(before), "_k": F.count("_last").over(order)})
    # letters since the last header: those of the splits of the same run, which begins with the split that has a header
    splits = splits.withColumn("_sum", F.sum("_n").over(W.partitionBy("file", "_k").orderBy("_b")))
    return splits.select("file", "_b", "_low", "_first", "_last", "_carried", F.coalesce(F.lag("_sum").over(order), F.lit(0)).alias("_offset"))


def _fasta_cut(spark: SparkSession, path: str, width: int | None) -> DataFrame:
    """(file, head, contig, start, seq): pieces of contigs as in ``scan_fasta_pieces``; without ``width`` whole contigs, empty ones too.

    Pieces are put together where their lines are read; only the first and the last of a split, which may go on in the next one, meet in a shuffle.
    """
    first = F.col("_id") == F.col("_low")  # the line that brings what is known of its split
    known = [F.when(first, c).alias(n) for c, n in ((F.col("file"), "file"), (F.coalesce("_carried.id", F.lit(-1)), "old"), (F.col("_carried.name"), "old_name"), (F.col("_offset"), "offset"))]
    # a split's edges are before its first header and after its last
    edge_line = F.col("_first").isNull() | (F.col("_id") < F.col("_first")) | (F.col("_id") >= F.col("_last.id")) | first
    lines = _fasta_lines(spark, path).select("value", F.col("_head.id").alias("id"), F.col("_head.name").alias("name"), *known, edge_line.alias("edge"))

    def cut(edges: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            file = head = name = stretch = None
            begun, at, parts, edge = 0, 0, [], False

            def close(last: bool) -> None:
                nonlocal size, parts
                if stretch is not None and head >= 0 and (edge or last) == edges:
                    out.append((file, head, name, begun, "".join(parts)))
                    size += at - begun
                parts = []

            def passed_on() -> pa.RecordBatch:
                nonlocal out, size
                columns, out, size = list(zip(*out, strict=True)), [], 0
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "head", "contig", "start", "seq"])

            for batch in batches:
                value, ids, names, *known = (batch.column(c) for c in ("value", "id", "name", "file", "old", "old_name", "offset"))
                texts = value.to_pylist()
                stops = np.flatnonzero(value.is_null().to_numpy(zero_copy_only=False) | known[0].is_valid().to_numpy(zero_copy_only=False)).tolist()
                for i, j in zip([-1, *stops], [*stops, len(texts)], strict=True):
                    if i >= 0 and known[0][i].is_valid:  # the first line of a split
                        close(True)
                        file, head, name, at = (c[i].as_py() for c in known)
                        stretch, edge = None, True
                    if i >= 0 and texts[i] is None:  # a header
                        close(False)
                        head, name, begun, at, stretch, edge = ids[i].as_py(), names[i].as_py(), 0, 0, None if width else 0, False
                        i += 1
                    run_of = texts[max(i, 0) : j]
                    if width and any(len(x) > width for x in run_of):
                        run_of = [x[c : c + width] for x in run_of for c in range(0, len(x), width)]
                    if not run_of:
                        continue
                    starts = at + np.cumsum([0, *map(len, run_of)])
                    ks = starts[:-1] // width if width else np.zeros(len(run_of), np.int64)
                    turns = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), len(run_of)]
                    for x, y in zip(turns, turns[1:]):
                        if ks[x] != stretch:
                            if stretch is not None:
                                close(False)
                                edge = False
                            stretch, begun = int(ks[x]), int(starts[x])
                        parts.extend(run_of[x:y])
                        at = int(starts[y])
                    if size >= 1 << 22:
                        yield passed_on()
            close(True)
            if out:
                yield passed_on()

        rows = lines.where("edge") if edges else lines
        return rows.mapInArrow(run, "file string, head long, contig string, start long, seq string")

    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    met = cut(True).groupBy("file", "head", "contig", (F.floor(F.col("start") / width) if width else F.lit(0)).alias("_k")).agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))
    return cut(False).unionByName(met.drop("_k"))


def scan_fasta_pieces(spark: SparkSession, path: str, width: int = 10_000) -> DataFrame:
    """(file, head, contig, start, seq): contigs in pieces of about ``width`` letters, whatever their length; ``head`` tells contigs of one name apart.

    A piece begins with the first line that begins in a stretch of ``width`` letters; longer lines are cut.
    """
    return _fasta_cut(spark, path, width)


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq, contig_len) of FASTA text with wrapped lines: a row per contig, of at most 2 GB; ``scan_fasta_pieces`` has no such bound."""
    return _fasta_cut(spark, path, None).select("contig", "seq").withColumn("contig_len", F.length("seq"))


def region_slice(genome: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (contig, start, stop; 0-based, half open) with their sequence, from whole contigs or pieces (with start) of them."""
    from popweave.operators.intervals import cut_regions

    return cut_regions(genome.select("contig", "seq", *[c for c in ("start",) if c in genome.columns]), regions, "contig")


def scan_phylip(spark: SparkSession, path: str) -> DataFrame:
    """(tile, sample, sequence) of an interleaved alignment in two folders (header, rows)."""
    n = int((spark.read.text(f"{path}/header").first() or ["0"])[0].split()[0])
    rows = _numbered_lines(spark, f"{path}/rows").withColumns({"tile": F.floor(F.col("line") / max(n, 1)), "_k": F.col("line") % max(n, 1)})
    f = F.split("value", " +")
    names = rows.where("tile = 0").select("_k", f[0].alias("sample"))  # a row per sample
    return rows.join(names, "_k").select("tile", "sample", F.element_at(f, -1).alias("sequence"))


def scan_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a GTF file: name is the first quoted attribute."""
    rows = spark.read.schema(GTF_SCHEMA).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).where("feature = 'gene'")
    return rows.select("chrom", "start", "stop", "strand", F.regexp_extract("attributes", '"([^"]*)"', 1).alias("name"), F.regexp_extract("attributes", 'gene_biotype "([^"]*)"', 1).alias("biotype"))


def scan_runinfo_xml(spark: SparkSession, path: str) -> DataFrame:
    """(path, flowcell, instrument, date) of the first Run of each file."""
    runs = spark.read.format("xml").option("rowTag", "Run").schema("Flowcell string, Instrument string, Date string").load(path)
    runs = runs.select(F.input_file_name().alias("path"), "Flowcell", "Instrument", "Date", F.monotonically_increasing_id().alias("n"))
    return runs.groupBy("path").agg(*[F.min_by(c, "n").alias(c.lower()) for c in ("Flowcell", "Instrument", "Date")])


def scan_samplesheet(spark: SparkSession, path: str, columns: list[str], skip: int = 19) -> DataFrame:
    """CSV below a preamble of ``skip`` lines and a header."""
    rows = _numbered_lines(spark, path).where(F.col("line") > skip)
    schema = ", ".join(f"`{c}` string" for c in columns)
    return rows.where("trim(value) <> ''").select(F.from_csv("value", F.lit(schema)).alias("r")).select("r.*")


def decode_tuple(column: str) -> Column:
    """A text like (1, 2) as an array of numbers."""
    return F.from_json(F.translate(column, "()", "[]"), "array<int>")


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells) of all tables of the pages' html; row 0 is the header."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t"))
    rows = tables.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    return rows.select("page_id", "table_no", "row_no", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), clean).alias("cells"))


def html_items(pages: DataFrame) -> DataFrame:
    """(page_id, item_no, item): list items of the pages' html."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " "))
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))).alias("item_no", "x")).select("page_id", "item_no", clean.alias("item"))

