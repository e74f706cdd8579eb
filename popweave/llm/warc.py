"""WARC archives with revisit resolution.

Headers (page id, digest, size), never payloads, are shuffled by payload digest to find the response of each
group of equal payloads; payloads then travel once, evenly by page id, to the tasks that write the archives. Payloads of very
many pages, and responses of very many revisits, are broadcast instead (``common.join_frequent_apart``).

Defined cases: a null html is an empty payload; a null url writes no target header; payloads under
``min_bytes`` are always responses; rows that share both page id and payload with the response are responses
themselves; a null page id never becomes the response while another page has the payload; an empty table
writes no file; equal payloads of one page id are equal records. Records are written and read one at a time, so a very
long payload costs its own size. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import FileWriter, join_frequent_apart, open_fs, shared_dir, slices, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, CHUNK = 64 << 20, 1 << 15
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, payload binary"


def record_name(page_id: int | None, digest: str) -> str:
    """A record's id: the same for the same page and payload, so that revisits can name a response in any file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (page id of the response; null for a response)."""
    html = F.coalesce("html", F.lit(""))
    made = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    heads = stored(made.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"), "heads")
    first = stored(heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    revisits = join_frequent_apart(heads, first, "payload_digest", "n").where("not page_id <=> refers_to").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "refers_to").distinct()
    return made.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").drop("p", "d")


def write_warc(resolved: DataFrame, uri: str, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write gzip-per-record archives below ``uri``; returns the table (path, n_records) of the files."""

    def record(page_id, url, html: bytes, digest: str, refers_to, n_bytes: int) -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        block = http if refers_to is not None else http + html
        lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id, digest)}", f"WARC-Date: {date}"]
        if url is not None:
            lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
        lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
        if refers_to is not None:
            lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to, digest)}"]
        if page_id is not None:
            lines.append(f"Page-ID: {page_id}")
        head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        return pack.compress(head + block + b"\r\n\r\n") + pack.flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, k, task = None, 0, 0, TaskContext.get().partitionId()

        def path() -> str:
            return f"{uri}/part-{task:06d}-{k:04d}.warc.gz"

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path()], "n_records": pa.array([n], pa.int64())})

        for batch in slices(batches, "html"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to", "payload_bytes")), strict=True):
                out = out or FileWriter(path())
                out.write(record(*row))
                n += 1
                if out.size >= FILE_BYTES:
                    yield close()
                    out, n, k = None, 0, k + 1
        if n:
            yield close()

    rows = resolved.withColumn("html", F.encode("html", "UTF-8")).withColumn("payload_digest", F.col("payload_digest"))
    rows = rows.select("page_id", "url", "html", "payload_digest", "refers_to", "payload_bytes").sortWithinPartitions("page_id", "payload_digest", "url")
    return stored(rows.mapInArrow(write, "path string, n_records long"), "warc_files")


def parse(file, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an open gzip-per-record archive, read a chunk at a time.

    What is left of a chunk when a record ends is at most a chunk, so the work is linear in the archive's size.
    """
    unpack, parts, data = zlib.decompressobj(31), [], file.read(chunk)
    while data:
        parts.append(unpack.decompress(data))
        if not unpack.eof:
            data = file.read(chunk)
            continue
        data = unpack.unused_data or file.read(chunk)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]
        unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in ``files.path``; payload is null for revisits, or if ``payloads`` is off."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = open_fs(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
                    for x, block in parse(f):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.decode().rpartition("Content-Length: ")[2])
                        revisit = x["WARC-Type"] == "revisit"
                        url = x.get("WARC-Target-URI")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        page = int(x["Page-ID"]) if "Page-ID" in x else None
                        rows.append((page, url, length, x["WARC-Payload-Digest"].partition(":")[2], x["WARC-Type"], x["WARC-Record-ID"], x.get("WARC-Refers-To"), body if payloads and not revisit else None))
                        size += len(block) if payloads else 500
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    n = max(1, files.count())
    numbered = files.select("path", (F.row_number().over(W.orderBy("path")) - 1).alias("file"))  # a row per file
    return numbered.repartitionById(n, F.col("file")).select("path").mapInArrow(read, RECORDS)


def with_responses(records: DataFrame) -> DataFrame:
    """records with refers_to: the page id of the response that a revisit's WARC-Refers-To names. Responses are not shuffled by what they lack."""
    heads = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id")
    revisits = heads.where("record_type = 'revisit'")
    named = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    times = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    found = join_frequent_apart(revisits, stored(times.join(named, "refers_to_id", "left"), "responses"), "refers_to_id", "n")
    return heads.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as archives, reads them back: one row per page."""
    files = write_warc(resolve(spark.read.parquet(f"{sf_dir}/pages.parquet")), f"{shared_dir(spark)}/warc")
    return with_responses(stored(read_warc(files, payloads=False), "warc_records")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
 CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
}
