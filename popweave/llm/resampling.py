"""Importance resampling towards a target: hashed n-gram weights, Gumbel top-k, lines counted once.

Features are runs of 1 to ``n`` words, hashed to ``buckets``. Newlines separate words, so a text is its lines and the
runs that cross them. Equal lines of all documents are grouped first; the words of a distinct line are cut and
hashed once, its features are kept as bucket numbers and count as often as the line occurs; runs across lines are made per
document and added. With the bucket counts of corpus and target every bucket has a gain, every distinct line a sum
of gains, and every document the sums of its lines and crossing runs. Documents are drawn without replacement by the highest
weight plus Gumbel noise, which is a function of doc_id.

Lines that are at least 1 in ``HOT`` of all lines, ``HOT`` at most, are broadcast; the others meet their documents by a
shuffle in which no line has a larger share. The draw is an ordering by ranges with offsets of one row per range. The
driver sees a row per bucket.

Defined cases: a null text has no features and weight 0, so has an empty one; a null doc_id is hashed as an empty one and comes last
among equal scores; repeated rows are rows of their own (equal doc_ids: ordered by the hash of their text); blank lines have no
features; a line of any length is one row; an empty table gives no rows, an empty target only zero target counts. Further columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import compact, lean, letters_only, slices, stored, text_of, words_of

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
HOT = 10_000
DOC = ["doc_id", "h1", "h2"]


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and where each text's words begin: ASCII but letters and digits separates."""
    texts = compact(texts)
    offsets, data = texts.buffers()[1:]
    if data is None:
        return words_of(texts, lower=False)
    table = np.frombuffer(letters_only(), np.uint8)
    clean = table[np.frombuffer(data, np.uint8)]
    return words_of(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(clean)), lower=False)


def bucket_numbers(strings: pa.Array, buckets: int) -> np.ndarray:
    """CRC-32 of each string modulo ``buckets``, worked out once per distinct string."""
    coded = strings.dictionary_encode()
    distinct = np.array([zlib.crc32(s.as_py()) % buckets for s in coded.dictionary.cast(pa.large_binary())], np.int64)
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)


def runs(words: pa.Array, offsets: np.ndarray, n: int, buckets: int, line: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to n words within a text and the number of each text's runs; with ``line``, of runs that cross lines only."""
    owner, end = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), np.repeat(offsets[1:], np.diff(offsets))
    found, owners = [], []
    for size in range(1, n + 1):
        at = np.flatnonzero(np.arange(len(owner)) + size <= end)
        if line is not None:
            at = at[line[at] != line[at + size - 1]]
        parts = [words.take(pa.array(at + k)) for k in range(size)]
        found.append(bucket_numbers(pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type)) if size > 1 else parts[0], buckets))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.bincount(owners, minlength=len(offsets) - 1)


def _packed(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The numbers of each row as a binary of little-endian 32-bit integers."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(numbers.astype("<u4"))]).cast(pa.binary())


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(x) // 4 for x in raw], np.int64)


def with_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (128 bits of hash of the text) and lines of every row."""
    text = text_of(docs)
    return docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.split(text, "\n").alias("lines"))


def _keys(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), F.col(line)).alias("k2")]


def line_features(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(k1, k2, times, words, features): every distinct line of ``docs`` with how often it occurs, its words and its features' buckets."""
    lines = docs.select(F.explode(F.split(text_of(docs), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("times"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "line"):
            words, offsets = plain_words(some.column("line"))
            found, counts = runs(words, offsets, n, buckets)
            yield pa.RecordBatch.from_arrays([some.column("k1"), some.column("k2"), some.column("times"), pa.array(np.diff(offsets)), _packed(found, counts)], names=["k1", "k2", "times", "words", "features"])

    return stored(lines.select(*_keys("line"), "times", "line").mapInArrow(run, "k1 long, k2 long, times long, words long, features binary"), "lines")


def crossing_features(docs: DataFrame, n: int, buckets: int = BUCKETS) -> DataFrame | None:
    """(doc_id, h1, h2, times, features): the runs of each row that cross lines; None where runs are single words."""
    if n < 2:
        return None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text"):
            lists = pc.split_pattern(compact(some.column("text")), "\n")
            first = lists.offsets.to_numpy().astype(np.int64)
            words, offsets = plain_words(lists.flatten())
            line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            found, counts = runs(words, offsets[first - first[0]], n, buckets, line)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("h1"), some.column("h2"), pa.array(np.ones(some.num_rows, np.int64)), _packed(found, counts)], names=[*DOC, "times", "features"])

    text = text_of(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, times long, features binary"), "crossing")


def bucket_counts(tables: list[DataFrame], buckets: int = BUCKETS) -> list[int]:
    """How many features fall into each bucket, in all tables (times, features)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found, counts = _numbers(batch.column("features"))
            np.add.at(total, found, np.repeat(batch.column("times").to_numpy(), counts))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = [0] * buckets
    for t in tables:
        for r in t.select("times", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r.bucket] += r.n  # a row per bucket
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 * ln of (share in the target / share in the corpus)) per bucket, with one more feature in each bucket."""
    s_all, t_all, k = sum(corpus), sum(target), len(corpus)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def summed(table: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns of the table with n, its features, and g, their summed gains."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = _numbers(batch.column("features"))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts), pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=[*keep, "n", "g"])

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*keep, "features").mapInArrow(run, f"{kinds}, n long, g long")


def weighed(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, h1, h2, copy, n_words, n_features, weight) of every row of ``docs``: the floored mean gain of its features."""
    lines, crossing = line_features(docs, n, buckets), crossing_features(docs, n, buckets)
    other = [line_features(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets), crossing_features(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets)]
    gain = gains(bucket_counts([t for t in (lines, crossing) if t is not None], buckets), bucket_counts([t for t in other if t is not None], buckets))

    sums = stored(summed(lines, gain, ["k1", "k2", "times", "words"]), "line_sums")
    total = sums.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") * HOT >= total  # at most HOT lines
    rows = with_lines(docs).select(*DOC, F.posexplode("lines").alias("line_no", "line")).select(*DOC, "line_no", *_keys("line"))
    rows = rows.join(F.broadcast(sums.where(hot).drop("times")), ["k1", "k2"], "left")
    rare = rows.where("n is null").select(*DOC, "line_no", "k1", "k2").join(sums.where(~hot).drop("times"), ["k1", "k2"])
    cells = [c.select(*DOC, (F.col("line_no") == 0).cast("long").alias("copies"), "words", "n", "g") for c in (rows.where("n is not null"), rare)]
    if crossing is not None:
        cells.append(summed(crossing, gain, DOC).select(*DOC, F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("words"), "n", "g"))
    all_cells = cells[0]
    for c in cells[1:]:
        all_cells = all_cells.unionByName(c)
    out = all_cells.groupBy(*DOC).agg(*[F.sum(c).alias(c) for c in ("copies", "words", "n", "g")])
    once = lambda c: F.expr(f"{c} div copies")  # noqa: E731  # copies of a row share their lines, so the sums are multiples
    out = out.select(*DOC, "copies", once("words").alias("n_words"), once("n").alias("n_features"), once("g").alias("g"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(g - pmod(g, n_features)) div n_features"))
    return out.select(*DOC, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), "n_words", "n_features", weight.alias("weight"))


def noise(doc_id: str, seed: int = SEED) -> Column:
    """floor(1000 * a Gumbel number) made from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(weights: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """weights with score, and rank from 1 on of the ``percent`` of documents of ``least_words`` words that score highest (others: null)."""
    scored = stored(weights.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    fit = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("h1"), F.col("h2"), F.col("copy")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(scored.where(fit).orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": place}), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    most = ranged.count() * percent // 100
    rank = F.col("_before") + F.col("_at") + 1
    ranged = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("rank", F.when(rank <= most, rank))
    return ranged.select(*scored.columns, "rank").unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, **draw) -> DataFrame:
    """(doc_id, h1, h2, copy, n_words, n_features, weight, score, rank) of every row of ``docs``."""
    return drawn(weighed(docs, target, n, buckets), **draw)


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of ``documents``, drawn towards ``benchmark``; every document with its weight and score."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resampled(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_resampling": op13_resampling}
ORACLE_SQL = {
    "op13_resampling": r"""
WITH crc AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)) q),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sw AS (SELECT doc_id, unnest(w) AS w FROM d),
tw AS (SELECT unnest(w) AS w FROM b),
u AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM sw UNION SELECT w FROM tw) q),
k AS (SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) // 2 AS BIGINT)), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT))), lambda c, y: xor(c // 256, crc[1 + xor(c % 256, y)]))) % 10000 AS k FROM u, crc),
s AS (SELECT k, count(*) AS s FROM sw JOIN k ON k.w = sw.w GROUP BY k),
t AS (SELECT k, count(*) AS t FROM tw JOIN k ON k.w = tw.w GROUP BY k),
g AS (SELECT s.k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT sum(s) FROM s) + 10000) / (CAST(s + 1 AS DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t ON t.k = s.k),
x AS (SELECT doc_id, count(*) AS n, sum(g) AS g FROM sw JOIN k ON k.w = sw.w JOIN g ON g.k = k.k GROUP BY doc_id),
p AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g / CAST(n AS DOUBLE)) AS BIGINT), 0) AS weight, sha256('2024:' || CAST(d.doc_id AS VARCHAR)) AS h FROM d LEFT JOIN x ON x.doc_id = d.doc_id),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0, list_transform(range(8), lambda i: CAST(strpos('0123456789abcdef', substr(h, CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT))), lambda a, c: a * 16 + c) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM p),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""
}
