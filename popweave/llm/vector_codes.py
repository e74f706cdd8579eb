"""Vector codes (product quantisation), learnt with norm-of-sum bounds that spare exact scans.

Vectors of integers are cut into equal parts; each part position has a codebook, and a part's code is the index of its
codebook's nearest entry. A round assigns every part and moves every entry to the floored mean of its parts. The first
round scans all entries for every part and keeps, as a lower bound, the distance to the second nearest, stamped with
the round. The codebooks of all rounds are retained, so a later round knows how far each entry has come *in all* since
a bound's own stamp: the norm of the summed moves, never more than the sum of their norms. While the exact distance
to the part's own entry is below the bound less the greatest such displacement of any other entry, the code stands and
so does the stamp; else the part is scanned anew, exactly, and its bound gets a new stamp. Distances are squared
integers; only the bounds are floating numbers, rounded to the safe side, so ties always lead to a scan.

A round's vectors, codes, bounds and stamps are a table of the shared folder; the driver sees only sums per entry (``entries`` x
the vectors' length numbers), pre-aggregated by task.

Defined cases: rows whose vector is null, holds null, infinite or not-a-number components, or has another length than
most (the most frequent length that ``parts`` divides, of equally frequent ones the greatest; so empty vectors too) are left out. A
component x is floor(256 * x); integers beyond +-sqrt(2**60 / length) (2**27 for 64 components: x of half a million)
are set to that, so that every distance fits 64 bits. Null vec_ids come last when first entries are chosen, of equal
vec_ids the least vector is first; repeated rows are rows of their own; with fewer rows than entries the codebooks are
shorter; an empty table gives no rows. Null labels are one label. Further columns are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import lean, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Labels up to this many are broadcast; more are joined by a shuffle, each dealt to ``SALTS`` keys.
MOST_LABELS, SALTS = 100_000, 16
STATE = "ints array<int>, code binary, low binary, stamp binary, rescans int"


def whole_vectors(rows: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the rows that can be coded, and the vectors' length (0: there are none)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & good)
    top = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = top.n if top else 0
    most = float(math.isqrt((1 << 60) // max(width, 1)))
    ints = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(most)), F.lit(-most)) * scale), F.lit(int(most))), F.lit(-int(most))).cast("int"))
    return rows.where(F.size("embedding") == width).select("vec_id", "label", ints.alias("ints")), width


def first_entries(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """(parts, entries, length / parts): the vectors of the least vec_ids."""
    top = vectors.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    x = np.array([r.ints for r in top], np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """(rounds, parts, entries): the norm of each entry's net move from each round's codebook to the last one."""
    return np.stack([np.sqrt(((history[-1] - old) ** 2).sum(axis=2).astype(np.float64)) for old in history])


def others(moves: np.ndarray) -> np.ndarray:
    """(..., entries): the greatest of all other entries' moves; 0 if there are none."""
    n = moves.shape[-1]
    if n < 2:
        return np.zeros_like(moves)
    at = moves.argmax(axis=-1)
    second = np.partition(moves, n - 2, axis=-1)[..., n - 2]
    return np.where(np.arange(n) == at[..., None], second[..., None], moves.max(axis=-1, keepdims=True))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, of equal ones the least; a number not above the distance to any other one)."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d += (x[:, k, None] - book[None, :, k]) ** 2
    code = d.argmin(axis=1)
    if len(book) < 2:
        return code, np.full(len(x), np.inf, np.float32)
    low = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - 1e-6)
    return code, low.astype(np.float32)


def reassigned(x: np.ndarray, history: list[np.ndarray], code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
    """Codes, bounds, stamps and squared distances under the last codebook, and which parts were scanned; arrays are rows x parts."""
    now, book = len(history) - 1, history[-1]
    far = others(displacements(history))
    code, low, stamp = code.copy(), low.copy(), stamp.copy()
    rows, parts = code.shape
    error, scanned = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), bool)
    for p in range(parts):
        own = ((x[:, p] - book[p][code[:, p]]) ** 2).sum(axis=1)
        bound = low[:, p].astype(np.float64) - far[stamp[:, p], p, code[:, p]] * (1 + 1e-9)
        again = ~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) < bound)
        if again.any():
            code[again, p], low[again, p] = scan(x[again, p], book[p])
            stamp[again, p] = now
            own[again] = ((x[again, p] - book[p][code[again, p]]) ** 2).sum(axis=1)
        error[:, p], scanned[:, p] = own, again
    return code, low, stamp, error, scanned


def _cells(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The batch's vectors as rows x parts x components."""
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _bytes(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def assigned(table: DataFrame, history: list[np.ndarray], parts: int = PARTS) -> DataFrame:
    """The table (vec_id, label, ints and, after the first round, code, low, stamp, rescans) with the codes of the last codebook."""
    first = "code" not in table.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cells(batch, parts)
            if first:
                found = [scan(x[:, p], history[0][p]) for p in range(parts)]
                code, low = np.stack([c for c, _ in found], 1), np.stack([b for _, b in found], 1)
                stamp, rescans = np.zeros_like(code), np.zeros(len(x), np.int32)
            else:
                code, low, stamp = _bytes(batch, "code", "<u2").astype(np.int64), _bytes(batch, "low", "<f4"), _bytes(batch, "stamp", "u1").astype(np.int64)
                code, low, stamp, _, scanned = reassigned(x, history, code, low, stamp)
                rescans = batch.column("rescans").to_numpy() + scanned.sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column("ints"), _binary(code.astype("<u2")), _binary(low.astype("<f4")), _binary(stamp.astype("u1")), pa.array(rescans)], names=["vec_id", "label", "ints", "code", "low", "stamp", "rescans"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}, {STATE}")


def moved(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: floored means of the parts of each entry; unused entries stay."""
    parts, entries, size = book.shape

    @lean
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, size + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, at = _cells(batch, parts), _bytes(batch, "code", "<u2").astype(np.int64) + np.arange(parts) * entries
                np.add.at(total[:, :size], at, x)
                total[:, size] += np.bincount(at.ravel(), minlength=parts * entries)
        used = np.flatnonzero(total[:, size])
        if len(used):
            place = np.tile(np.arange(size + 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, size + 1)), pa.array(place), pa.array([decimal.Decimal(int(v)) for v in total[used].ravel()], pa.decimal128(38, 0))], names=["entry", "place", "total"])

    sums_of = table.select("ints", "code").mapInArrow(sums, "entry long, place long, total decimal(38,0)").groupBy("entry", "place").agg(F.sum("total").alias("total"))
    total: dict[int, dict[int, int]] = {}
    for r in sums_of.collect():  # a row per component of a used entry, whatever the table's size
        total.setdefault(r.entry, {})[r.place] = int(r.total)
    out = book.reshape(parts * entries, size).copy()
    for entry, cells in total.items():
        out[entry] = [cells[k] // cells[size] for k in range(size)]
    return out.reshape(book.shape)


def learnt(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The vectors with their codes before the last assignment, and the codebooks of all rounds (the last is final)."""
    history, table = [first_entries(vectors, entries, parts)], vectors
    for _ in range(rounds):
        table = stored(assigned(table, history, parts), "codes")
        history.append(moved(table, history[-1]))
    return table, history


def coded(table: DataFrame, history: list[np.ndarray], parts: int = PARTS) -> DataFrame:
    """(vec_id, label, code, error, rescans): hex codes under the last codebook, squared distance, parts scanned after the first round."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _cells(batch, parts)
                code, _, _, error, scanned = reassigned(x, history, _bytes(batch, "code", "<u2").astype(np.int64), _bytes(batch, "low", "<f4"), _bytes(batch, "stamp", "u1").astype(np.int64))
                texts = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
                rescans = batch.column("rescans").to_numpy() + scanned.sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(error.sum(axis=1)), pa.array(rescans)], names=["vec_id", "label", "code", "error", "rescans"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}, code string, error long, rescans int")


def digest(book: np.ndarray) -> str:
    """SHA-256 of the entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error: the error summed over rows of the same label."""
    sums = stored(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        return codes.join(F.broadcast(sums), same).drop("_label")
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return codes.join(sums, same & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("_salt"))).drop("_label", "_salt")


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, rescans) of every row of (vec_id, label, embedding) that can be coded, and all codebooks."""
    vectors, width = whole_vectors(rows, parts)
    if not width:
        none = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).alias("rescans")).where("false")
        return none, [np.zeros((parts, 0, 0), np.int64)]
    table, history = learnt(vectors, parts, entries, rounds)
    return stored(coded(table, history, parts), "codes"), history


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of 16 parts of every vector of ``embeddings``, codebooks of 64 entries, two rounds."""
    codes, history = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(history[-1])).alias("codebooks_sha256"))


_ROUND = """
d{k} AS (SELECT v.vec_id, v.p, b.e, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN b{k} b ON b.p = v.p AND b.q = v.q GROUP BY v.vec_id, v.p, b.e),
a{k} AS (SELECT vec_id, p, e, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS r FROM d{k}) t WHERE r = 1)"""
_MOVE = """,
m{k} AS (SELECT v.p, v.q, e, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} a ON a.vec_id = v.vec_id AND a.p = v.p GROUP BY v.p, v.q, e),
b{n} AS (SELECT b.e, b.p, b.q, coalesce(CAST(floor(s / CAST(n AS DOUBLE)) AS BIGINT), b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.q = b.q AND m.e = b.e),"""
QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {
    "op11_vector_codes": """
WITH c AS (SELECT vec_id, label, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x, i // (n // 16) AS p, i % (n // 16) AS q FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM v) t ORDER BY vec_id LIMIT 64),
b0 AS (SELECT e, p, q, x FROM v JOIN f ON f.vec_id = v.vec_id),"""
    + _ROUND.format(k=0) + _MOVE.format(k=0, n=1) + _ROUND.format(k=1) + _MOVE.format(k=1, n=2) + _ROUND.format(k=2)
    + """,
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, q)) AS codebooks_sha256 FROM b2),
o AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM o JOIN embeddings m ON m.vec_id = o.vec_id CROSS JOIN h
"""
}
