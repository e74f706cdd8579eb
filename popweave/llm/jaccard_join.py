"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents become sets of word shingles. Equal sets are one class, so exact copies never meet as pairs. Classes
get MinHash signatures; bands of a signature are the candidate buckets, and buckets with the same members are
kept once. In a bucket, pairs are compared a few MinHash values at a time and dropped as soon as the posterior
probability that their similarity reaches the threshold (uniform prior) is below ``tolerance``; the rest
are verified on their whole shingle sets. Large buckets are cut into blocks of bounded numbers of classes and shingles.
A first pass over the pairs of blocks sends signatures only and gives back the classes that have a pair left after
pruning; the second sends the texts of those and gives back per class its links and its local component, never the
pairs. A pair that shares several buckets counts in that of its first shared band only.

With 32 bands of 4 a pair at similarity 0.8 is missed with probability 5e-8, and pruning adds about the tolerance.

Defined cases: words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than ``n``
words is one shingle of them all; null and empty texts have no shingles, link to nothing and are their own class; rows
without doc_id have class null and no links; rows that share a doc_id are rows like any others, each with the class and
the links of its own text; class_id is the least doc_id of a component, so ties need no rule; a very long text is a slice, and
if need be a block, of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import free_name, hash_strings, lean, mix64, shingles, slices, stored, text_of, words_of
from popweave.llm.components import components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-7
BLOCK, BLOCK_SHINGLES, PAIRS = 512, 400_000, 1 << 17
_SEEDS = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = ((_SEEDS[i::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1) for i in range(2))


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, total: int = BANDS * ROWS) -> list[int]:
    """For each number of values compared, the fewest matches at which P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is the
    binomial probability of at most m successes in n + 1 trials.
    """

    def reach(m: int, n: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return [next(m for m in range(n + 1) if reach(m, n) >= tolerance) for n in range(step, total + 1, step)]


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets."""
    words, offsets = words_of(texts)
    s, cut = shingles(hash_strings(words), offsets, n)
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(cut)))


def minhashes(s: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Signatures (uint32) of the sets; an empty set's are all ones."""
    out = np.full((len(cut) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(cut) > 0)
    k = 0
    while k < len(full):  # slices that stay in cache
        last = max(k + 1, int(np.searchsorted(cut[full], cut[full[k]] + 30_000, "right")) - 1)
        last = min(last, len(full))
        docs = full[k:last]
        part = s[cut[docs[0]] : cut[docs[-1] + 1]]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        at = cut[docs] - cut[docs[0]]
        for j in range(BANDS * ROWS):
            out[docs, j] = np.minimum.reduceat(low * _A[j] + (high ^ (high >> np.uint32(15))) * _B[j], at)
        k = last
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        h = mix64(h * np.uint64(0xD1342543DE82EF95) + x[:, :, r])
    return h


def _signer(n: int):
    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s, cut = shingle_sets(batch.column("text"), n)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (s, mix64(s ^ np.uint64(0x5851F42D4C957F2D)))]
            a, b = ((x[cut[1:]] - x[cut[:-1]]).view(np.int64) for x in sums)
            raw = pa.array([x.tobytes() for x in minhashes(s, cut)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.diff(cut)), pa.array(a), pa.array(b), raw], names=["doc_id", "h", "n", "a", "b", "sig"])

    return sign


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


@lean
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, band, gkey): a row for each band of each signature."""
    for batch in batches:
        keys = band_keys(_signatures(batch.column("sig"))).view(np.int64)
        at = pa.array(np.repeat(np.arange(len(keys)), BANDS))
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
        yield pa.RecordBatch.from_arrays([batch.column("cid").take(at), batch.column("n").take(at), pa.array(band), pa.array(keys.ravel())], names=["cid", "n", "band", "gkey"])


def intersections(s: np.ndarray, cut: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i[k] and j[k]."""
    used = np.unique(np.concatenate([i, j]))
    if len(i) <= 2 * len(used):
        return np.array([len(np.intersect1d(s[cut[x] : cut[x + 1]], s[cut[y] : cut[y + 1]], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    row = np.full(len(cut) - 1, -1)
    row[used] = np.arange(len(used))
    doc = np.repeat(row, np.diff(cut))
    values, col, times = np.unique(s[doc >= 0], return_inverse=True, return_counts=True)
    doc = doc[doc >= 0]
    shared = times > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    doc, col = doc[shared[col]], number[col[shared[col]]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    both = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for begin in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [begin, begin + width])
        m = np.zeros((len(used), width), np.float32)
        m[doc[a:b], col[a:b] - begin] = 1
        both += m @ m.T
    return both[row[i], row[j]].round().astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The pairs of blocks, which follow each other in a sorted partition; each has at most two blocks of rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        g = [rest.column(c).to_numpy() for c in ("gkey", "band", "lo", "hi")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in g], axis=0)) + 1
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True) if len(cuts) else ():
            yield rest.slice(a, b - a)
        if len(cuts):
            rest = rest.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def unpruned(rows: pa.Table, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one pair of blocks that pruning leaves, as numbers of rows; a pair seen in an earlier band is left out."""
    sig = _signatures(rows.column("sig"))
    band, lo, hi = (rows.column(c)[0].as_py() for c in ("band", "lo", "hi"))
    side = rows.column("side").to_numpy()
    keys = band_keys(sig)[:, :band]
    left, right = (np.flatnonzero(side == x) for x in (lo, hi))
    found, wide = [], max(1, PAIRS // max(1, len(right)))
    for k in range(0, len(left), wide):  # at most PAIRS pairs, or one row's, at a time
        i, j = (x.ravel() for x in np.meshgrid(left[k : k + wide], right, indexing="ij"))
        if lo == hi:
            i, j = i[i < j], j[i < j]
        for b in range(band):
            apart = keys[i, b] != keys[j, b]
            i, j = i[apart], j[apart]
        same = np.zeros(len(i), np.int64)
        for k_, least in enumerate(need):
            at = slice(k_ * STEP, (k_ + 1) * STEP)
            same += (sig[i, at] == sig[j, at]).sum(1)
            alive = same >= least
            i, j, same = i[alive], j[alive], same[alive]
        found.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


_PLACE = ["cid", "band", "gkey", "side", "lo", "hi", "sig"]


def _pruner(threshold: float, tolerance: float):
    need = needed_matches(threshold, tolerance)

    @lean
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows, with signatures, of classes that have an unpruned pair."""
        for rows in _grouped(batches):
            used = np.unique(np.concatenate(unpruned(rows, need)))
            if len(used):
                yield from rows.select(_PLACE).take(pa.array(used)).combine_chunks().to_batches()

    return prune


def _comparer(n: int, threshold: float, tolerance: float):
    need = needed_matches(threshold, tolerance)

    def links(rows: pa.Table) -> tuple[list, list, list]:
        """(class, copies linked, local root) of the classes of one pair of blocks that have links."""
        cid, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
        i, j = unpruned(rows, need)
        if not len(i):
            return [], [], []
        s, cut = shingle_sets(rows.column("text").combine_chunks(), n)
        size = np.diff(cut)
        both = intersections(s, cut, i, j)
        near = both >= threshold * (size[i] + size[j] - both) - 1e-9
        i, j = i[near], j[near]
        count = np.bincount(i, copies[j], len(cid)) + np.bincount(j, copies[i], len(cid))
        root, before = cid.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
        linked = np.flatnonzero(count)
        return cid[linked].tolist(), count[linked].astype(np.int64).tolist(), root[linked].tolist()

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["cid", "links", "root"])

        for group in _grouped(batches):
            for x, y in zip(out, links(group), strict=True):
                x.extend(y)
            if len(out[0]) > 20_000:
                yield made()
                out = ([], [], [])
        yield made()

    return compare


MOST_BITS = 1 << 28


def likely(rows: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose ``key`` is in ``ids``, and a few others: what a bitmap of hashed ids lets through.

    Keeps wide rows that a later exact join would drop out of its shuffle. The bitmap has at most MOST_BITS bits (32 MB).
    """
    ids = stored(ids.select(*key), "ids")
    bits = min(MOST_BITS, 1 << max(15, (32 * ids.count()).bit_length()))
    place = lambda: F.pmod(F.xxhash64(*key), F.lit(bits))
    parts = ids.select(place().alias("p")).groupBy(F.floor(F.col("p") / (1 << 15)).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("bits"))
    shared = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most MOST_BITS / 2**15 rows of 4 KB
        shared[r.k << 12 : (r.k + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(shared)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("_place").to_numpy()
            yield batch.filter(pa.array((shared.value[p >> 3] >> (p & 7)).astype(np.uint8) & 1 == 1)).drop_columns(["_place"])

    return rows.withColumn("_place", place()).mapInArrow(some, rows.schema)


def candidates(classes: DataFrame) -> DataFrame:
    """(cid, band, gkey, side, lo, hi): the classes of each pair of blocks of each bucket; buckets of equal members are kept once."""
    banded = classes.select("cid", "n", "sig").mapInArrow(_banded, "cid long, n long, band int, gkey long")
    buckets = banded.groupBy("band", "gkey").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.min("cid").alias("first"), F.max("cid").alias("last"))
    kept = buckets.where("size > 1").groupBy("size", "weight", "x", "first", "last").agg(F.min(F.struct("band", "gkey")).alias("k")).select("k.band", "k.gkey", "size", "weight")
    return stored(banded.drop("n").join(kept.hint("merge"), ["band", "gkey"]), "members")  # the same plan at every size


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of ``docs`` (doc_id, text).

    class_id is the least doc_id of the component of links; n_links counts the other rows that reach the threshold.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), F.xxhash64(text_of(docs)).alias("h"))
    signed = stored(d.where("doc_id is not null").mapInArrow(_signer(n), "doc_id long, h long, n long, a long, b long, sig binary"), "signed")
    # equal sets are one class, numbered once and for all by the stored table, with one row to fetch a text by
    classes = signed.where("n > 0").groupBy("a", "b", "n").agg(F.min(F.struct("doc_id", "h")).alias("row"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = candidates(classes)
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid", "band"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cid", "band", "gkey", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    place = ["gkey", "band", "lo", "hi"]
    signatures = likely(classes.select("cid", "sig"), members.select("cid").distinct(), ["cid"])
    met = rows.join(signatures.hint("merge"), "cid").repartition(*place).sortWithinPartitions(*place, "cid")
    alive = stored(met.mapInArrow(_pruner(threshold, tolerance), "cid long, band int, gkey long, side int, lo int, hi int, sig binary"), "alive")
    wanted = classes.select("cid", "copies", "row.doc_id", "row.h").join(alive.select("cid").distinct().hint("merge"), "cid")  # the same plan at every size
    texts = likely(d, wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).join(wanted.hint("merge"), ["doc_id", "h"])
    texts = stored(texts.select("cid", "copies", "text"), "texts")
    met = alive.join(texts, "cid").repartition(*place).sortWithinPartitions(*place, "cid")
    found = stored(met.mapInArrow(_comparer(n, threshold, tolerance), "cid long, links long, root long"), "links")
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    roots = roots.select(F.col("id").alias("cid"), "root").unionByName(roots.select(F.col("root").alias("cid"), "root").distinct())
    named = roots.join(classes.select("cid", F.col("row.doc_id").alias("least")), "cid")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("cid", "class_id")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    about = classes.select("a", "b", "n", "cid", "copies", F.col("row.doc_id").alias("own")).join(links, "cid", "left").join(named, "cid", "left")
    out = signed.select("doc_id", "a", "b", "n").join(about, ["a", "b", "n"], "left")
    out = out.select("doc_id", F.coalesce("class_id", "own", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    return out.unionByName(d.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, whatever the ids: that with the least doc_id (null last), then the least hash of its text."""
    key = free_name(docs, "_row")
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), **options)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64(text_of(rows)), F.col(key).alias("row"))
    ranked = found.join(rows.select(F.col(key).alias("doc_id"), order.alias("order")), "doc_id")
    kept = ranked.groupBy("class_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias("doc_id"))
    gone = stored(found.join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias("_gone")), "copies")
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti").drop(key)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document of ``documents``: five-word shingles, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 10 * shared >= 8 * (x.n + y.n - shared)),
r(i, root) AS (SELECT i, i FROM (SELECT DISTINCT i FROM l) UNION SELECT l.i, r.root FROM r JOIN l ON l.j = r.i),
c AS (SELECT i, min(root) AS root FROM r GROUP BY i),
k AS (SELECT i, count(*) AS n_links FROM l GROUP BY i)
SELECT w.doc_id, coalesce(root, w.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN c ON c.i = w.doc_id LEFT JOIN k ON k.i = w.doc_id
"""
}
