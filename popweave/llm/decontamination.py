"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a few neighbouring words; words at its ignored places may differ. Every place
of a document and of a benchmark item is hashed under each mask; equal hashes are hits. A hit fixes a diagonal
(place in the document less place in the item), and along it the two texts are compared word by word: the overlap
is the segment with the most matches of those with at least ``IDENTITY`` - 1 matches a difference and that with the
best score of +1 a match and -``PENALTY`` a difference. Items whose best overlap has at least ``MIN_WORDS`` matching
words, or ``WHOLE`` of a shorter item, count.

The masks leave no gap: of every way to change 2 of 12 words, 3 of 15 or 4 of 20 (``MASKS``), 1 of 5 to 9 or 2 of 10 or
11 (``SHORT_MASKS``), at least one mask fits between the changed words. The tests try them all.

The benchmark is handed to the tasks in slices of at most ``SLICE_WORDS`` words, each compared with all
documents: a slice has a proven bound, however large the benchmark. Documents are never shuffled.

Defined cases: null and empty texts match nothing; items of under ``SHORTEST`` words count where they stand word for word
(masks without ignored places, as long as the item), items shorter than ``SPAN`` are sought by lighter masks; equal items each match; an item in several places of a document
gives its best overlap (first of equals); repeated words match on every diagonal, each followed once; empty tables give no
rows; very long texts are whole slices of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import Shipped, compact, hash_strings, lean, mix64, slices, stored, text_of, words_of

#: Masks with 5 places that count; words at the places marked 0 are ignored.
MASKS = ("11111", "110111", "1010010101")
#: Masks with 4 places for items shorter than ``SPAN``, each with the longest items that need it.
SHORT_MASKS = {"1111": 11, "11011": 11, "10111": 5, "11101": 5}
SPAN = 12
SHORTEST = 5
MIN_WORDS = 12
WHOLE = 0.8
PENALTY = 2
IDENTITY = 5
COMPARED, FOLLOWED = 1 << 20, 1 << 20
SLICE_WORDS = 2_000_000
_ODD = np.uint64(0xD1342543DE82EF95)
_STRIP = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation at their ends; words of punctuation alone are left out."""
    import pyarrow.compute as pc

    words, offsets = words_of(pc.utf8_lower(compact(texts)), lower=False)
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(coded.dictionary, _STRIP, "")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    hashes, full = hash_strings(bare)[codes], (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[codes]
    return hashes[full], np.concatenate([[0], np.cumsum(full)])[offsets]


def seeds(words: np.ndarray, offsets: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every place where the mask fits within one text."""
    span = len(mask)
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, salt, np.uint64)
    for k, x in enumerate(mask):
        if x == "1":
            h = h * _ODD + words[k : k + n]
    inside = np.ones(len(words) + 1, bool)
    for k in range(1, span):  # a place less than span words before an end does not fit
        inside[np.maximum(offsets[1:] - k, offsets[:-1])] = False
    inside = inside[:n]
    return mix64(h[inside]), np.flatnonzero(inside)


class Index:
    """Seed hashes of a slice of the benchmark."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.words, self.offsets = plain_words(pa.array(texts, pa.string()))
        size = np.diff(self.offsets)
        self.item = np.repeat(np.arange(len(ids)), size)
        short = size[(size >= SHORTEST) & (size < SPAN)]
        needed = [m for m, most in SHORT_MASKS.items() if len(short) and short.min() <= most]
        whole = ["1" * n for n in range(1, SHORTEST) if (size == n).any()]  # such items count where they stand word for word
        self.masks = [*MASKS, *needed, *whole]
        parts = []
        for k, mask in enumerate(self.masks):
            h, at = seeds(self.words, self.offsets, mask, k + 1)
            n = size[self.item[at]]
            if k < len(MASKS):
                fit = n >= SPAN
            elif k < len(MASKS) + len(needed):
                fit = (n >= SHORTEST) & (n <= SHORT_MASKS[mask])
            else:
                fit = n == len(mask)
            parts.append((h[fit], at[fit]))
        h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]

    @cached_property
    def bits(self) -> np.ndarray:
        """Which leading 24 bits of a hash occur; made where it is used, never sent."""
        bits = np.zeros(1 << 24, bool)
        bits[(self.hash >> np.uint64(40)).astype(np.int64)] = True
        return bits

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the documents, in the items) that share a seed, each diagonal of a document and item once."""
        found = (np.zeros(0, np.int64),) * 2
        for k, mask in enumerate(self.masks):
            h, at = seeds(words, offsets, mask, k + 1)
            maybe = self.bits[(h >> np.uint64(40)).astype(np.int64)]
            h, at = h[maybe], at[maybe]
            left = np.searchsorted(self.hash, h, "left")
            n = np.searchsorted(self.hash, h, "right") - left
            ends, i = np.cumsum(n), 0
            while i < len(h):  # about FOLLOWED hits at a time: repeated words give very many on few diagonals
                last = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + FOLLOWED, "right")))
                some = n[i:last]
                where = np.repeat(left[i:last] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                new = self._diagonals(np.repeat(at[i:last], some), self.at[where], offsets)
                found = self._diagonals(*(np.concatenate(x) for x in zip(found, new, strict=True)), offsets)
                i = last
        return found

    def _diagonals(self, d: np.ndarray, i: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One hit, the first, of each diagonal of a document and an item: it stands for all."""
        doc = np.searchsorted(offsets, d, "right") - 1
        order = np.lexsort((d, d - i, self.item[i], doc))
        d, i, doc = d[order], i[order], doc[order]
        new = np.ones(len(d), bool)
        new[1:] = (np.diff(d - i) != 0) | (np.diff(self.item[i]) != 0) | (np.diff(doc) != 0)
        return d[new], i[new]

    def promising(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hits on whose diagonals enough words match for the item to count."""
        d, i = self.hits(words, offsets)
        doc, item = np.searchsorted(offsets, d, "right") - 1, self.item[i]
        back = np.minimum(d - offsets[doc], i - self.offsets[item])
        length = back + np.minimum(offsets[doc + 1] - d, self.offsets[item + 1] - i)
        enough = np.minimum(MIN_WORDS, WHOLE * np.diff(self.offsets)[item])
        ends, keep, k = np.cumsum(length), np.zeros(len(d), bool), 0
        while k < len(d):  # about COMPARED words at a time
            last = max(k + 1, int(np.searchsorted(ends, ends[k] - length[k] + COMPARED, "right")))
            n = length[k:last]
            begin = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(begin, n)
            same = words[np.repeat((d - back)[k:last], n) + step] == self.words[np.repeat((i - back)[k:last], n) + step]
            keep[k:last] = np.add.reduceat(same.astype(np.int64), begin) >= enough[k:last]
            k = last
        return d[keep], i[keep]


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matches) of the segment with the most matches; of those the shortest, then the first."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    gain = score - np.minimum.accumulate(score)
    end = int(np.argmax(gain))
    begin = int(np.argmin(score[: end + 1]))
    best = int(equal[begin:end].sum()), begin - end, -begin
    at = np.flatnonzero(equal)
    if len(at) > best[0]:  # for each match as the last one the earliest begin of the wanted identity
        score = np.concatenate([[0], np.cumsum(np.where(equal, 1, 1 - IDENTITY))])
        first = np.searchsorted(-np.minimum.accumulate(score), -score[at + 1], "left")
        skipped = np.searchsorted(at, first)  # matches before it: the segment begins at the next one
        n = np.arange(1, len(at) + 1) - skipped
        begins = at[np.minimum(skipped, len(at) - 1)]
        k = np.lexsort((begins, at - begins, -n))[0]
        best = max(best, (int(n[k]), int(begins[k] - at[k] - 1), -int(begins[k])))
    return -best[2], -best[2] - best[1], best[0]


def overlaps(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_matches): the best overlap of each pair that counts; starts and sizes in words."""
    return _overlaps(docs, benchmark, slice_words).drop("h")


def _overlaps(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``overlaps``, with h: the hash of the text, which tells rows of equal doc_id apart."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    size = F.size(F.split("text", r"\s+")).cast("long")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = 1 + 2 * total // slice_words
    schema = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matches long, h long"
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out = None
    for k in range(n):
        rows = items.where(part == k).collect()  # about half of slice_words
        index = Shipped(spark, Index([r.item_id for r in rows], [r.text for r in rows]))
        here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), F.xxhash64(text_of(docs)).alias("h")).mapInArrow(_finder(index), schema)
        out = here if out is None else out.unionByName(here)
    return out


def _finder(shared):
    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        size = np.diff(index.offsets)
        for batch in slices(batches):
            words, offsets = plain_words(batch.column("text"))
            best: dict[tuple[int, int], tuple] = {}
            for d, i in zip(*index.promising(words, offsets), strict=True):
                doc, item = int(np.searchsorted(offsets, d, "right")) - 1, int(index.item[i])
                back = min(d - offsets[doc], i - index.offsets[item])
                length = back + min(offsets[doc + 1] - d, index.offsets[item + 1] - i)
                a, b = words[d - back : d - back + length], index.words[i - back : i - back + length]
                begin, end, n = best_segment(a == b)
                if n >= min(MIN_WORDS, WHOLE * size[item]):
                    row = (n, begin - end, -int(d - back + begin - offsets[doc]), -int(i - back + begin - index.offsets[item]))
                    best[doc, item] = max(best.get((doc, item), row), row)
            ids, hashes = batch.column("doc_id"), batch.column("h")
            keys = sorted(best)
            cols = [pa.array([ids[d].as_py() for d, _ in keys], pa.int64()), pa.array([index.ids[i] for _, i in keys], pa.int64())]
            cols += [pa.array([f(best[k]) for k in keys], pa.int64()) for f in (lambda x: -x[2], lambda x: -x[3], lambda x: -x[1], lambda x: x[0])]
            cols.append(pa.array([hashes[d].as_py() for d, _ in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_matches", "h"])

    return find


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item of the benchmark; other rows of the same (or null) doc_id stay."""
    found = stored(_overlaps(docs, benchmark).select(F.col("doc_id").alias("_leak"), F.col("h").alias("_text")).distinct(), "leaks")
    same = docs["doc_id"].eqNullSafe(found["_leak"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_text"])
    return docs.join(found, same, "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document of ``documents`` that holds a passage of ``benchmark``, with the item and the overlap."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL: dict[str, str] = {}
