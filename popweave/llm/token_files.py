"""Token ids in binary files: one independent zstandard frame per document, and a seek table at the end.

A file is a run of zstandard frames, so any zstandard tool can read it: one frame per document (its ids as
little-endian unsigned 32-bit integers), a skippable frame with the document ids, and the skippable frame of
the seekable format, which holds each frame's compressed size, raw size and checksum (low 32 bits of XXH64 of
the raw bytes). A reader fetches the two tables from the end and then only the frames it wants.

Defined cases: a null or empty text is one end id; documents are ordered by id, nulls first, equal ids by the
hash of their text; repeated rows are written each; an empty table writes no file; further columns are ignored. Texts are
encoded in slices of ``SLICE_BYTES`` and frames go to the open file as they are made, so a task holds a slice and
the tables of one file; a very long text is a slice of its own.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import FileWriter, compact, lean, open_fs, shared_dir, slices, stored, text_of

# Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_DOCS, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
FILE_BYTES = 64 << 20
SLICE_BYTES = 1 << 20
#: Pieces that a process remembers: 600,000 take some 100 MB of a worker and spare a sixth of the time against 400,000.
MEMO_WORDS = 600_000
LEARNT_AT_ONCE = 256


class WordwiseEncoder:
    """Encodes whole texts with a byte-level tokenizer, each distinct space-led piece once.

    The tokenizer's own splitting never crosses a space that stands before a character other than white space,
    so the ids of a text are those of its pieces in a row. Texts where a space stands before white space or at the
    end, and those that hold the literal of a special token, are encoded directly. When the memory of pieces would exceed
    ``memo_words`` it keeps those that came up again since the last time.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.memo_words = memo_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(["^ ", " [\\s\\x0b\\x{85}\\p{Z}]", " $", *special])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for word, i in vocabulary.items() if word.startswith("Ġ")]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def thin_out(self) -> None:
        """Forget the pieces that came up in one slice only; all of them, where that would leave more than half."""
        kept = np.flatnonzero(self.again[: len(self.at)])
        words, flat, begin, size = list(self.at), self.flat, self.begin, self.size
        self.clear()
        if len(kept) <= self.memo_words // 2:
            begin, size = begin[kept], size[kept]
            ids = flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            self._keep([words[k] for k in kept], ids, size)

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k = len(self.at), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + k > len(self.begin):
            self.begin, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.again))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.at.update(zip(words, range(n, n + k), strict=True))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), LEARNT_AT_ONCE):
            some = words[k : k + LEARNT_AT_ONCE]
            ids = self.direct([" " + " ".join(some)])[0]
            first = np.flatnonzero(self.leads[ids])
            if len(first) == len(some) and first[0] == 0:
                self._keep(some, ids, np.diff(np.append(first, len(ids))))
            else:
                for word, ids in zip(some, self.direct([f" {x}" for x in some]), strict=True):
                    self._keep([word], ids, np.array([len(ids)]))

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = compact(texts)
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.values
        heads = self.direct(parts.take(pa.array(ends[:-1])).to_pylist()) if len(lists) else []
        coded = parts.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.at) + len(words) > self.memo_words:
            self.thin_out()
        if len(self.at) + len(words) > self.memo_words:
            self.clear()
        used = np.ones(len(codes), bool)
        used[ends[:-1]] = False
        where = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        needed = np.zeros(len(words), bool)
        needed[codes[used]] = True
        self.again[where[where >= 0]] = True
        new = np.flatnonzero(needed & (where < 0))
        where[new] = len(self.at) + np.arange(len(new))
        self._learn([words[k] for k in new])
        where = np.maximum(where, 0)[codes]
        begin, size = self.begin[where], np.where(used, self.size[where], 0)
        total = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        cut = np.concatenate([[0], total])[ends]
        plain = iter([np.concatenate([head, ids[a:b]]) for head, a, b in zip(heads, cut[:-1], cut[1:], strict=True)])
        rest = iter(self.direct(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else [])
        return [next(rest) if x else next(plain) for x in odd]


def encoder_of(path: str, memo_words: int = MEMO_WORDS) -> WordwiseEncoder:
    """This process's encoder: loaded once, its memory of pieces serves all tasks of the process."""
    kept = vars(sys.modules.setdefault("_popweave_encoders", ModuleType("_popweave_encoders")))
    if path not in kept:
        kept[path] = WordwiseEncoder(path, memo_words)
    kept[path].memo_words = memo_words
    return kept[path]


def tables(doc_ids: list[int | None], frames: list[tuple[int, int, int]]) -> bytes:
    """The two closing frames: document ids, and the seek table of (compressed size, raw size, checksum)."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    docs = struct.pack("<I", len(doc_ids)) + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes()
    seek = np.array(frames, "<u4").tobytes() + struct.pack("<IBI", len(frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


class TokenFile:
    """Random access to one file: ``doc_ids`` in order, ``ids(k)`` of the k-th document, reading its frame only."""

    def __init__(self, uri: str):
        import zstandard

        store, path = open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums")
        top = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(top, 12 * n), "<u4").reshape(n, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        docs = self._at(int(self.begin[-1]), top - 8 - int(self.begin[-1]))
        if struct.unpack("<I", docs[:4])[0] != SKIPPABLE_DOCS:
            raise ValueError(f"{uri}: no table of documents")
        ids, known = np.frombuffer(docs, "<i8", n, 12), np.frombuffer(docs, np.uint8, n, 12 + 8 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        return self._raw(self._at(int(self.begin[k]), int(self.frames[k, 0])), k)

    def _raw(self, frame: bytes, k: int) -> np.ndarray:
        import xxhash

        raw = self.unpack.decompress(frame, max_output_size=int(self.frames[k, 1]))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, from reads of some MB."""
        k, n = 0, len(self.frames)
        while k < n:
            last = max(k + 1, int(np.searchsorted(self.begin, self.begin[k] + (4 << 20), "right")) - 1)
            data = self._at(int(self.begin[k]), int(self.begin[last] - self.begin[k]))
            for i in range(k, last):
                yield self.doc_ids[i], self._raw(data[self.begin[i] - self.begin[k] : self.begin[i + 1] - self.begin[k]], i)
            k = last


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0, level: int = 3, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) in document order; returns (shard, part, path, n_docs, n_tokens).

    One shuffle deals texts out by ranges of doc_id; each task encodes and writes its range.
    """

    @lean(keep_encoders=True)
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        encoder, pack = encoder_of(tokenizer, memo_words), zstandard.ZstdCompressor(level=level, write_checksum=False)
        shard, part, out, frames, ids = TaskContext.get().partitionId(), 0, None, [], []

        def path() -> str:
            return f"{uri}/shard-{shard:06d}-{part:04d}.tok.zst"

        def close() -> pa.RecordBatch:
            out.write(tables(ids, frames))
            out.close()
            n = sum(x[1] for x in frames) // 4
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "part": pa.array([part], pa.int64()), "path": [path()], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

        for some in slices(batches, "text", SLICE_BYTES):
            out = out or FileWriter(path())
            for doc_id, tokens in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text")), strict=True):
                raw = np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes()
                frame = pack.compress(raw)
                out.write(frame)
                frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                ids.append(doc_id)
            if out.size >= FILE_BYTES:
                yield close()
                part, out, frames, ids = part + 1, None, [], []
        if frames:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(rows.mapInArrow(write, "shard long, part long, path string, n_docs long, n_tokens long"), "token_files")


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids before it in all files), n_tokens, ids_crc32, and the ids if wanted."""

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in TokenFile(path).all():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                    start += len(ids)
                    if len(rows) >= 2000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def made(rows: Iterable[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    before = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    n = max(1, files.count())
    files = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"), (F.row_number().over(W.orderBy("shard", "part")) - 1).alias("file"))
    return files.repartitionById(n, F.col("file")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, tokenizer: str | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back."""
    return read_tokens(write_tokens(docs, f"{shared_dir(docs.sparkSession)}/tokens", tokenizer or default_tokenizer(), memo_words=memo_words))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as token files, read back."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_files": op6_token_files}
ORACLE_SQL: dict[str, str] = {}
