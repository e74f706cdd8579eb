"""Shared helpers of the corpus operators: scratch tables, file access from tasks, vectorised word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import pickle
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (the characters 9 to 13 and 32).
WORD = r"[^\x20\x09-\x0D]+"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is absent (local tests) a temporary folder is set once for the session; on a
    cluster its absence is an error, since no machine-local folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="popweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/popweave-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ``BATCH_ROWS`` for what runs inside, where the session has Spark's own setting: whole texts make large rows."""
    before = spark.conf.get(BATCH)
    if before == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shipped:
    """A value of bounded size that tasks share, broadcast as bytes that also hold its class: executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self.packed, self.key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    @property
    def value(self):
        """The value; a worker process keeps the last one that it unpacked."""
        kept = vars(sys.modules.setdefault("_popweave_shipped", ModuleType("_popweave_shipped")))
        if kept.get("of") != self.key:
            kept["of"], kept["value"] = None, None
            kept["value"], kept["of"] = pickle.loads(self.packed.value), self.key
        return kept["value"]


def open_fs(uri: str):
    """(pyarrow file system, path in it) of a URI; usable inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FileWriter:
    """A file written as its parts come, in place only once it is whole; a retried task can only replace it by the same bytes."""

    def __init__(self, uri: str):
        self.store, self.path = open_fs(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.size = self.store.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def slices(batches: Iterable[pa.RecordBatch], column: str | int = "text", most_bytes: int = 2 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most_bytes`` of ``column`` (one row at least) and ``most_rows`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, k = np.cumsum(size), 0
        while k < len(ends):
            last = max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + most_bytes, "right")))
            last = min(last, k + most_rows)
            yield batch.slice(k, last - k)
            k = last


#: A key with at least 1 in this many of all rows is frequent; so there are at most as many frequent keys.
HOT = 10_000


def join_frequent_apart(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """rows inner-joined with table (``key``, unique; ``weight``, how many of the rows have it; more), without the weight.

    Frequent keys, ``HOT`` at most, are broadcast; the other rows are shuffled by keys of which none has a larger share. Both inputs
    are read twice and should be stored tables.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) * HOT >= total
    hot, rest = F.broadcast(table.where(often).drop(weight)), table.where(~often).drop(weight)
    seldom = rows.join(hot.select(key), key, "left_anti").join(rest, key)
    return rows.join(hot, key).unionByName(seldom)


def text_of(df: DataFrame, column: str = "text"):
    """The column with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, led by as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)
_ODD = np.uint64(0xD1342543DE82EF95)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 ... n-1) modulo 2**64; tables of ordinary length are kept."""
    if len(_tables.get(int(base), ())) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _tables[int(base)] = np.cumprod(x, dtype=np.uint64)
    return _tables[int(base)][:n]


def begin_task(keep_encoders: bool = False) -> None:
    """Give back what earlier tasks of this worker process hold: unused pages of Arrow and of the C heap, and encoders unless they are kept."""
    held = sys.modules.get("_popweave_encoders")
    if held is not None and not keep_encoders:
        for name in [n for n in vars(held) if not n.startswith("__")]:
            delattr(held, name)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def lean(task=None, *, keep_encoders: bool = False):
    """The generator ``task`` of a Python stage, with ``begin_task`` before it and after it: idle workers hold little."""
    if task is None:
        return functools.partial(lean, keep_encoders=keep_encoders)

    @functools.wraps(task)
    def run(batches):
        begin_task(keep_encoders)
        try:
            yield from task(batches)
        finally:
            begin_task(keep_encoders)

    return run


def compact(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one unsliced large_string array without nulls (some kernels misread sliced input)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))), "")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) as one string array, and where each text's words begin (n + 1 offsets)."""
    texts = compact(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end gives an empty string
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial over its bytes modulo 2**64, read off prefix sums, then mixed."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_string())
    _, offs, data = strings.buffers()
    offs = np.frombuffer(offs, np.int64)[strings.offset : strings.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    size, out, done = 1 << 20, np.empty(n, np.uint64), 0
    while done < n:  # in slices, so that the tables stay small
        last = max(done + 1, int(np.searchsorted(offs, offs[done] + size, "right")) - 1)
        b = raw[offs[done] - offs[0] : offs[last] - offs[0]]
        power, back = _powers(_ODD, len(b) + 1), _powers(_INV, len(b) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[:-1], dtype=np.uint64)])
        at = (offs[done : last + 1] - offs[done]).astype(np.int64)
        length = np.diff(at).astype(np.uint64)
        out[done:last] = mix64((sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]] + length * _STEP)
        done = last
    return out


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within each text and their offsets; a shorter text is one run of all its words."""
    count = np.diff(offsets)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(made.sum())
    width = np.repeat(np.minimum(count, n), made)
    out = np.zeros(len(begin), np.uint64)
    last = max(len(words) - 1, 0)
    for k in range(n):
        here = words[np.minimum(begin + k, last)] if len(words) else np.zeros(0, np.uint64)
        out = np.where(k < width, out * _ODD + here + np.uint64(k + 1), out)
    return mix64(out + width.astype(np.uint64) * _STEP), np.concatenate([[0], np.cumsum(made)])


def letters_only() -> bytes:
    """A table for ``bytes.translate``: ASCII letters lower-cased, all other ASCII but digits to spaces; further bytes stay."""
    return bytes(ord(chr(c).lower()) if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
