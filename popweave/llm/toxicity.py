"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two short strings sums, over all subsequences of three characters within a span of ``SPAN``, the
products of their decayed weights (``DECAY`` per character spanned), so insults with gaps or inserted characters
stay near the plain ones; it is scaled by a function of the lengths. A sentence is seen as its words, long words
as overlapping windows, and runs of single letters joined into a word; a sentence, and a text, is as toxic as its
worst such piece. Labels belong to whole texts, so learning is by multiple instances: the sentences of clean
texts are clean; of toxic texts, the pieces that explain most of the yet unexplained texts are the witnesses. The
machine is trained on witnesses against clean pieces, all of the sample: those that violate the margin join the working
set until none does by more than ``SLACK``. In the space of the landmarks (Nystrom) its decision is one weight per
subsequence, a small table that scores any text in one pass. The table is addressed by a hash of the three characters'
code points, so every script has its weights; a character that no landmark holds has none, as the kernel says.

Learning uses at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled texts (those of least hash), everything else all rows. What the
driver holds is bounded by that sample: the pieces of toxic texts that are candidates, and the working set.

Defined cases: null and empty texts score as the cleanest piece does; repeated rows score alike; a text with
contradicting labels counts as toxic; candidates that tie are taken in the order of their characters; without labels
of both kinds every score is 0; very long texts are slices of their own and long words overlapping windows, in
learning as in scoring; further columns are ignored. Insults of several whole words are not learnt as one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.llm.common import Shipped, compact, free_name, lean, slices, stored, text_of, words_of

SPAN, DECAY = 6, 0.7
MOST_TOXIC, MOST_CLEAN = 3000, 6000
FIRST_CLEAN, SLACK = 3000, 0.1
LANDMARKS = 320
TABLE_BITS = 20
WINDOW, STRIDE = 24, 12
LEAST_GAIN = 2
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SCALE = [np.float32(DECAY ** (b + 1)) for _, b in _GAPS]


@dataclass
class Pieces:
    """Strings as one array of characters with a start and an end mark each."""

    codes: np.ndarray
    begin: np.ndarray
    of: np.ndarray  # number of the string that a piece belongs to
    n: int
    norm: np.ndarray = field(init=False)

    def __post_init__(self):
        size = np.diff(np.append(self.begin, len(self.codes)))
        most = int(size.max(initial=3))
        table = np.zeros(most + 1)
        for (_, b), s in zip(_GAPS, _SCALE, strict=True):
            table += np.maximum(np.arange(most + 1) - b, 0) * float(s) ** 2
        self.norm = 1 / np.sqrt(np.maximum(table[size], 1e-9))


START, END = 2, 3


def pieces(strings: list[str]) -> Pieces:
    """Marks around each string; strings of over ``WINDOW`` characters become overlapping windows."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(size) - size
    n = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, 1)
    of = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = at[of] + np.minimum(k * STRIDE, np.maximum(size[of] - WINDOW, 0))
    length = np.minimum(size[of], WINDOW)
    begin = np.cumsum(length + 2) - (length + 2)
    codes = np.empty(int((length + 2).sum()), np.uint32)
    codes[begin], codes[begin + length + 1] = START, END
    inner = np.repeat(begin + 1 - (np.cumsum(length) - length), length) + np.arange(length.sum())
    source = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
    codes[inner] = raw[source]
    return Pieces(codes, begin, of, len(strings))


def windows_of(string: str) -> list[str]:
    """The pieces that ``pieces`` makes of a string."""
    last = max(0, len(string) - WINDOW)
    return [string[k : k + WINDOW] for k in [*range(0, last, STRIDE), last]]


_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


class Alphabet:
    """The characters of the landmarks; subsequences of three of them are numbered by a hash of their code points."""

    def __init__(self, strings: list[str]):
        self.characters = np.unique(pieces(strings).codes)

    @cached_property
    def known(self) -> np.ndarray:
        known = np.zeros(0x110000, bool)
        known[self.characters] = True
        return known

    def subsequences(self, p: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
        """Per gap pattern: (places of first characters, numbers of the subsequences, weight)."""
        known = self.known[p.codes]
        x, y, z = (p.codes * m for m in _MIX)
        last = np.repeat(np.append(p.begin[1:], len(known)), np.diff(np.append(p.begin, len(known)))) - np.arange(len(known))
        for (a, b), s in zip(_GAPS, _SCALE, strict=True):
            i = np.flatnonzero((last > b) & known)
            i = i[known[i + a] & known[i + b]]
            yield i, (x[i] + y[i + a] + z[i + b]) >> np.uint32(32 - TABLE_BITS), s

    def decisions(self, p: Pieces, table: np.ndarray) -> np.ndarray:
        """Per piece the sum of table entries over its subsequences, decayed and scaled."""
        out = np.zeros(len(p.codes), np.float32)
        for i, u, s in self.subsequences(p):
            out[i] += s * table[u]
        return np.add.reduceat(out, p.begin) * p.norm if len(p.begin) else out

    def features(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kernel's features as (string, subsequence, value) triples, of strings of at most WINDOW characters."""
        p = pieces(strings)
        piece = np.repeat(np.arange(p.n), np.diff(np.append(p.begin, len(p.codes))))
        keys, values = [], []
        for i, u, s in self.subsequences(p):
            keys.append(piece[i].astype(np.int64) << TABLE_BITS | u.astype(np.int64))
            values.append(np.full(len(i), s))
        keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        values = np.bincount(where, np.concatenate(values), len(keys))
        return keys >> TABLE_BITS, keys & ((1 << TABLE_BITS) - 1), values * p.norm[keys >> TABLE_BITS]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps: (weights, intercept)."""
    n = x.shape[1]
    w, ridge = np.zeros(n + 1), np.append(np.ones(n), 1e-3)
    for _ in range(steps):
        gap = 1 - y * (x @ w[:-1] + w[-1])
        grad, curve = ridge * w, np.diag(ridge)
        on = np.flatnonzero(gap > 0)
        for k in range(0, len(on), 2048):  # in slices, so that the copies stay small
            at = on[k : k + 2048]
            z = np.hstack([x[at], np.ones((len(at), 1))]).astype(np.float64)
            grad -= 2 * c * z.T @ (weight[at] * y[at] * gap[at])
            curve += 2 * c * (z * weight[at, None]).T @ z
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    alphabet: Alphabet
    used: np.ndarray  # numbers of the landmarks' subsequences, and their weights
    weights: np.ndarray
    bias: float
    marks: list[str]
    alpha: np.ndarray  # the decision is the sum of alpha times the kernel with each landmark, plus the bias
    slope: float = 1.0
    shift: float = 0.0

    @cached_property
    def table(self) -> np.ndarray:
        """All weights by number; made where it is used, never sent."""
        table = np.zeros(1 << TABLE_BITS, np.float32)
        table[self.used] = self.weights
        return table

    def words(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), -np.inf, np.float32)
        for k in range(0, len(strings), 1 << 14):  # slices that keep the work arrays small
            p = pieces(strings[k : k + (1 << 14)])
            np.maximum.at(out, k + p.of, self.alphabet.decisions(p, self.table) + self.bias)
        return out

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The worst piece's decision value per text; -1 - the margin of clean pieces - without pieces."""
        strings, codes, doc = units(texts)
        out = np.full(len(texts), -1.0)
        if len(codes):
            best = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(best, doc, self.words(strings.to_pylist())[codes])
            out = np.where(np.isfinite(best), best, out)
        return out

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -60, 60)))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, number of each unit's string, each unit's text): lower-cased words and joined runs.

    Words are taken without their punctuation; three or more single characters in a row also make one unit.
    """
    words, offsets = words_of(pc.utf8_lower(compact(texts)), lower=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(coded.dictionary, _MARKS, "").dictionary_encode()
    codes = bare.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
    strings = bare.dictionary
    at = np.flatnonzero((pc.utf8_length(strings).to_numpy(zero_copy_only=False) == 1)[codes]) if len(words) else np.zeros(0, np.int64)
    if len(at) < 3:
        return strings, codes, doc
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    runs = [(at[f], n) for f, n in zip(first, np.diff(np.append(first, len(at))), strict=True) if n >= 3]
    joined = ["".join(strings.take(pa.array(codes[a : a + n])).to_pylist()) for a, n in runs]
    strings = pa.concat_arrays([strings, pa.array(joined, strings.type)])
    return strings, np.concatenate([codes, len(strings) - len(runs) + np.arange(len(runs))]), np.concatenate([doc, doc[np.array([a for a, _ in runs], np.int64)]])


_MARKS = r"[^\p{L}\p{M}\p{N}]+"


@lean
def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, unit): the distinct units of each text."""
    for batch in slices(batches):
        strings, codes, doc = units(batch.column("text"))
        size = pc.utf8_length(strings).to_numpy(zero_copy_only=False)
        cut = [windows_of(x) for x in strings.filter(pa.array(size > WINDOW)).to_pylist()]
        first, n = np.arange(len(size)), np.ones(len(size), np.int64)
        n[size > WINDOW] = [len(x) for x in cut]
        first[size > WINDOW] = len(size) + np.cumsum([0, *map(len, cut)])[: len(cut)]
        strings = pa.concat_arrays([strings, pa.array([y for x in cut for y in x], strings.type)])
        times = n[codes]
        codes, doc = np.repeat(first[codes] - (np.cumsum(times) - times), times) + np.arange(times.sum()), np.repeat(doc, times)
        again = strings.dictionary_encode()  # joined runs and windows may repeat words
        pair = np.unique(doc.astype(np.int64) << 32 | again.indices.to_numpy(zero_copy_only=False)[codes]) if len(codes) else np.zeros(0, np.int64)
        doc = pa.array(pair >> 32)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(doc), batch.column("toxic").take(doc), again.dictionary.take(pa.array(pair & 0xFFFFFFFF)).cast(pa.string())], names=["key", "toxic", "unit"])


def witnesses(texts: list[np.ndarray], cost: np.ndarray, least: int = LEAST_GAIN) -> list[int]:
    """Greedy cover: the candidates by the yet unexplained toxic texts they explain, less their cost in clean ones."""
    left = np.ones(1 + max((int(x.max()) for x in texts), default=0), bool)
    heap, out = [(cost[k] - len(x), k) for k, x in enumerate(texts)], []
    heapq.heapify(heap)
    while heap:
        before, k = heapq.heappop(heap)
        now = cost[k] - int(left[texts[k]].sum())
        if now > before:  # gains only fall: look at it again when its turn comes
            heapq.heappush(heap, (now, k))
            continue
        if -now < least:
            break
        out.append(k)
        left[texts[k]] = False
    return out


def _machine(positive: list[str], negative: list[str], support: dict[str, int]) -> Model:
    half = LANDMARKS // 2
    marks = list(dict.fromkeys([*positive[:half], *negative[: LANDMARKS - min(half, len(positive))]]))
    alphabet = Alphabet([*positive, *marks])
    mark, feature, value = alphabet.features(marks)
    used, column = np.unique(feature, return_inverse=True)
    basis = np.zeros((len(marks), len(used)), np.float32)
    basis[mark, column] = value
    kernel = (basis @ basis.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the inverse square root of the landmarks' kernel
    strings = [*positive, *negative]
    near = np.zeros((len(strings), len(marks)), np.float32)
    for k in range(0, len(strings), 256):  # few rows at a time: a dense row has all the landmarks' subsequences
        row, feature, value = alphabet.features(strings[k : k + 256])
        at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        known = used[at] == feature
        dense = np.zeros((min(256, len(strings) - k), len(used)), np.float32)
        dense[row[known], at[known]] = value[known]
        near[k : k + 256] = dense @ basis.T
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    weight = np.array([min(5.0, support.get(x, 1)) for x in positive] + [1.0] * len(negative))
    weight[: len(positive)] *= max(1.0, 0.5 * len(negative) / max(1.0, weight[: len(positive)].sum()))
    w, bias = svm(near @ root.astype(np.float32), y, weight)
    alpha = root @ w
    vars(alphabet).pop("known", None)  # not to be sent
    return Model(alphabet, used, (alpha @ basis).astype(np.float32), bias, marks, alpha)


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins, by Newton steps with a slight pull."""
    a, b = 4.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        r, v = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(r * margin).sum() + 1e-2 * (a - 4), r.sum() + 1e-3 * b])
        h = np.array([[(v * margin**2).sum() + 1e-2, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model | None:
    """The model from labelled texts: docs (doc_id, text), labels (doc_id, toxic 0/1)."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = stored(marked.join(docs.select("doc_id").distinct(), "doc_id"), "marked")
    total = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not total.get(0) or not total.get(1):
        return None
    some = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    # at most most_toxic + most_clean ids are broadcast
    sample = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    sample = stored(sample.select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text"), "sample")
    got = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    split = stored(sample.mapInArrow(_split, "key long, toxic int, unit string"), "units")
    counts = stored(split.groupBy("unit").agg(F.sum("toxic").alias("t"), F.count_if(F.col("toxic") == 0).alias("c")), "unit_counts")
    rate = got[1] / got[0]
    chosen = counts.where((F.col("t") >= 2) & (F.col("t") > 3 * rate * F.col("c")))
    found = split.where("toxic = 1").join(chosen, "unit").groupBy("unit", "c").agg(F.collect_list("key").alias("keys"))
    found = found.orderBy("unit").toArrow()  # bounded by the sample
    if not found.num_rows:
        return None
    keys = found.column("keys").combine_chunks()
    _, number = np.unique(keys.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    texts = np.split(number, keys.offsets.to_numpy()[1:-1] - keys.offsets[0].as_py())
    names = found.column("unit").to_pylist()
    picked = witnesses(texts, 3 * rate * found.column("c").to_numpy())
    if not picked:
        return None
    positive, support = [names[k] for k in picked], {names[k]: len(texts[k]) for k in picked}
    pool = counts.where("c > 0").where(~F.col("unit").isin(positive)).select("unit")
    negative = [r.unit for r in pool.orderBy(F.xxhash64("unit"), "unit").limit(FIRST_CLEAN).collect()]  # where the working set begins
    while True:
        model = _machine(positive, negative, support)
        over = pool.mapInArrow(_rate(Shipped(docs.sparkSession, model)), "unit string, margin double").where(F.col("margin") > SLACK - 1)
        used = set(negative)
        more = [r.unit for r in over.orderBy(F.desc("margin"), "unit").select("unit").collect() if r.unit not in used]
        if not more:
            break
        negative = [*more, *negative]
    rows = sample.mapInArrow(_judge(Shipped(docs.sparkSession, model)), "toxic int, margin double").collect()  # two numbers per text of the sample
    margin, y = np.array([r.margin for r in rows]), np.array([r.toxic for r in rows], float)
    model.slope, model.shift = _platt(margin, y, np.where(y == 1, total[1] / got[1], total[0] / got[0]))
    return model


def _rate(shared):
    @lean
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = shared.value.words(batch.column("unit").to_pylist()).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(margins)], names=["unit", "margin"])

    return rate


def _judge(shared):
    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(shared.value.margins(batch.column("text")))], names=["toxic", "margin"])

    return judge


def scored(docs: DataFrame, model: Model | None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1); columns of docs with these names give way to them."""
    docs = docs.drop(score, predicted)
    if model is None:
        return docs.withColumns({score: F.lit(0.0), predicted: F.lit(0)})
    shared = Shipped(docs.sparkSession, model)  # the weights of the landmarks' subsequences, whatever the input
    at, names = docs.columns.index("text"), [*docs.columns, score, predicted]

    @lean
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            s = shared.value.score(shared.value.margins(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs that the model does not call toxic, with all their columns."""
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return scored(docs, model, score, predicted).where(F.col(predicted) == 0).drop(score, predicted)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learnt(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from the labels that are not held out."""
    return fit(docs, labels.where(~held_out()))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document of ``documents``, learnt from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
