"""Language-model scores by deleted interpolation.

The model of order K mixes n-gram maximum-likelihood estimates recursively,

    P_k(w | h) = l_k(b) c(h w) / c(h) + (1 - l_k(b)) P_{k-1}(w | shorter h),      P_0 = 1 / (V + 1),

where b is the bucket (power of two) of the context's count c(h). The weights are learnt by expectation-maximisation
on held-out counts: a tenth of the training texts is set aside, its words are predicted from the counts of the others.

Texts become blocks of about ``BLOCK_TOKENS`` tokens, written once. A block asks for the counts of its
distinct n-grams: its sorted hashes, with the block's own counts, are dealt out to ``FAN`` ranges of hashes. Where
more than ``FAN`` senders meet in a range, about ``FAN`` of them at a time are merged to one sender that deals out to ``FAN``
narrower ranges, and so on, until few enough meet in each; those add up the counts and answer, and answers go back the
same way. So each level has ``FAN`` messages per block, in proportion to the corpus. An n-gram sends one entry per
block however frequent it is, so nothing is skewed, and what is gathered grows with the corpus. Blocks and answers
then meet by block. Words have 64-bit hashes, longer n-grams ``GRAM_BITS``, at every size.

Defined cases: a null or empty text is one end token; a null doc_id counts as '' when dealing out training texts;
repeated rows count repeatedly; without training texts all counts are 0; a text's first words have start marks as
context; a very long text makes a block of its own; scores are sums, so no ties need a rule; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import begin_task, hash_strings, mix64, slices, stored, text_of, words_of

ORDER = 2
BLOCK_TOKENS = 1_000_000
FAN = 256
GRAM_BITS = 56
ROUNDS = 12
BUCKETS = 64
END, START = (mix64(np.array([x], np.uint64))[0] for x in (101, 202))
_ODD = np.uint64(0xD1342543DE82EF95)


def pack(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_BLOCK = "block long, n_train long, n_kept long, d_train long, d_kept long, doc_id array<long>, part array<int>, n array<int>, words binary, codes binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token blocks. part: crc32 of doc_id modulo 10 (0: held out, 1: set aside for the weights)."""
    begin_task()
    task, k = TaskContext.get().partitionId(), 0
    ids, parts, sizes, tokens, n = [], [], [], [], 0

    def made() -> pa.RecordBatch:
        all_, size, part = np.concatenate(tokens), np.array(sizes), np.array(parts)
        words, codes = np.unique(all_, return_inverse=True)
        train, kept = part != 0, part > 1
        row = {"block": pa.array([(task << 24) + k], pa.int64())}
        row |= {c: pa.array([int(v)], pa.int64()) for c, v in (("n_train", size[train].sum()), ("n_kept", size[kept].sum()), ("d_train", train.sum()), ("d_kept", kept.sum()))}
        row |= {"doc_id": pa.array([ids], pa.list_(pa.int64())), "part": pa.array([parts], pa.list_(pa.int32())), "n": pa.array([sizes], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict(row | {"words": pa.array([pack(words)], pa.binary()), "codes": pa.array([pack(codes.astype(np.uint32))], pa.binary())})

    for batch in slices(batches):
        words, offsets = words_of(batch.column("text"))
        some = batch.column("doc_id").to_pylist()
        tokens.append(np.insert(hash_strings(words), offsets[1:], END))
        ids += some
        parts += [zlib.crc32(b"" if x is None else str(x).encode()) % 10 for x in some]
        sizes += (np.diff(offsets) + 1).tolist()
        n += len(tokens[-1])
        if n >= BLOCK_TOKENS:
            yield made()
            ids, parts, sizes, tokens, n, k = [], [], [], [], 0, k + 1
    if ids:
        yield made()


class Block:
    """A block's tokens and, per order, their n-gram keys: sorted distinct ones, and each token's place among them."""

    def __init__(self, row: dict, order: int):
        self.ids, self.part, self.size = row["doc_id"], np.array(row["part"]), np.array(row["n"], np.int64)
        tokens = unpack(row["words"], np.uint64)[unpack(row["codes"], np.uint32)]
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.keys, self.where = [], []
        gram = tokens
        for k in range(1, order + 1):
            if k > 1:  # one word further back, start marks before the text
                back = np.concatenate([np.full(k - 1, START), tokens[: 1 - k]]) if len(tokens) >= k else np.full(len(tokens), START)
                inside = np.arange(len(tokens)) - self.first[self.doc] >= k - 1
                gram = mix64(gram * _ODD + np.where(inside, back, START))
            keys, where = np.unique(gram if k == 1 else gram >> np.uint64(64 - GRAM_BITS) << np.uint64(64 - GRAM_BITS), return_inverse=True)
            self.keys.append(keys)
            self.where.append(where)

    def counts(self, k: int, docs: np.ndarray) -> np.ndarray:
        """Own counts of the keys of order k + 1 in the chosen documents."""
        return np.bincount(self.where[k], docs[self.doc], len(self.keys[k])).astype(np.uint32)

    def before(self, x: np.ndarray, start: float) -> np.ndarray:
        """Per token the value of x one token earlier in its text."""
        out = np.concatenate([[start], x[:-1]]).astype(np.float64)
        out[self.first] = start
        return out


_MESSAGE = "node long, src long, sizes array<long>, keys binary, counts binary"
_ANSWER = "node long, src long, sizes array<long>, counts binary, known long"


def _packed(node: int, src: int, keys: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """A message: sorted keys of each order, and of each order the (training, kept) counts."""
    out = {"node": node, "src": src, "sizes": [len(x) for x in keys]}
    # of GRAM_BITS only: the zero bits below do not travel
    gaps = [np.diff(x if k == 0 else x >> np.uint64(64 - GRAM_BITS), prepend=np.uint64(0)) for k, x in enumerate(keys)]
    return out | {"keys": pack(np.concatenate(gaps)), "counts": pack(np.concatenate([x for pair in counts for x in pair]).astype(np.uint64))}


def _opened(row: dict, with_keys: bool = True) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The keys and counts of a message, or the counts of an answer."""
    n, full = row["sizes"], sum(row["sizes"]) > 0
    gaps = unpack(row["keys"], np.uint64) if full and with_keys else np.zeros(0, np.uint64)
    counts, cut = unpack(row["counts"], np.uint64) if full else np.zeros(0, np.uint64), np.cumsum([0, *n])
    keys = [np.cumsum(gaps[a:b], dtype=np.uint64) << np.uint64(0 if k == 0 else 64 - GRAM_BITS) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return keys, [(counts[2 * a : a + b], counts[a + b : 2 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _dealt(node: int, level: int, fan: int, src: int, keys: list[np.ndarray], counts: list[tuple]) -> Iterator[dict]:
    """Messages to the ``fan`` parts of a range: the node's number is the path to it from the whole range.

    The first level cuts the 64 bits, the next ones the bits below those that their node has fixed.
    """
    shift = 64 - (level + 1) * (fan - 1).bit_length()
    edges = [np.searchsorted(x >> np.uint64(shift) & np.uint64((1 << (fan - 1).bit_length()) - 1), np.arange(fan + 1)) for x in keys]
    for p in range(fan):
        at = [slice(int(e[p]), int(e[p + 1])) for e in edges]
        yield _packed(node * fan + p, src, [x[s] for x, s in zip(keys, at, strict=True)], [tuple(y[s] for y in pair) for pair, s in zip(counts, at, strict=True)])


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({c: pa.array([r[c] for r in rows], kinds[t]) for c, t in fields})


def _merged(rows: list[dict], order: int) -> tuple[list[np.ndarray], list[tuple], list[list[np.ndarray]]]:
    """Distinct keys of all messages per order, their summed counts, and the place of each message's keys among them."""
    opened = [_opened(r) for r in rows]
    keys, counts, places = [], [], []
    for k in range(order):
        size = np.cumsum([len(x[0][k]) for x in opened])[:-1]
        all_, where = np.unique(np.concatenate([x[0][k] for x in opened]), return_inverse=True)
        keys.append(all_)
        counts.append(tuple(np.bincount(where, np.concatenate([x[1][k][j] for x in opened]).astype(np.float64), len(all_)).astype(np.uint64) for j in range(2)))
        places.append(np.split(where, size))
    return keys, counts, places


def _ask(order: int, fan: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, order)
                train, kept = (b.part != 0).astype(float), (b.part > 1).astype(float)
                own = [(b.counts(k, train), b.counts(k, kept)) for k in range(order)]
                yield from _table(list(_dealt(0, 0, fan, row["block"], b.keys, own)), _MESSAGE).combine_chunks().to_batches()

    return ask


def _answer(order: int):
    def answer(table: pa.Table) -> pa.Table:
        """For one range: the counts of all senders, added up, for each sender's keys."""
        rows = table.to_pylist()
        _, counts, places = _merged(rows, order)
        known = int((counts[0][0] > 0).sum())
        out = []
        for i, r in enumerate(rows):
            reply = [c[places[k][i]] for k, pair in enumerate(counts) for c in pair]
            out.append({"node": r["node"], "src": r["src"], "sizes": r["sizes"], "counts": pack(np.concatenate(reply)), "known": known})
        return _table(out, _ANSWER)

    return answer


def _merge(order: int, level: int, fan: int):
    def merge(table: pa.Table) -> pa.Table:
        """For up to ``fan`` senders in a range: one sender to the parts of the range."""
        rows = table.select(["node", "src", "sizes", "keys", "counts"]).to_pylist()
        keys, counts, _ = _merged(rows, order)
        return _table(list(_dealt(rows[0]["node"], level, fan, table.column("up")[0].as_py(), keys, counts)), _MESSAGE)

    return merge


def _hand_down(order: int):
    def hand_down(key, asked: pa.Table, answers: pa.Table) -> pa.Table:
        """The answer to a merged sender, dealt out to the senders that were merged; ``known`` goes with the first."""
        rows = asked.select(["node", "src", "sizes", "keys", "counts"]).to_pylist()
        _, _, places = _merged(rows, order)
        replies = sorted(answers.to_pylist(), key=lambda r: r["node"])
        got = [_opened(r, with_keys=False)[1] for r in replies]
        totals = [tuple(np.concatenate([g[k][j] for g in got]) for j in range(2)) for k in range(order)]
        known = sum(r["known"] for r in replies)
        out = []
        for i, r in enumerate(rows):
            reply = [c[places[k][i]] for k, pair in enumerate(totals) for c in pair]
            out.append({"node": r["node"], "src": r["src"], "sizes": r["sizes"], "counts": pack(np.concatenate(reply)), "known": known})
        return _table(out, _ANSWER)

    return hand_down


def answered(messages: DataFrame, senders: int, order: int, fan: int, level: int = 0) -> DataFrame:
    """The answers to messages (node, src, sizes, keys, counts) of ``senders`` senders per node."""
    if senders <= fan or (level + 2) * (fan - 1).bit_length() > GRAM_BITS:
        return messages.groupBy("node").applyInArrow(_answer(order), _ANSWER)
    ups = -(-senders // fan)
    messages = stored(messages.withColumn("up", F.pmod(F.xxhash64("src"), F.lit(ups))), "messages")
    merged = messages.groupBy("node", "up").applyInArrow(_merge(order, level + 1, fan), _MESSAGE)
    above = stored(answered(merged, ups, order, fan, level + 1), "answers")
    above = above.withColumns({"whole": F.expr(f"node div {fan}"), "up": F.col("src")})
    return messages.groupBy("node", "up").cogroup(above.groupBy("whole", "up")).applyInArrow(_hand_down(order), _ANSWER)


def _learned(replies: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order the (training, kept) counts of a block's keys."""
    got = [_opened(r, with_keys=False)[1] for r in sorted(replies.to_pylist(), key=lambda r: r["node"])]
    return [tuple(np.concatenate([g[k][j] for g in got]).astype(np.float64) for j in range(2)) for k in range(order)]


def _estimates(b: Block, counts: list[np.ndarray], n_docs: float, n_tokens: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per order the maximum-likelihood estimate of each token, and its context's bucket (0: never seen)."""
    probs, buckets, before = [], [], None
    for k, c in enumerate(counts):
        own = c[b.where[k]]
        context = np.full(len(own), n_tokens) if k == 0 else b.before(before, n_docs)
        probs.append(np.divide(own, context, out=np.zeros(len(own)), where=context > 0))
        buckets.append(np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.uint8))
        before = own
    return probs, buckets


def _mixture(probs: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, floor: float) -> list[np.ndarray]:
    """The mixed probability after each order, from order 0."""
    out = [np.full(len(probs[0]), floor)]
    for k, (p, b) in enumerate(zip(probs, buckets, strict=True)):
        w = np.where(b > 0, weights[k][b], 0.0)
        out.append(w * p + (1 - w) * out[-1])
    return out


def weights_by_em(tokens: DataFrame, order: int, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights [order, bucket] from the table of held-out tokens; each round is one pass, adding up BUCKETS sums."""
    weights = np.full((order, BUCKETS), 0.5)

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won, all_ = np.zeros((order, BUCKETS)), np.zeros((order, BUCKETS))
        for batch in batches:
            for row in batch.to_pylist():
                probs = [unpack(x, np.float32).astype(np.float64) for x in row["probs"]]
                buckets = [unpack(x, np.uint8) for x in row["buckets"]]
                mixed = _mixture(probs, buckets, weights, floor)
                share = np.ones(len(mixed[0]))  # probability that the token comes from this order or a lower one
                for k in range(order - 1, -1, -1):
                    w = np.where(buckets[k] > 0, weights[k][buckets[k]], 0.0)
                    own = share * np.divide(w * probs[k], mixed[k + 1], out=np.zeros(len(w)), where=mixed[k + 1] > 0)
                    won[k] += np.bincount(buckets[k], own, BUCKETS)
                    all_[k] += np.bincount(buckets[k], share, BUCKETS)
                    share = share - own
        k, b = np.nonzero(all_)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k), "b": pa.array(b), "won": pa.array(won[k, b]), "total": pa.array(all_[k, b])})

    for _ in range(rounds):
        sums = tokens.mapInArrow(round_, "k long, b long, won double, total double").groupBy("k", "b").agg(F.sum("won").alias("won"), F.sum("total").alias("total"))
        for r in sums.collect():  # at most order * BUCKETS rows
            weights[r.k, r.b] = min(max((r.won + 0.5) / (r.total + 1), 1e-6), 1 - 1e-6)
    return weights


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    blocks = stored(d.mapInArrow(_blocks, _BLOCK), "blocks")
    total = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_kept", "d_train", "d_kept")], F.count("*").alias("blocks")).first()
    tasks = max(1, min(total.blocks, 10_000))
    asked = blocks.repartition(tasks, "block").mapInArrow(_ask(order, FAN), _MESSAGE)
    answers = stored(answered(asked, total.blocks, order, FAN), "answers")
    known = answers.groupBy("node").agg(F.first("known").alias("known")).agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first().v
    floor = 1 / (known + 1)

    def held_tokens(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(rows.to_pylist()[0], order)
        probs, buckets = _estimates(b, [c[1] for c in _learned(replies, order)], total.d_kept, total.n_kept)
        at = np.flatnonzero((b.part == 1)[b.doc])
        probs, buckets = [pack(x[at].astype(np.float32)) for x in probs], [pack(x[at]) for x in buckets]
        return pa.table({"probs": pa.array([probs] * bool(len(at)), pa.list_(pa.binary())), "buckets": pa.array([buckets] * bool(len(at)), pa.list_(pa.binary()))})

    def score(key, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(rows.to_pylist()[0], order)
        counts = [c[0] for c in _learned(replies, order)]
        mixed = _mixture(*_estimates(b, counts, total.d_train, total.n_train), weights, floor)[-1]
        own = counts[0][b.where[0]]
        base = np.log10((own + 0.1) / (total.n_train + 0.1 * (known + 1)))
        sums = [np.add.reduceat(x, b.first) for x in (own > 0, base, np.log10(mixed))]
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.part == 0), "n_tokens": pa.array(b.size), "n_known": pa.array(sums[0].astype(np.int64)), "train_tokens": pa.array(np.full(len(b.size), total.n_train, np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    meet = blocks.groupBy("block").cogroup(answers.groupBy("src"))
    held = stored(meet.applyInArrow(held_tokens, "probs array<binary>, buckets array<binary>"), "held")
    weights = weights_by_em(held, order, floor)
    return meet.applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of every text of ``documents`` under the model of those that are not held out."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
