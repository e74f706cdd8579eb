"""K-mer graphs, sequence deduplication, tree labels and suppression of overlapping events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.functions.ordering import numbered
from popweave.functions.scratch import stored


#: Letters of a packed k-mer, three bits each, in byte order so that packed and plain windows compare alike; and their partners.
LETTERS, PARTNERS = b"ACGNT", b"TGCNA"
#: Places of a sequence that are taken at once; distinct edges that a task gathers before it passes them on, and those of a batch that it passes on.
PLACES, MOST_EDGES, EDGE_ROWS = 1 << 17, 1 << 20, 1 << 16


def _windows(seqs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, n, turned n): the distinct windows of the sequences, none shorter than a window, each as the lesser of itself and its reverse complement, with how often either stood there.

    Windows of ``ACGTN`` that fit 63 bits are packed into integers letter by letter; others are compared as bytes.
    """
    raw = np.frombuffer(b"".join(seqs), np.uint8)
    n = len(raw) - size + 1
    inside = np.ones(len(raw), bool)  # starts whose window does not run on into the next sequence
    ends = np.cumsum([len(x) for x in seqs])
    inside[(ends[:, None] - np.arange(1, size)).ravel()] = False
    inside = inside[:n]
    code = np.full(256, 255, np.uint8)
    code[np.frombuffer(LETTERS, np.uint8)] = np.arange(5)
    codes = code[raw]
    if size * 3 <= 63 and codes.max() < 5:
        partner = np.array([4, 2, 1, 3, 0], np.int64)
        here, there = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(size):
            c = codes[i : i + n].astype(np.int64)
            here |= c << (3 * (size - 1 - i))
            there |= partner[c] << (3 * i)
        here, there = here[inside], there[inside]
        edges, at = np.unique(np.minimum(here, there), return_inverse=True)
        letters = np.frombuffer(LETTERS, np.uint8)[(edges[:, None] >> (3 * np.arange(size - 1, -1, -1))) & 7]
        edges = np.ascontiguousarray(letters).view(f"S{size}").ravel()
        turned = here > there
    else:
        table = np.arange(256, dtype=np.uint8)
        table[np.frombuffer(LETTERS, np.uint8)] = np.frombuffer(PARTNERS, np.uint8)
        here = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, size)[inside]).view(f"S{size}").ravel()
        there = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(table[raw], size)[inside, ::-1]).view(f"S{size}").ravel()
        turned = here > there
        edges, at = np.unique(np.where(turned, there, here), return_inverse=True)
    return edges, np.bincount(at[~turned], minlength=len(edges)), np.bincount(at[turned], minlength=len(edges))


def kmer_edges(seqs: DataFrame, k: int) -> DataFrame:
    """(src, dst, forward, backward): edges between neighbouring k-mers, counted in reads and in their reverse complements.

    An edge is a (k+1)-mer. A task runs once over the bytes of each sequence, in slices that overlap by k, and gathers the
    distinct edges with two counters (as read, turned), an edge and its reverse complement as one; they meet by one shuffle
    of these partial counts. What an edge counts in the reverse complements is what its own reverse complement counts in
    the reads. Sequences of at most k letters and null ones give nothing; sequences are ASCII.
    """
    from popweave.operators.reads import reverse_complement

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple] = []
        held = 0

        def merged() -> tuple:
            edges, at = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
            return edges, *[np.bincount(at, np.concatenate([c[i] for c in counts]), len(edges)).astype(np.int64) for i in (1, 2)]

        def passed_on(edges: np.ndarray, n: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(edges), EDGE_ROWS):
                j = i + EDGE_ROWS
                yield pa.RecordBatch.from_arrays([pa.array(edges[i:j].astype(f"U{k + 1}"), pa.string()), pa.array(n[i:j]), pa.array(t[i:j])], names=["e", "n", "t"])

        waiting, size = [], 0
        for batch in batches:
            for seq in batch.column("seq"):
                seq = seq.as_py().encode()
                for at in range(0, max(0, len(seq) - k), PLACES):
                    waiting.append(seq[at : at + PLACES + k])
                    size += len(waiting[-1])
                    if size >= PLACES:  # short sequences are taken together
                        counts += [_windows(waiting, k + 1)]
                        held, waiting, size = held + len(counts[-1][0]), [], 0
                    if held >= MOST_EDGES:  # merged as they come; passed on only where half of them are distinct
                        counts = [merged()]
                        held = len(counts[0][0])
                        if held >= MOST_EDGES // 2:
                            yield from passed_on(*counts[0])
                            counts, held = [], 0
        if waiting:
            counts += [_windows(waiting, k + 1)]
        if counts:
            yield from passed_on(*merged())

    mers = seqs.where(F.length("seq") > k).select("seq").mapInArrow(run, "e string, n long, t long")
    n = mers.groupBy("e").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    turned = reverse_complement("e")
    ways = F.array(F.struct("e", F.col("n").alias("f"), F.when(turned == F.col("e"), F.col("n")).otherwise(F.col("t")).alias("b")), F.struct(turned.alias("e"), F.col("t").alias("f"), F.col("n").alias("b")))
    n = n.select(F.explode(F.when(turned == F.col("e"), F.slice(ways, 1, 1)).otherwise(ways)).alias("x")).select("x.*")
    return n.select(F.substring("e", 1, k).alias("src"), F.substring("e", 2, k).alias("dst"), F.col("f").alias("forward"), F.col("b").alias("backward"))


def kmer_prune(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges without the nodes whose outgoing and incoming counts are both at most ``least`` (one pass)."""
    n = F.col("forward") + F.col("backward")
    ends = edges.select(F.col("src").alias("node"), n.alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("out"), n.alias("into")))
    weak = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where((F.col("out") <= least) & (F.col("into") <= least)).select("node")
    return edges.join(weak.withColumnRenamed("node", "src"), "src", "left_anti").join(weak.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)


def kmer_sources(edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def kmer_best_successor(edges: DataFrame) -> DataFrame:
    """The heaviest outgoing edge per node, of equal ones the least successor."""
    n = F.col("forward") + F.col("backward")
    top = edges.withColumn("n", n).groupBy("src").agg(F.max("n").alias("n"))
    return edges.withColumn("n", n).join(top, ["src", "n"]).groupBy("src", "n").agg(F.min("dst").alias("dst"))


def suffix_dedupe(seqs: DataFrame, size: int = 50) -> DataFrame:
    """Of sequences with the same last ``size`` bases the longest, of equal ones the least."""
    w = W.partitionBy(F.expr(f"right(seq, {size})")).orderBy(F.desc(F.length("seq")), "seq", "seq_id")
    return seqs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def short_species(organism: str) -> Column:
    """First letter of the genus, and the epithet."""
    return F.concat(F.substring(organism, 1, 1), F.lit("_"), F.get(F.split(organism, " "), 1))


def relabel_tokens(text: str, labels: str) -> Column:
    """``text`` with every whole token that is a key of the map column ``labels`` replaced; punctuation stays."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.-]+|[^A-Za-z0-9_.-]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(labels, p), p)), "")


def kmer_paths(edges: DataFrame, most: int = 2000) -> DataFrame:
    """(node, steps, seq): from every node without an incoming edge along the heaviest edges; seq is empty if the walk takes ``most`` steps.

    Walks grow by doubling: a table of successors 1, 2, 4 ... steps ahead extends what is known of every walk by as many
    steps, so a round is two joins and a walk through a cycle ends at ``most``, as in a step-by-step walk.
    """
    edges = stored(edges, "edges")
    jump = stored(kmer_best_successor(edges).select("src", F.col("dst").alias("to")), "jumps")
    known, span = kmer_sources(edges).select("node", F.lit(0).alias("step"), F.col("node").alias("at")), 1
    while span <= most:
        ahead = known.where(F.col("step") + span <= most).join(jump, F.col("at") == F.col("src")).select("node", (F.col("step") + span).alias("step"), F.col("to").alias("at"))
        known, before = stored(known.unionByName(ahead), "walks"), known
        if known.count() == before.count():
            break
        span *= 2
        if span <= most:
            jump = stored(jump.join(jump.select(F.col("src").alias("to"), F.col("to").alias("_to")), "to").select("src", F.col("_to").alias("to")), "jumps")
    letters = F.array_sort(F.collect_list(F.struct("step", F.expr("right(at, 1)").alias("c"))))  # at most ``most`` + 1
    out = known.groupBy("node").agg(F.max("step").alias("steps"), F.array_join(F.transform(F.filter(letters, lambda x: x["step"] > 0), lambda x: x["c"]), "").alias("_tail"))
    return out.select("node", "steps", F.when(F.col("steps") >= most, "").otherwise(F.concat("node", "_tail")).alias("seq"))


#: Events of a block, and how many of the events after it a block knows.
BLOCK, BEYOND = 1 << 16, 1 << 13


def _next_apart(rows: DataFrame, unknown: DataFrame, within: int) -> DataFrame:
    """(rn, next): for the events (rn, at, contig_ord, start, stop, inv) of ``unknown`` the first event from ``at`` on that does not overlap it; one past the last if there is none.

    Events search in steps that double and then halve over tables of 1, 2, 4 ... neighbouring events (their last contig and start,
    least and greatest stop, any inversion), which are built only as far as some search goes.
    """
    levels = [stored(rows.select("rn", F.col("contig_ord").alias("c"), F.col("start").alias("a"), F.col("stop").alias("low"), F.col("stop").alias("high"), "inv"), "level")]
    own = unknown.select("rn", "contig_ord", "start", "stop", F.col("inv").alias("turned"))
    state = own.join(unknown.select("rn", "at", F.lit(0).alias("t")), "rn")
    done = own.select("rn", F.col("rn").alias("next")).where("false")
    while True:
        top = state.agg(F.max("t")).first()[0]
        if top is None:
            return done
        while len(levels) <= top:
            half, size = levels[-1], 1 << (len(levels) - 1)
            ahead = half.select((F.col("rn") - size).alias("rn"), *[F.col(c).alias(f"_{c}") for c in ("c", "a", "low", "high", "inv")])
            levels.append(stored(half.join(ahead, "rn").select("rn", F.col("_c").alias("c"), F.col("_a").alias("a"), F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"), (F.col("inv") | F.col("_inv")).alias("inv")), "level"))
        blocks = levels[0].withColumn("t", F.lit(0))
        for t, level in enumerate(levels[1:], 1):
            blocks = blocks.unionByName(level.withColumn("t", F.lit(t)))
        hit = state.join(blocks.withColumnRenamed("rn", "at"), ["at", "t"], "left")
        near = (F.col("a") - F.col("start") <= within) | ((F.col("low") >= F.col("stop") - within) & (F.col("high") <= F.col("stop") + within))
        passed = F.coalesce((F.col("c") == F.col("contig_ord")) & (F.col("turned") | ~F.col("inv")) & near, F.lit(False))
        at = F.when(passed, F.col("at") + F.expr("shiftleft(1L, t)")).otherwise(F.col("at"))
        hit = stored(hit.select(*own.columns, at.alias("at"), F.when(passed, F.col("t") + 1).otherwise(F.col("t") - 1).alias("t")), "searches")
        done = done.unionByName(hit.where("t < 0").select("rn", F.col("at").alias("next")))
        state = hit.where("t >= 0")


def _nexts(own: np.ndarray, start: np.ndarray, stop: np.ndarray, inv: np.ndarray, within: int) -> np.ndarray:
    """For each of events in order, ``own`` the number of its contig, the first later one that does not overlap it; their number if there is none.

    Starts within a contig ascend, absent ones (not a number) first. Runs of near events are leapt over by halving steps over the least and greatest stops of 2**t events.
    """
    n = len(own)
    at = np.arange(1, n + 1)
    ends = np.append(np.flatnonzero(np.diff(own)) + 1, n)
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    turned = np.minimum.accumulate(np.where(inv, np.arange(n), n)[::-1])[::-1]
    turned = np.where(inv, n, np.append(turned[1:], n))  # an inversion is not suppressed by another kind
    low, high = [stop], [stop]
    while 2 << len(low) - 1 <= n:
        size = 1 << len(low) - 1
        low.append(np.minimum(low[-1][:-size], low[-1][size:]))
        high.append(np.maximum(high[-1][:-size], high[-1][size:]))
    for t in range(len(low))[::-1]:  # by start
        last = at + (1 << t) - 1
        ok = last < end
        ok[ok] = start[last[ok]] - start[ok] <= within
        at[ok] += 1 << t
    for t in range(len(low))[::-1]:  # by stop
        ok = at + (1 << t) <= end
        ok[ok] = (low[t][at[ok]] >= stop[ok] - within) & (high[t][at[ok]] <= stop[ok] + within)
        at[ok] += 1 << t
    return np.minimum(np.minimum(at, end), turned)


def _in_blocks(rows: DataFrame, marks: DataFrame, within: int, last: int, schema: str, tell) -> DataFrame:
    """What ``tell(rn, size, next, marks)`` makes of each block: the numbers of its events and of those beyond that it knows, how many are its own, and places of their successors
    (as many as ``rn`` has where they are not known). ``marks`` (b, rn, next) go to the block b; a next that they give takes the place of what is found.
    """
    b = F.floor((F.col("rn") - 1) / BLOCK)
    near = rows.select("rn", "contig_ord", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), "inv")
    near = near.withColumn("b", F.explode(F.when((F.pmod(F.col("rn") - 1, F.lit(BLOCK)) < BEYOND) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))))

    def run(events: pa.Table, marked: pa.Table) -> pa.Table:
        events = events.sort_by("rn")
        rn, start, stop, inv = (events[c].to_numpy() for c in ("rn", "start", "stop", "inv"))
        codes = events["contig_ord"].combine_chunks().dictionary_encode().indices
        own = np.cumsum(np.append(0, np.diff(codes.fill_null(-1).to_numpy(zero_copy_only=False)) != 0))
        own = np.where(codes.is_null().to_numpy(zero_copy_only=False), -1 - np.arange(len(rn)), own)  # none suppresses an event without a contig
        return tell(rn, int(np.searchsorted(rn, (rn[0] - 1) // BLOCK * BLOCK + BLOCK, side="right")), _nexts(own, start, stop, inv.astype(bool), within), marked)

    return near.groupBy("b").cogroup(marks.groupBy("b")).applyInArrow(run, schema)


def suppress_overlaps(events: DataFrame, within: int = 5) -> DataFrame:
    """Events (contig_ord, start, stop, kind) in order, without those near the last kept one of their contig.

    An event goes if its start or its stop is within ``within`` of the last kept event's, unless it is an inversion and
    that is not. The kept events are a chain: each one's successor is the first later event that does not overlap it. Numbered events are
    cut into blocks of ``BLOCK``, which know ``BEYOND`` events more; successors further on are searched by doubling (``_next_apart``). A block tells
    through which events of later ones chains enter those; chains of these entries alone are followed by pointer doubling from the first
    event on, and each block then follows its own part. So no task depends on a contig's size. Of events equal in place and in
    being an inversion only the first (by the other columns) can stay, whatever was kept before.
    """
    rest = [c for c in events.columns if c not in ("contig_ord", "start", "stop")]
    inv = F.coalesce(F.col("kind") == "inv", F.lit(False))
    first = events.groupBy("contig_ord", "start", "stop", inv.alias("inv")).agg(F.min(F.struct(*rest)).alias("r"))
    rows = stored(numbered(first, ["contig_ord", "start", "stop", "r"]), "events")
    last = rows.agg(F.max("rn")).first()[0] or 0

    def unknown(rn, size, nxt, marked):
        far = np.flatnonzero((nxt[:size] == len(rn)) & (rn[-1] < last))
        return pa.table({"rn": rn[far], "at": np.full(len(far), rn[-1] + 1, np.int64)})

    def numbers(rn, size, nxt, marked):
        """Numbers of the successors of a block's own events."""
        out = np.append(rn, rn[-1] + 1)[nxt[:size]]
        known = marked.filter(pc.is_valid(marked["next"]))
        out[known["rn"].to_numpy() - rn[0]] = known["next"].to_numpy()
        return out

    def leaving(rn, size, nxt, marked):
        """The first event outside of the block on the chain of each of its own, by pointer doubling."""
        out = numbers(rn, size, nxt, marked)
        while (inside := out < rn[0] + size).any():
            out[inside] = out[out[inside] - rn[0]]
        return out

    def entries(rn, size, nxt, marked):
        return pa.table({"rn": np.unique(leaving(rn, size, nxt, marked))})

    def onward(rn, size, nxt, marked):
        at = marked.filter(pc.is_null(marked["next"]))["rn"].to_numpy()
        return pa.table({"rn": at, "next": leaving(rn, size, nxt, marked)[at - rn[0]]})

    def followed(rn, size, nxt, marked):
        out, at, kept = numbers(rn, size, nxt, marked), marked.filter(pc.is_null(marked["next"]))["rn"].to_numpy(), []
        for i in at.tolist():  # one chain enters a block
            while i < rn[0] + size:
                kept.append(i)
                i = int(out[i - rn[0]])
        return pa.table({"rn": pa.array(kept, pa.int64())})

    none = rows.select(F.lit(0).cast("long").alias("b"), F.col("rn").cast("long").alias("rn"), F.col("rn").cast("long").alias("next")).where("false")
    block = F.floor((F.col("rn") - 1) / BLOCK).alias("b")
    far = stored(_in_blocks(rows, none, within, last, "rn long, at long", unknown), "far")
    if far.limit(1).count():
        far = stored(_next_apart(rows, rows.join(far, "rn"), within).select(block, "rn", "next"), "far")
    else:
        far = none
    at = lambda df: far.unionByName(df.select(block, "rn", F.lit(None).cast("long").alias("next")))
    enter = _in_blocks(rows, far, within, last, "rn long", entries).where(F.col("rn") <= last).unionByName(rows.where("rn = 1").select(F.col("rn").cast("long"))).distinct()
    links = stored(_in_blocks(rows, at(stored(enter, "entries")), within, last, "rn long, next long", onward), "links")
    kept = stored(links.where("rn = 1").select("rn"), "kept")
    links = stored(links.where(F.col("next") <= last), "links")
    while links.limit(1).count():
        kept = stored(kept.unionByName(kept.join(links, "rn").select(F.col("next").alias("rn"))), "kept")
        links = stored(links.join(links.select(F.col("rn").alias("next"), F.col("next").alias("_next")), "next").select("rn", F.col("_next").alias("next")), "links")
    kept = _in_blocks(rows, at(kept), within, last, "rn long", followed)
    return rows.join(kept, "rn").select(*[f"r.{c}" if c in rest else c for c in events.columns])
