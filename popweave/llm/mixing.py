"""Mixing sources to token targets by entropy balancing.

Each document i of source g gets the rate r_i that stays closest to 1 in relative entropy,

    minimise  sum r_i log r_i - r_i   subject to   sum over g of r_i size_i = target_g,   r_i <= cap,

whose solution is an exponential tilt r_i = min(cap, exp(lambda_g z_i)) with z_i = size_i / mean size of g. The
convex dual has one variable per source; each Newton step is one aggregation of gradient and curvature over all
documents, safeguarded by a bracket. Rates become copies by adding a hashed uniform number and rounding down;
a per-source shift of that number, read off a histogram of the points at which a document gains a copy, brings
the words taken within about one short document of the target. Only one row per source or histogram cell ever
meets in one place.

Sums over documents are exact (scaled to whole numbers), so neither the rates nor the copies depend on the order in which
rows arrive. One row per source passes through single tasks (order, targets); that is the bound of those windows.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, last in
order; equal rows get equal copies, so a source of one repeated row gains or loses it as a whole; the length of a text
only counts by its words; an empty table gives an empty result; targets that no tilt reaches are an error; other columns
are kept as they are (in ``mix`` those named like its results give way to them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import WORD, stored, text_of

SMALL_TABLE = 10_000
CELLS = 2048
STEPS, OPEN = 300, 1e12
TOLERANCE = 1e-4


def _key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """_row (all of docs), source, size (number of words), _key (source, null apart), _u (hashed uniform number in [0, 1))."""
    u = F.xxhash64("doc_id", text_of(docs)).bitwiseAND((1 << 52) - 1) / float(1 << 52)
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "source", size.alias("size"), _key().alias("_key"), u.alias("_u"))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))


def cycled_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sources with target: ``share`` of all sizes by cycling weights, none above ``limit`` times its own size.

    The excess of capped sources is shared again by weight; with sources in order of cap / weight the capped
    ones are a prefix, so running sums (one row per source) give the level directly.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sources.withColumn("_w", cycle).withColumn("_cap", limit * F.col("source_size"))
    by = W.orderBy(F.col("_cap") / F.col("_w"), "_key")
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("_level", (share * total - before) / F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing)))
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    level = F.min_by(F.when(fits, F.col("_level")), F.when(fits, F.struct(F.col("_cap") / F.col("_w"), F.col("_key")))).over(W.partitionBy())
    target = F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap")))
    return s.withColumn("target", target).drop("_w", "_cap", "_level")


def _with(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if small else table, "_key")


def _rate(cap: float) -> Column:
    return F.when(F.col("_full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("_lambda") * F.col("size") / F.col("_mean"))))))


def _exact_sum(x: Column) -> Column:
    """The sum to 2**-16 of a word, the same in any order of the rows."""
    return F.sum(F.round(x * 65536.0).cast("decimal(28,0)")).cast("double") / 65536.0


def solve(rows: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """targets (per source: _key, source_size, n, target) with _lambda, the dual variable, by distributed Newton steps."""
    small = targets.count() <= SMALL_TABLE
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    state = stored(targets.withColumns({"_mean": mean, "_lambda": F.lit(0.0), "_lo": F.lit(-OPEN), "_hi": F.lit(OPEN), "_full": F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), "_done": F.lit(False)}))
    for _ in range(STEPS):
        r = _rate(cap)
        free = r < cap
        z = F.col("size") / F.col("_mean")
        sums = _with(rows, state.where("not _full and not _done").select("_key", "_mean", "_lambda", "_full"), small).groupBy("_key").agg(_exact_sum(r * F.col("size")).alias("_got"), _exact_sum(F.when(free, r * F.col("size") * z).otherwise(0.0)).alias("_slope"))
        over = F.col("_got") - F.col("target")
        state = state.join(sums, "_key", "left")
        state = state.withColumns({"_hi": F.when(over > 0, F.least("_hi", "_lambda")).otherwise(F.col("_hi")), "_lo": F.when(over < 0, F.greatest("_lo", "_lambda")).otherwise(F.col("_lo")), "_done": F.col("_done") | F.col("_full") | F.coalesce(F.abs(over) <= TOLERANCE * F.col("target"), F.lit(True))})
        step = F.col("_lambda") - F.try_divide(F.col("_got") - F.col("target"), F.col("_slope"))
        reach = 2 * (1 + F.abs("_lambda"))
        step = F.when(F.col("_slope") > 0, F.greatest(F.col("_lambda") - reach, F.least(F.col("_lambda") + reach, step)))
        # outside the bracket, or flat: halve it, in steps that grow while one side is still open
        wide = F.when(F.col("_hi") >= OPEN, F.greatest(2 * F.col("_lo"), F.lit(1.0))).when(F.col("_lo") <= -OPEN, F.least(2 * F.col("_hi"), F.lit(-1.0))).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        step = F.when((step > F.col("_lo")) & (step < F.col("_hi")), step).otherwise(wide)
        state = state.withColumn("_lambda", F.when(F.col("_done"), F.col("_lambda")).otherwise(step)).drop("_got", "_slope")
        state = stored(state)
        if state.where("not _done").isEmpty():
            return state
    raise RuntimeError("the dual of the mix did not settle: a target is out of reach")


def _tier() -> Column:
    z = F.col("size") / F.col("_mean")
    return F.when(z > 1, 0).when(z > 0.25, 1).otherwise(2)


def _cell(copy: int, cap: float) -> Column:
    """The histogram cell of the shift at which a document gains its copy-th copy."""
    return F.floor((copy - F.col("_u") - _rate(cap) + cap) * CELLS)


def shifts(rows: DataFrame, state: DataFrame, cap: float = 2.0) -> DataFrame:
    """state with _b0, _b1, _b2: per size tier the last cell whose copies are taken."""
    small = state.count() <= SMALL_TABLE
    top, zero = int(cap), int(cap * CELLS) - 1
    cells = _with(rows.where("size > 0"), state.select("_key", "_mean", "_lambda", "_full"), small)
    cells = cells.select("_key", "size", _tier().alias("_tier"), F.explode(F.array(*[_cell(k, cap) for k in range(1, top + 1)])).alias("_b"))
    cells = cells.groupBy("_key", "_tier", "_b").agg(F.sum("size").alias("_s"))
    cells = stored(cells.withColumn("_cum", F.sum("_s").over(W.partitionBy("_key", "_tier").orderBy("_b"))), "cells")
    usual = cells.groupBy("_key").agg(*[F.coalesce(F.sum(F.when((F.col("_tier") == t) & (F.col("_b") <= zero), F.col("_s"))), F.lit(0)).alias(f"_got{t}") for t in range(3)])
    state = state.join(usual, "_key", "left").fillna(0, ["_got0", "_got1", "_got2"])
    for t in range(3):
        need = F.col("target") - sum(F.col(f"_got{k}") for k in range(3) if k != t)
        under = F.col("_cum") <= F.col("_need")
        found = cells.where(F.col("_tier") == t).join(state.select("_key", need.alias("_need")), "_key")
        found = found.groupBy("_key").agg(F.max(F.when(under, F.struct("_b", "_cum"))).alias("_below"), F.min(F.when(~under, F.struct("_b", "_cum"))).alias("_above"), F.first("_need").alias("_need"))
        below, low = F.coalesce("_below._b", F.lit(-1)), F.coalesce("_below._cum", F.lit(0))
        nearer = F.lit(t == 2) & (F.abs(F.col("_above._cum") - F.col("_need")) < F.abs(low - F.col("_need")))
        found = found.select("_key", F.when(nearer, F.col("_above._b")).otherwise(below).alias(f"_b{t}"), F.when(nearer, F.col("_above._cum")).otherwise(low).alias("_g"))
        state = state.join(found, "_key", "left").withColumns({f"_b{t}": F.coalesce(f"_b{t}", F.lit(zero)), f"_got{t}": F.coalesce("_g", f"_got{t}")}).drop("_g")
    return stored(state, "shifts")


def _mixed_rows(docs: DataFrame, targets, cap: float) -> DataFrame:
    """_row, size, source_size, target, rate, copies."""
    rows = sized(docs)
    compact = stored(rows.select("_key", "source", "size", "_u"), "sizes")
    state = solve(compact, stored(targets(source_sizes(compact)), "targets"), cap)
    state = shifts(compact, state, cap).drop("source", "n")
    out = _with(rows, state, state.count() <= SMALL_TABLE)
    last = F.when(_tier() == 0, F.col("_b0")).when(_tier() == 1, F.col("_b1")).otherwise(F.col("_b2"))
    copies = sum((_cell(k, cap) <= last).cast("int") for k in range(1, int(cap) + 1))
    out = out.withColumn("rate", _rate(cap)).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return out.select("_row", *RESULTS)


RESULTS = ["size", "source_size", "target", "rate", "copies"]


def mix(docs: DataFrame, targets=cycled_targets, cap: float = 2.0) -> DataFrame:
    """docs with size, source_size, target, rate and copies. ``targets`` maps the table of sources to one with target."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    return _mixed_rows(docs, targets, cap).select(*[F.col("_row")[c].alias(c) for c in kept], *RESULTS)


def mixed(docs: DataFrame, targets=cycled_targets, cap: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    out = _mixed_rows(docs, targets, cap).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Words taken of each document of ``documents`` by a mix of 150% of all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", F.col("copies").cast("int").alias("copies"))


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL: dict[str, str] = {}
