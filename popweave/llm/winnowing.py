"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is lower-cased and cut into words; every run of ``k`` words gets a rolling (cyclic-polynomial) hash of
its words' hashes; of each window of ``w`` neighbouring runs the smallest hash is chosen, of equal ones the
rightmost. A chosen run is kept as one number, 37 bits of hash above 26 bits of reversed position, so the minimum
of numbers is the rightmost minimum of hashes, and positions can be read back; a text of over 67 million words, more than
26 bits can number, is an error. Two texts that share any run of k + w - 1 words share a fingerprint.

Defined cases: a null text is empty, an empty text has no fingerprints, a text of fewer than k words has
that of all its words, a text of fewer than k + w - 1 words is one window. The likeness of two texts without
fingerprints is 1, of one with and one without 0. Null doc_ids come first in order, equal doc_ids are ordered by the hash of
their text, and repeated rows follow each other; the one row of a table of one is its own next document; an empty table
gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import stored, text_of

HASH_BITS, POSITION_BITS = 37, 26
K, WINDOW = 4, 4
DOCS_PER_BUCKET = 2000
SPACE = "[\\x20\\x09-\\x0D]+"


def _rolled(words: Column, i: Column, k: int) -> Column:
    """Cyclic polynomial of the hashes of words i ... i+k-1."""
    out = F.get(words, i)
    for j in range(1, k):
        out = F.shiftleft(out, 1).bitwiseOR(F.shiftrightunsigned(out, 63)).bitwiseXOR(F.get(words, i + j))
    return out


def with_fingerprints(df: DataFrame, columns: dict[str, str], k: int = K, w: int = WINDOW) -> DataFrame:
    """df with, for each text column in ``columns``, the array column it names: chosen runs as packed numbers."""
    low, place = (1 << HASH_BITS) - 1, (1 << POSITION_BITS) - 1
    at = list(enumerate(columns.items()))
    keep = df.columns
    df = df.withColumns({f"_w{n}": F.split(F.trim(F.lower(F.regexp_replace(text_of(df, c), SPACE, " "))), " ") for n, (c, _) in at})
    df = df.withColumns({f"_w{n}": F.transform(f"_w{n}", lambda x: F.xxhash64(x)) for n, _ in at})
    empty = F.xxhash64(F.lit(""))

    def packed(n: int) -> Column:
        words = F.col(f"_w{n}")
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(_rolled(words, i, k)), 64 - HASH_BITS), POSITION_BITS).bitwiseOR(F.lit(place) - i))
        short = F.array(F.shiftleft(F.xxhash64(words).bitwiseAND(F.lit(low)), POSITION_BITS).bitwiseOR(F.lit(place)))
        short = F.when(F.size(words) > place + 1, F.raise_error(F.lit("a text has more words than positions can number"))).otherwise(short)
        return F.when((F.size(words) == 1) & (F.get(words, F.lit(0)) == empty), F.array().cast("array<bigint>")).when((F.size(words) < k) | (F.size(words) > place + 1), short).otherwise(grams)

    df = df.withColumns({f"_g{n}": packed(n) for n, _ in at}).drop(*[f"_w{n}" for n, _ in at])
    df = df.withColumns({f"_m{n}": F.col(f"_g{n}") for n, _ in at})
    span = 1
    while span < w:  # minima over twice the span, the last time overlapping
        step = min(span, w - span)
        df = df.withColumns({f"_m{n}": F.zip_with(f"_m{n}", F.slice(f"_m{n}", step + 1, F.greatest(F.size(f"_m{n}"), F.lit(1))), lambda a, b: F.least(a, b)) for n, _ in at})
        span += step
    made = {name: F.array_distinct(F.slice(f"_m{n}", 1, F.greatest(F.size(f"_g{n}") - w + 1, F.lit(1)))) for n, (_, name) in at}
    return df.withColumns(made).select(*keep, *columns.values())


def hashes(fingerprints: str) -> Column:
    """The distinct hashes of packed fingerprints."""
    return F.array_distinct(F.transform(fingerprints, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def positions(fingerprints: str) -> Column:
    """The word positions of packed fingerprints."""
    place = (1 << POSITION_BITS) - 1
    return F.transform(fingerprints, lambda x: F.lit(place) - x.bitwiseAND(F.lit(place)))


def digest(fingerprints: str) -> Column:
    """Fingerprints, positions included, as one string."""
    return F.sha2(F.array_join(F.transform(fingerprints, lambda x: F.hex(x)), ","), 256)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(F.try_divide(both, all_))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _h, _bucket, _end (0): rows with the number of their run of ``DOCS_PER_BUCKET`` rows in order.

    Narrow rows are sorted by ranges of (doc_id, hash of the text), which spreads hot ids (nulls) too, and numbered within
    their range; the texts join them. To each run comes a row with _end 1: the first of the next run, of the first after the last.
    """
    text = text_of(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    keys = d.select("doc_id", "_h").distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    keys = keys.select("doc_id", "_h", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_i"))
    keys = stored(keys.withColumns({"_run": F.floor(F.col("_i") / DOCS_PER_BUCKET), "_first": F.col("_i") % DOCS_PER_BUCKET == 0}), "ranges")
    run = lambda part, k: F.shiftleft(part, 33) + k
    last = keys.groupBy("_part").agg(run(F.col("_part"), F.max("_run")).alias("_last"))  # one row per range: as many as shuffle partitions
    last = last.select("_part", F.coalesce(F.lag("_last").over(W.orderBy("_part")), F.max("_last").over(W.partitionBy())).alias("_last"))
    before = F.when(F.col("_first"), F.when(F.col("_run") == 0, F.col("_last")).otherwise(run(F.col("_part"), F.col("_run") - 1)))
    keys = keys.join(F.broadcast(last), "_part").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), run(F.col("_part"), F.col("_run")).alias("_bucket"), before.alias("_before"))
    rows = d.join(keys, d["doc_id"].eqNullSafe(keys["_d"]) & (d["_h"] == keys["_k"]))
    here = F.struct(F.col("_bucket"), F.lit(0).alias("_end"))
    both = F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("_before").alias("_bucket"), F.lit(1).alias("_end"))))
    return rows.select("doc_id", "text", "_h", F.explode(both).alias("_at")).select("doc_id", "text", "_h", "_at._bucket", "_at._end")


def with_next(placed_rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of ``placed`` (further columns allowed), each with the next row's values of ``columns`` under new names."""
    by = W.partitionBy("_bucket").orderBy("_end", F.col("doc_id").asc_nulls_first(), "_h")
    return placed_rows.withColumns({name: F.lead(c).over(by) for c, name in columns.items()}).where("_end = 0").drop("_end", "_bucket", "_h")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, and their likenesses."""
    # in order first, so that a row's fingerprints are made once and the row before it takes them from the window
    d = placed(spark.read.parquet(f"{sf_dir}/documents.parquet")).repartition("_bucket")
    d = with_fingerprints(d, {"text": "_f"})
    d = d.select("doc_id", "text", "_h", "_bucket", "_end", digest("_f").alias("fingerprint"), F.size("_f").alias("n_fingerprints"), hashes("_f").alias("_f"))
    d = with_next(d, {"text": "_next", "_f": "_n"})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))).drop("text", "_next")
    d = with_fingerprints(d, {"edited": "_e"})
    d = d.select("*", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digest("_e").alias("edited_fingerprint"), hashes("_e").alias("_eh"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("_f", "_eh").alias("near_edited"), likeness("_f", "_n").alias("near_next"), "n_fingerprints")


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLE_SQL: dict[str, str] = {}
