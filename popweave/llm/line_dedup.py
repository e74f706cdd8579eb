"""Line dedup with a distributed suffix array over line ids, in DataFrame operations only.

Lines become ids; lines that occur once end runs, so only the others are kept. Prefix doubling ranks the suffixes
of each document's line sequence: the rank of the first 2d lines is the rank of the pair (rank of the first d, rank
of the d after them), in order; each round is a lead within documents, an ordering of the distinct pairs and an
equi-join back, and drops what has become unique. All suffixes that agree on at least d lines - a longest-common-prefix
interval of the array at depth d - share a rank (for other depths, a pair of overlapping ranks).

A line is deleted if it lies in a run of lines of at least ``MIN_WORDS`` words in all that occurs earlier too (in order
of doc_id, then line), however far the run extends. Such runs are unions of shortest windows of ``MIN_WORDS`` words,
from their first and up to their last lines, so intervals at the depths of those windows decide exactly.

Defined cases: a null text is empty, an empty text is one blank line; blank lines count as lines of 0 words; null doc_ids come
first, documents of equal doc_id are ordered by the hash of their text; repeated rows are the same document and
are all treated as its first one; runs may overlap their copy; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.llm.common import WORD, stored, text_of

MIN_WORDS = 10
DOC = ["doc_id", "h"]


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` with rank: numbers that rise in their order."""
    return stored(keys.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def with_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and lines of every row."""
    text = text_of(docs)
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.split(text, "\n").alias("lines"))


def repeated_lines(lined: DataFrame) -> DataFrame:
    """(doc_id, h, line_no, words, rank): the lines that occur more than once, ranked by content."""
    lines = lined.select(*DOC, F.posexplode("lines").alias("line_no", "line"))
    lines = lines.select(*DOC, "line_no", F.regexp_count("line", F.lit(WORD)).alias("words"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"))
    often = _ranked(lines.groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1").select("k1", "k2"), ["k1", "k2"])
    return stored(lines.join(often, ["k1", "k2"]).select(*DOC, "line_no", "words", "rank").dropDuplicates([*DOC, "line_no"]), "lines")


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, a, size): shortest runs of at least ``min_words`` words from each line on, and up to each line."""
    by = W.partitionBy(*DOC).orderBy("line_no")
    rows = lines.withColumn("seg", F.col("line_no") - F.row_number().over(by))
    seg = [*DOC, "seg"]
    rows = rows.withColumn("before", F.sum("words").over(W.partitionBy(*seg).orderBy("line_no")) - F.col("words"))
    ends = rows.groupBy(*seg).agg((F.max("line_no") + 1).alias("line_no"), F.sum("words").alias("before"))
    rows = rows.select(*seg, "line_no", "before").unionByName(ends)
    # the words before a line are the words up to the line above: both windows are running extremes by that number
    up = W.partitionBy(*seg).orderBy(F.desc("before")).rangeBetween(W.unboundedPreceding, -min_words)
    down = W.partitionBy(*seg).orderBy("before").rangeBetween(W.unboundedPreceding, -min_words)
    rows = rows.withColumns({"after": F.min("line_no").over(up), "first": F.max("line_no").over(down)})
    cut = F.array(F.struct(F.col("line_no").alias("a"), (F.col("after") - F.col("line_no")).alias("size")), F.struct(F.col("first").alias("a"), (F.col("line_no") - F.col("first")).alias("size")))
    return rows.select(*DOC, F.explode(cut).alias("w")).select(*DOC, "w.a", "w.size").where("size is not null").distinct()


def doubled(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks of the first 2 * depth lines from ranks of the first ``depth``; what occurs once is left out."""
    ahead = W.partitionBy(*DOC).orderBy("line_no").rangeBetween(depth, depth)
    pairs = ranks.select(*DOC, "line_no", F.col("rank").alias("r1"), F.max("rank").over(ahead).alias("r2")).where("r2 is not null")
    often = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("times")).where("times > 1").select("r1", "r2"), ["r1", "r2"])
    return stored(pairs.join(often, ["r1", "r2"]).select(*DOC, "line_no", "rank"), "suffixes")


def suffix_ranks(lines: DataFrame, most: int) -> DataFrame:
    """(level, doc_id, h, line_no, rank): ranks of the first 2**level lines, for all depths up to ``most`` lines."""
    ranks = lines.select(*DOC, "line_no", "rank")
    out, level = ranks.withColumn("level", F.lit(0)), 0
    while 2 << level <= most:
        ranks = doubled(ranks, 1 << level)
        level += 1
        out = out.unionByName(ranks.withColumn("level", F.lit(level)))
    return out


def later_copies(lined: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, a, size): windows that occur earlier."""
    lines = repeated_lines(lined)
    cut = stored(windows(lines, min_words), "windows")
    most = cut.agg(F.max("size")).first()[0] or 1
    ranks = suffix_ranks(lines, most)
    level = F.floor(F.log2("size")).cast("int")
    cut = cut.withColumn("level", level).withColumn("b", F.col("a") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int"))
    for at, name in (("a", "r1"), ("b", "r2")):
        side = ranks.select(*[F.col(c).alias(f"_{c}") for c in DOC], F.col("line_no").alias(at), "level", F.col("rank").alias(name))
        cut = cut.join(side.withColumnRenamed("level", "_level").withColumnRenamed(at, "_at"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("level") == F.col("_level")) & (F.col(at) == F.col("_at"))).drop("_doc_id", "_h", "_level", "_at")
    cut = stored(cut.select(*DOC, "a", "size", "r1", "r2"), "named")
    first = cut.groupBy("size", "r1", "r2").agg(F.min(F.struct(*DOC, "a")).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = stored(first, "first")  # so that adaptive execution can split a very frequent window in the join below
    return cut.join(first, ["size", "r1", "r2"]).where(~F.struct(*DOC, "a").eqNullSafe(F.col("first"))).select(*DOC, "a", "size")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, deleted_lines, text) of every row: text without later copies of repeated runs."""
    lined = with_lines(docs)
    gone = later_copies(lined, min_words).select(*DOC, F.explode(F.sequence("a", F.col("a") + F.col("size") - 1)).alias("line_no")).distinct()
    gone = gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("line_no")).alias("gone"))  # at most a document's lines
    gone = stored(gone.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "gone"), "gone")
    out = lined.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    deleted = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), deleted)
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.size(deleted).alias("n_deleted"), deleted.alias("deleted_lines"), text.alias("text"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without later copies of repeated runs of lines."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_deleted", "text")


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {
    "op7_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM s),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM e),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
w AS (SELECT x.doc_id, x.i AS a, min(y.i) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 10 GROUP BY 1, 2
 UNION SELECT y.doc_id, max(x.i), y.i FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 10 GROUP BY y.doc_id, y.i),
n AS (SELECT w.doc_id, a, b, string_agg(line, chr(10) ORDER BY i) AS run FROM w JOIN l ON l.doc_id = w.doc_id AND i BETWEEN a AND b GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM n),
g AS (SELECT DISTINCT l.doc_id, i FROM f JOIN l ON l.doc_id = f.doc_id AND i BETWEEN a AND b WHERE k > 1)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.i) AS INTEGER) AS n_deleted,
 coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""
}
