"""Numbers and sums along an order of all rows, and pointer jumping: tasks are ranges of the order, not its keys.

Rows are sorted by ranges into a table of the shared folder that keeps each row's range and place; what came before a
range is a running sum over a table of one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from popweave.functions.scratch import stored

PART, AT = "_part", "_at"
_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` sorted by ranges and stored, with its range and its place in the range from 0 on. Rows of equal order come in any one order."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    return stored(df.orderBy(*order).withColumns({PART: F.spark_partition_id(), AT: place}), "ranges")


def _before(sums: DataFrame, names: dict[str, str]) -> DataFrame:
    w = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    return F.broadcast(sums.select(PART, *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for v, n in names.items()]))


def numbered(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """``df`` with numbers from 1 on along ``order``."""
    rows = ranged(df, order)
    counts = rows.groupBy(PART).agg(F.count("*").alias("_n"))
    return rows.join(_before(counts, {"_n": "_before"}), PART).withColumn(name, F.col("_before") + F.col(AT) + 1).drop(PART, AT, "_before")


def running_sum(df: DataFrame, order: list, value: str | Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` (never null) over all rows up to each, itself included, along ``order``."""
    rows = ranged(df.withColumn("_v", F.col(value) if isinstance(value, str) else value), order)
    sums = rows.groupBy(PART).agg(F.sum("_v").alias("_n"))
    inside = F.sum("_v").over(W.partitionBy(PART).orderBy(AT))
    return rows.withColumn(name, inside).join(_before(sums, {"_n": "_before"}), PART).withColumn(name, F.col("_before") + F.col(name)).drop(PART, AT, "_v", "_before")


def running_sums(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """``df`` with each of the columns ``values`` (never null) replaced by its sum over all rows up to each, itself included, along ``order``."""
    rows = ranged(df, order)
    before = _before(rows.groupBy(PART).agg(*[F.sum(v).alias(v) for v in values]), {v: f"_before_{v}" for v in values})
    inside = W.partitionBy(PART).orderBy(AT).rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = [c for c in df.columns if c not in values]
    return rows.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, PART).select(*rest, *[(F.col(v) + F.col(f"_before_{v}")).alias(v) for v in values])


def roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, root, sign) from links (id, parent, sign) by pointer doubling: the last id of each chain and the product of its signs.

    Every parent that has no link of its own is a root; ids that are roots are not in the result. Chains must end.
    """
    rows = stored(links.select("id", F.col("parent").alias("root"), "sign"), "chains")
    for _ in range(most_rounds):
        up = rows.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("sign").alias("_sign"))
        out = rows.join(up, "root", "left").select("id", F.coalesce("_root", "root").alias("root"), (F.col("sign") * F.coalesce("_sign", F.lit(1))).alias("sign"), F.col("_root").isNotNull().alias("_more"))
        out = stored(out, "chains")
        rows = out.drop("_more")
        if not out.where("_more").limit(1).count():
            return rows
    raise RuntimeError("chains did not end")
