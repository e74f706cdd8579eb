"""Run and sample registries: selection, validation, joins and summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rename_reselect(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Only the mapped columns, under their new names, in the mapping's order."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """df, or an error that lists every missing column."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, or an error if its key is not unique."""
    if bad := duplicate_keys(df, *key).limit(5).collect():
        raise ValueError(f"keys are not unique: {[tuple(r)[:-1] for r in bad]}")
    return df


def unknown_ids(requested: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Requested ids that the registry does not have."""
    return requested.select(key).distinct().join(registry.select(key), key, "left_anti")


def filter_samples(df: DataFrame, projects=(), samples=(), ecogroups=()) -> DataFrame:
    """By the first of projects, samples, ecogroups that is given; all rows if none is."""
    for column, wanted in (("project_id", projects), ("sample_id", samples), ("ecogroup", ecogroups)):
        if wanted:
            return df.where(F.col(column).isin(list(wanted)))
    return df


def not_in(column: str, *values) -> Column:
    """True where the column is none of the values; null counts as different."""
    return F.coalesce(~F.col(column).isin(*values), F.lit(True))


def filter_exclude(df: DataFrame, **blocked) -> DataFrame:
    """Rows none of whose columns has a blocked value; nulls stay."""
    for column, values in blocked.items():
        df = df.where(not_in(column, *values))
    return df


def filter_layout(df: DataFrame, layouts=("PAIRED", "SINGLE"), column: str = "LibraryLayout") -> tuple[DataFrame, DataFrame]:
    """(rows with a known layout, rejected rows)."""
    known = F.coalesce(F.col(column).isin(*layouts), F.lit(False))
    return df.where(known), df.where(~known)


def with_overrides(df: DataFrame, order: list[str], **fields) -> DataFrame:
    """df and a copy of its first row (by ``order``) with fields overridden."""
    first = df.orderBy(*order).limit(1).withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in fields.items()})
    return df.unionByName(first)


def manifest_from_listing(listing: DataFrame, least: int = 10_000_000) -> DataFrame:
    """(sample, n_files, bytes, files) from (path, length): the sample is the second '_' token of the file name."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = listing.where(F.col("length") > least).withColumn("sample", F.get(F.split(name, "_"), 1)).where("sample is not null")
    return rows.groupBy("sample").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.concat_ws(",,", F.array_sort(F.collect_list("path"))).alias("files"))


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared column names."""
    return a.join(b, [c for c in a.columns if c in b.columns])


def inner_join_renamed(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    return a.join(b, a[left] == b[right])


def anti_join_done(new: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """New rows whose key is not done yet."""
    return new.join(done.select(*key), list(key), "left_anti")


def metadata_lookup(df: DataFrame, samples: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """df with the first matching attributes of its sample."""
    first = samples.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in columns])
    return df.join(first, key, "left")


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).distinct()


def sample_coverage(counts: DataFrame, samples: DataFrame, contigs: DataFrame) -> DataFrame:
    """all_reads * (read_length / 2) / genome length per sample."""
    genome = contigs.agg(F.sum("contig_len")).first()[0] or 0  # one number
    df = counts.join(samples.select("sample_idx", "read_length"), "sample_idx")
    return df.select("sample_idx", "all_reads", F.try_divide(F.col("all_reads") * F.col("read_length") / 2, F.lit(genome)).alias("coverage"))


def usage_summary(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean and maximum of the columns."""
    return df.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.max, "max"))])


def rank_by_size(df: DataFrame, key: str, size: str) -> DataFrame:
    """Keys by summed size, largest first; equal sizes by key. One row per key is ranked."""
    total = df.groupBy(key).agg(F.sum(size).alias("total"))
    return total.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), key)))


def head_n(df: DataFrame, number: str, n: int) -> DataFrame:
    """The first n records by record number."""
    return df.where(F.col(number) < n)


def union_members(df: DataFrame, key: str, *conditions: Column) -> DataFrame:
    """Distinct keys that meet any of the conditions."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return df.where(out).select(key).distinct()
