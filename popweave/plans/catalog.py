"""All registered queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from popweave.plans import io_queries, junction_queries, read_queries, registry_queries, stat_queries, variant_queries

MODULES = [io_queries, registry_queries, read_queries, junction_queries, variant_queries, stat_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.C.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.C.oracles.items()}
