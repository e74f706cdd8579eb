"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm.common import stored

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct. Each node points (larger, or smaller, neighbours) at its least neighbour."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        out = turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the component, for every id in ``edges`` (columns u, v) that is not a root itself."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = stored(edges, "edges"), None
    mark = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))]
    for _ in range(MOST_ROUNDS):
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
        now = edges.agg(*mark).first()
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")
