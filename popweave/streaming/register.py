"""Incremental registration of sequencing runs as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.operators.registry import anti_join_done, filter_layout, require_columns

LAYOUTS = ("PAIRED", "SINGLE")


def new_runs(batch: DataFrame, known: DataFrame | None, layouts=LAYOUTS) -> DataFrame:
    """Valid rows of a batch, one per Run (that of the least content hash), not registered yet."""
    good, _ = filter_layout(require_columns(batch, ["Run", "LibraryLayout"]), layouts)
    columns = [c for c in good.columns if c != "Run"]
    pick = F.min(F.struct(F.xxhash64(*good.columns).alias("_h"), *columns)).alias("_r")
    rows = good.where("Run is not null").groupBy("Run").agg(pick).select("Run", *[F.col("_r")[c].alias(c) for c in columns]).select(*good.columns)
    return rows if known is None else anti_join_done(rows, known, "Run")


def register_runs_stream(spark: SparkSession, source: str, schema: str, registry: str, checkpoint: str, layouts=LAYOUTS):
    """Append the new runs of the files below ``source`` to the Parquet registry; stops when all files are read.

    Each micro-batch anti-joins the registry as it then is and writes its own batch folder, so that a batch repeated
    after a failure replaces its rows.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        others = F.col("batch") != batch_id
        try:
            known = s.read.parquet(registry).where(others)
        except Exception as e:  # noqa: BLE001 - no registry yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        new_runs(batch, known, layouts).write.mode("overwrite").parquet(f"{registry}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
