"""Broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def fits(df: DataFrame, most: int = MOST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows; no more than one above that are counted per partition."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it fits: sample sheets, populations, contigs. A larger one is joined by a shuffle."""
    return F.broadcast(df) if fits(df, most) else df
