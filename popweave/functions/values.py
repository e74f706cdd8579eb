"""Small column functions: dates as stamps, minutes between times, values that are absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(time: str | Column | None = None) -> Column:
    """A date as eight digits, year first; without an argument that of today."""
    return F.date_format(F.current_date() if time is None else time, "yyyyMMdd")


def minutes_between(begin: str, end: str) -> Column:
    """Whole minutes from one time to another, cut towards zero; negative if the second comes first."""
    return F.timestamp_diff("MINUTE", F.col(begin), F.col(end))


def absent(value: str) -> Column:
    """True for null and for not-a-number."""
    return F.col(value).isNull() | F.isnan(value)
