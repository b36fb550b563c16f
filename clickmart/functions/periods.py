"""Calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")


def period(ts: Column | str, grain: str) -> Column:
    """First day of the period that holds ``ts``, as a date named after the grain.

    Works on the date, so timestamps without a zone never pass through the session time zone.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    day = F.to_date(ts)
    return (day if grain == "day" else F.trunc(day, grain)).alias(grain)


def calendar_parts(day: Column | str) -> list[Column]:
    """Year, quarter, month, month name and year-month of a date."""
    return [
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
    ]
