"""Totals of several tables side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_totals(parts: list[DataFrame], keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum the measures of several tables per key: one union, one aggregate, no joins.

    Each part has the key columns and measures of its own. Rows are combined before the single shuffle, keys match
    NULL to NULL, and a measure is NULL where its table has no row for the key.
    """
    measures = [name for part in parts for name in part.columns if name not in keys]
    stacked = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    return stacked.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in measures])


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, parts)


def as_row(df: DataFrame):
    """A one-row DataFrame as a struct column (a scalar subquery), to set every row beside site-wide values."""
    return df.select(F.struct("*")).scalar()
