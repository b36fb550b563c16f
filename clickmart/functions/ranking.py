"""Rank over a whole table without sending it through one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column, scale: int) -> Column:
    """A whole number that never falls as the decimal rises: sign, number of digits, first four digits.

    There are at most some hundred thousand of them, however many values.
    """
    units = (F.abs(value) * F.lit(10**scale)).cast("decimal(38,0)").cast("string")
    lead = F.rpad(F.substring(units, 1, 4), 4, "0").cast("bigint")
    return F.signum(value).cast("bigint") * (F.length(units) * 10_000 + lead)


def rank_over_all(df: DataFrame, value: str, name: str, among: DataFrame | None = None) -> DataFrame:
    """Add ``RANK() OVER (ORDER BY value DESC NULLS FIRST)`` of a decimal or whole number as the bigint column ``name``.

    Equal values are counted first, so ties, however many, are one row. A rank is the number of rows in higher buckets
    of values plus the number above within the bucket. The values are read from ``among``: ``df`` itself unless a
    plainer table with the same rows is at hand.
    """
    source = df if among is None else among
    ties = source.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    ties = ties.withColumn("_bucket", _bucket(F.col("_value"), getattr(df.schema[value].dataType, "scale", 0)))

    above = Window.orderBy(F.desc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    higher = ties.groupBy("_bucket").agg(F.sum("_rows").alias("_rows"))
    higher = higher.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_higher"))

    descending = Window.partitionBy("_bucket").orderBy(F.desc_nulls_first("_value"))
    within = F.sum("_rows").over(descending.rowsBetween(Window.unboundedPreceding, -1))
    ranked = ties.withColumn("_within", F.coalesce(within, F.lit(0))).join(higher, F.col("_bucket").eqNullSafe(F.col("_of")))
    ranked = ranked.select("_value", (1 + F.col("_higher") + F.col("_within")).cast("bigint").alias(name))
    return df.join(ranked, df[value].eqNullSafe(ranked["_value"])).drop("_value")


def ranks_over_all(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Add several ranks in one pass: ``ranks`` maps a decimal or whole number to its rank's name, as `rank_over_all`.

    The values of all measures are stacked as (measure, value), so ties, buckets and ranks of all of them are one table,
    which the stacked rows meet in one join. Rows are put together again by their columns; equal rows stay as many.
    """
    scale = max(getattr(df.schema[value].dataType, "scale", 0) for value in ranks)
    stacked = [
        F.struct(F.lit(i).alias("measure"), F.col(value).cast(f"decimal(38,{scale})").alias("value"))
        for i, value in enumerate(ranks)
    ]
    rows = df.withColumn("_of", F.explode(F.array(*stacked)))
    rows = rows.select(*df.columns, F.col("_of.measure").alias("_measure"), F.col("_of.value").alias("_value"))

    ties = rows.groupBy("_measure", "_value").agg(F.count("*").alias("_rows"))
    ties = ties.withColumn("_bucket", _bucket(F.col("_value"), scale))
    above = Window.partitionBy("_measure").orderBy(F.desc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    higher = ties.groupBy("_measure", "_bucket").agg(F.sum("_rows").alias("_rows"))
    higher = higher.select(
        F.col("_measure").alias("_by"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_higher")
    )
    descending = Window.partitionBy("_measure", "_bucket").orderBy(F.desc_nulls_first("_value"))
    within = F.sum("_rows").over(descending.rowsBetween(Window.unboundedPreceding, -1))
    placed = ties.withColumn("_within", F.coalesce(within, F.lit(0)))
    placed = placed.join(higher, (F.col("_measure") == F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_in")))
    placed = placed.select(
        F.col("_measure").alias("_with"),
        F.col("_value").alias("_ranked"),
        (1 + F.col("_higher") + F.col("_within")).cast("bigint").alias("_rank"),
    )

    met = rows.join(placed, (F.col("_measure") == F.col("_with")) & F.col("_value").eqNullSafe(F.col("_ranked")))
    found = [F.max(F.when(F.col("_measure") == i, F.col("_rank"))).alias(name) for i, name in enumerate(ranks.values())]
    again = met.groupBy(*df.columns).agg(*found, F.count_if(F.col("_measure") == 0).cast("int").alias("_copies"))
    again = again.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return again.drop("_copies", "_copy")
