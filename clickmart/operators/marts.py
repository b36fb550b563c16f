"""Dimension and fact tables for the metric registry and for staging."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmart.functions.periods import calendar_parts
from clickmart.functions.totals import stack_rows
from clickmart.operators.explore import NULL_LABELS
from clickmart.operators.journeys import session_landing


def _named(column: str) -> Column:
    """A campaign field with NULL and empty text replaced by its label."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(NULL_LABELS[column]))


def _calendar(bounds: DataFrame) -> DataFrame:
    """One row per day of a one-row table of (first, last)."""
    return (
        bounds.select(F.explode(F.sequence("first", "last")).alias("date"))
        .select("date", *calendar_parts("date"))
        .orderBy("date")
    )


def dim_date(facts: dict[str, DataFrame], ts: str = "created_at") -> DataFrame:
    """One row per day from the first to the last event of any fact, so no event falls off the calendar."""
    bounds = [
        df.agg(F.to_date(F.min(ts)).alias("first"), F.to_date(F.max(ts)).alias("last"))
        for df in facts.values()
    ]
    return _calendar(stack_rows(bounds).agg(F.min("first").alias("first"), F.max("last").alias("last")))


def dim_date_between(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per day between two given dates."""
    return _calendar(spark.createDataFrame([(first, last)], "first date, last date"))


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", F.to_date("created_at").alias("launch_date"))


def dim_landing_page(pageviews: DataFrame) -> DataFrame:
    return session_landing(pageviews).select("landing_page").distinct()


def dim_channel(sessions: DataFrame) -> DataFrame:
    """Source, campaign and content combinations, one row each."""
    return sessions.select([_named(column).alias(column) for column in NULL_LABELS]).distinct()


def dim_user(sessions: DataFrame) -> DataFrame:
    return sessions.where("user_id IS NOT NULL").select("user_id").distinct()


def fact_session(sessions: DataFrame) -> DataFrame:
    repeat = F.col("is_repeat_session") == 1
    return sessions.select(
        "website_session_id",
        F.to_date("created_at").alias("session_date"),
        "user_id",
        repeat.alias("is_repeat_session"),
        F.when(repeat, "Repeat").when(~repeat, "New").alias("session_type"),
        *[_named(column).alias(column) for column in NULL_LABELS],
        "device_type",
    )


def fact_order(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        F.to_date("created_at").alias("order_date"),
        "website_session_id",
        "user_id",
        "price_usd",
        "cogs_usd",
    )


def fact_order_item(items: DataFrame) -> DataFrame:
    return items.select(
        "order_item_id",
        F.to_date("created_at").alias("item_date"),
        "order_id",
        "product_id",
        (F.col("is_primary_item") == 1).alias("is_primary_item"),
        "price_usd",
        "cogs_usd",
    )


def fact_refund(refunds: DataFrame) -> DataFrame:
    return refunds.select(
        "order_item_refund_id",
        F.to_date("created_at").alias("refund_date"),
        "order_item_id",
        "order_id",
        "refund_amount_usd",
    )
