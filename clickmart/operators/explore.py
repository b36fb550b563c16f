"""First look at the tables: sizes, date ranges, traffic by dimension, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.functions.totals import stack_rows
from clickmart.operators.journeys import landing_pages

# How missing campaign fields are shown.
NULL_LABELS = {
    "utm_source": "direct_or_none",
    "utm_campaign": "no_campaign",
    "utm_content": "no_content",
}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return stack_rows(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )


def date_ranges(tables: dict[str, DataFrame], ts: str = "created_at") -> DataFrame:
    return stack_rows(
        [
            df.agg(F.min(ts).alias("min_date"), F.max(ts).alias("max_date")).select(
                F.lit(name).alias("table_name"), "min_date", "max_date"
            )
            for name, df in tables.items()
        ]
    )


def product_catalog(products: DataFrame) -> DataFrame:
    return products.select("product_id", "created_at", "product_name").orderBy("product_id")


def sessions_by(sessions: DataFrame, dim: str, null_label: str | None = None) -> DataFrame:
    """Sessions per value of a dimension. Without a label, NULL stays a group of its own."""
    value = F.col(dim) if null_label is None else F.coalesce(dim, F.lit(null_label))
    return (
        sessions.groupBy(value.alias(dim))
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), dim)
    )


def pageviews_by_url(pageviews: DataFrame) -> DataFrame:
    return (
        pageviews.groupBy("pageview_url")
        .agg(
            F.count("*").alias("pageviews"),
            F.count_distinct("website_session_id").alias("sessions_reached"),
        )
        .orderBy(F.desc("pageviews"), "pageview_url")
    )


def landing_page_sessions(pageviews: DataFrame, rule: str = "id") -> DataFrame:
    return (
        landing_pages(pageviews, rule)
        .groupBy("landing_page")
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "landing_page")
    )


def preview(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(rows)
