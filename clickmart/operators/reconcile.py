"""Two independent KPI computations side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.functions.ratios import money
from clickmart.operators.traffic import core_kpis, core_kpis_check


def kpi_reconciliation(sessions: DataFrame, orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Metrics both computations have, with their difference; the conversion rate goes by two names."""
    check = core_kpis_check(sessions, orders, refunds).select(
        F.when(F.col("metric_name") == "conversion_rate_pct", "session_to_order_conversion_rate_pct")
        .otherwise(F.col("metric_name"))
        .alias("metric_name"),
        F.col("metric_value").alias("check_value"),
    )
    return (
        core_kpis(sessions, orders, refunds)
        .join(check, "metric_name")
        .select(
            "metric_name",
            "metric_value",
            "check_value",
            money(F.col("metric_value") - F.col("check_value")).alias("difference"),
        )
        .orderBy("metric_name")
    )
