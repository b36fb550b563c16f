"""Path A: sessions, conversion and revenue from order headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmart.functions.periods import period
from clickmart.functions.ratios import count_or_zero, money, money_or_zero, pct, per, share_of
from clickmart.functions.totals import as_row, merge_totals


def _margin() -> Column:
    return F.col("price_usd") - F.col("cogs_usd")


# --- Core KPIs -------------------------------------------------------------------------------------------------------


def core_kpis(sessions: DataFrame, orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """The 13 headline metrics as (metric_name, metric_value). Each table is scanned once."""
    one = F.lit(1).cast("bigint")
    totals = merge_totals(
        [
            sessions.select(one.alias("sessions")),
            orders.select(one.alias("orders"), F.col("price_usd").alias("revenue"), _margin().alias("margin")),
            refunds.agg(
                F.sum("refund_amount_usd").alias("refunds"),
                F.count_distinct("order_id").alias("refunded_orders"),
            ),
        ]
    )
    visits, bought = count_or_zero("sessions"), count_or_zero("orders")
    gross, margin, refunded = money("revenue"), money("margin"), money_or_zero("refunds")
    # Metric names, in order.
    metrics = {
        "total_sessions": money(visits),
        "total_orders": money(bought),
        "session_to_order_conversion_rate_pct": pct(bought, visits),
        "gross_revenue": gross,
        "total_refund_amount": refunded,
        "net_revenue": gross - refunded,
        "average_order_value": per(gross, bought),
        "revenue_per_session": per(gross, visits),
        "net_revenue_per_session": per(gross - refunded, visits),
        "gross_margin": margin,
        "gross_margin_rate_pct": pct(margin, gross),
        "refund_share_of_revenue_pct": pct(refunded, gross),
        "refund_order_rate_pct": pct(F.col("refunded_orders"), bought),
    }
    return totals.select([money(value).alias(name) for name, value in metrics.items()]).unpivot(
        [], list(metrics), "metric_name", "metric_value"
    )


def core_kpis_check(sessions: DataFrame, orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Ten of the headline metrics computed another way: daily snapshots per table, added up afterwards.

    Empty tables give 0 instead of NULL sums.
    """

    def daily(df: DataFrame, **totals: Column) -> DataFrame:
        return df.groupBy(period("created_at", "day")).agg(*[t.alias(name) for name, t in totals.items()])

    visits = daily(sessions, visits=F.count("*")).agg(F.sum("visits").alias("visits"))
    sales = daily(
        orders, bought=F.count("*"), price=F.sum("price_usd"), cogs=F.sum("cogs_usd")
    ).agg(*[F.sum(name).alias(name) for name in ("bought", "price", "cogs")])
    returns = daily(refunds, refunded=F.sum("refund_amount_usd")).agg(F.sum("refunded").alias("refunded"))

    n, m = count_or_zero("visits"), count_or_zero("bought")
    gross, cost, refunded = money_or_zero("price"), money_or_zero("cogs"), money_or_zero("refunded")
    # Metric names, in order.
    metrics = {
        "total_sessions": money(n),
        "total_orders": money(m),
        "conversion_rate_pct": pct(m, n),
        "gross_revenue": gross,
        "average_order_value": per(gross, m),
        "revenue_per_session": per(gross, n),
        "gross_margin": gross - cost,
        "gross_margin_rate_pct": pct(gross - cost, gross),
        "total_refund_amount": refunded,
        "net_revenue": gross - refunded,
    }
    return (
        merge_totals([visits, sales, returns])
        .select([money(value).alias(name) for name, value in metrics.items()])
        .unpivot([], list(metrics), "metric_name", "metric_value")
    )


# --- Trends ----------------------------------------------------------------------------------------------------------


def _period_totals(
    sessions: DataFrame, orders: DataFrame, refunds: DataFrame | None, grain: str
) -> DataFrame:
    """Sessions, orders and refunds per period of their own dates; periods without a session are left out."""
    when = period("created_at", grain)
    dated = F.col("created_at").isNotNull()
    one = F.lit(1).cast("bigint")
    parts = [
        sessions.select(when, one.alias("sessions")),
        orders.where(dated).select(
            when, one.alias("orders"), F.col("price_usd").alias("revenue"), _margin().alias("margin")
        ),
    ]
    if refunds is not None:
        parts.append(refunds.where(dated).select(when, F.col("refund_amount_usd").alias("refunds")))
    return merge_totals(parts, (grain,)).where("sessions IS NOT NULL")


def period_kpis(
    sessions: DataFrame, orders: DataFrame, refunds: DataFrame | None = None, grain: str = "month"
) -> DataFrame:
    """KPIs per period. Without refunds, the refund, net revenue and margin columns are left out."""
    totals = _period_totals(sessions, orders, refunds, grain)
    visits, bought = F.col("sessions"), count_or_zero("orders")
    gross, margin = money_or_zero("revenue"), money_or_zero("margin")
    columns = {
        grain: F.col(grain),
        "sessions": visits,
        "orders": bought,
        "conversion_rate_pct": pct(bought, visits),
        "gross_revenue": gross,
    }
    if refunds is not None:
        refunded = money_or_zero("refunds")
        columns |= {
            "refund_amount": refunded,
            "net_revenue": money(gross - refunded),
            "gross_margin": margin,
            "gross_margin_rate_pct": pct(margin, gross),
        }
    columns |= {"average_order_value": per(gross, bought), "revenue_per_session": per(gross, visits)}
    return totals.select([column.alias(name) for name, column in columns.items()]).orderBy(grain)


def period_growth(sessions: DataFrame, orders: DataFrame, grain: str = "month") -> DataFrame:
    """Period KPIs with the change from the previous period that has sessions.

    The window runs over one row per calendar period, not over facts.
    """
    in_order = Window.orderBy(grain)
    kpis = period_kpis(sessions, orders, grain=grain)
    suffix = {"month": "mom", "day": "dod", "week": "wow", "quarter": "qoq", "year": "yoy"}[grain]
    compared = kpis
    for source, name in (("sessions", "sessions"), ("orders", "orders"), ("gross_revenue", "revenue")):
        previous = F.lag(source).over(in_order)
        compared = compared.withColumn(f"{name}_{suffix}_change_pct", pct(F.col(source) - previous, previous))
    return compared.orderBy(grain)


# --- Segments --------------------------------------------------------------------------------------------------------


def orders_per_session(orders: DataFrame) -> DataFrame:
    """Orders and revenue per session, so that joins to sessions meet at most one row each.

    This keeps distinct counts out of the conversion queries and folds a session with very many orders into one row
    before the shuffle.
    """
    return orders.groupBy("website_session_id").agg(
        F.count("order_id").alias("orders"), F.sum("price_usd").alias("revenue")
    )


def segment_totals(
    sessions: DataFrame, orders: DataFrame, dims: list[str], null_labels: dict[str, str] | None = None
) -> DataFrame:
    """Sessions, orders and revenue per segment; sessions without an order stay in the count."""
    labels = null_labels or {}
    keys = [
        F.coalesce(dim, F.lit(labels[dim])).alias(dim) if dim in labels else F.col(dim) for dim in dims
    ]
    return (
        sessions.select("website_session_id", *keys)
        .join(orders_per_session(orders), "website_session_id", "left")
        .groupBy(*dims)
        .agg(
            F.count("*").alias("sessions"),
            F.sum("orders").alias("orders"),
            F.sum("revenue").alias("revenue"),
        )
    )


def filter_volume(totals: DataFrame, min_sessions: int) -> DataFrame:
    return totals.where(F.col("sessions") >= min_sessions) if min_sessions > 0 else totals


def rated_segments(totals: DataFrame, dims: list[str]) -> DataFrame:
    visits, bought, gross = F.col("sessions"), count_or_zero("orders"), money_or_zero("revenue")
    return totals.select(
        *dims,
        "sessions",
        bought.alias("orders"),
        pct(bought, visits).alias("conversion_rate_pct"),
        gross.alias("gross_revenue"),
        per(gross, bought).alias("average_order_value"),
        per(gross, visits).alias("revenue_per_session"),
    )


def segment_performance(
    sessions: DataFrame,
    orders: DataFrame,
    dims: list[str],
    null_labels: dict[str, str] | None = None,
    min_sessions: int = 0,
) -> DataFrame:
    totals = segment_totals(sessions, orders, dims, null_labels)
    return rated_segments(filter_volume(totals, min_sessions), dims).orderBy(F.desc("gross_revenue"), *dims)


def site_totals(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: all sessions, their orders and revenue."""
    return segment_totals(sessions, orders, [])


def add_up(totals: DataFrame) -> DataFrame:
    """One row: the site as the sum of its segments."""
    return totals.agg(*[F.sum(name).alias(name) for name in ("sessions", "orders", "revenue")])


def beside_site_average(rated: DataFrame, site: DataFrame) -> DataFrame:
    """Add the site's totals, share of sessions and the gaps to the site average (of rounded values)."""
    visits, gross = F.col("sessions"), money_or_zero("revenue")
    average = as_row(
        site.select(
            visits.alias("sessions"),
            pct(count_or_zero("orders"), visits).alias("conversion"),
            per(gross, visits).alias("rps"),
        )
    )
    beside = rated.withColumn("_site", average)
    return beside.select(
        *rated.columns,
        F.col("_site.sessions").alias("total_sessions"),
        pct(visits, F.col("_site.sessions")).alias("session_share_pct"),
        F.col("_site.conversion").alias("overall_conversion_rate_pct"),
        F.col("_site.rps").alias("overall_revenue_per_session"),
        (F.col("conversion_rate_pct") - F.col("_site.conversion")).cast("decimal(18,2)").alias(
            "conversion_rate_gap_pp"
        ),
        (F.col("revenue_per_session") - F.col("_site.rps")).cast("decimal(18,2)").alias(
            "revenue_per_session_gap"
        ),
    )


def converts_well() -> Column:
    return F.col("conversion_rate_pct") >= F.col("overall_conversion_rate_pct")


def earns_well() -> Column:
    return F.col("revenue_per_session") >= F.col("overall_revenue_per_session")


def has_volume(share: float) -> Column:
    return F.col("sessions") >= share_of(F.col("total_sessions"), share)


def source_campaign_segments(
    sessions: DataFrame,
    orders: DataFrame,
    null_labels: dict[str, str],
    min_sessions: int = 1000,
    share: float = 0.10,
) -> DataFrame:
    """Source and campaign pairs against the site average, which also counts pairs below ``min_sessions``."""
    dims = ["utm_source", "utm_campaign"]
    totals = segment_totals(sessions, orders, dims, null_labels)
    compared = beside_site_average(rated_segments(filter_volume(totals, min_sessions), dims), add_up(totals))
    # Segment labels; the first rule that holds decides.
    segment = (
        F.when(converts_well() & earns_well(), "high_quality_traffic")
        .when(has_volume(share) & ~earns_well(), "high_volume_lower_efficiency")
        .when(~has_volume(share) & earns_well(), "smaller_but_high_value")
        .otherwise("average_or_low_priority")
    )
    # The report's columns.
    return compared.select(
        *dims,
        "sessions",
        "orders",
        "conversion_rate_pct",
        "gross_revenue",
        "average_order_value",
        "revenue_per_session",
        "session_share_pct",
        segment.alias("business_segment"),
    ).orderBy(F.desc("revenue_per_session"), *dims)


def compared_columns(dim: str, status: Column, name: str) -> list[Column]:
    """The columns shared by the device and landing page comparisons."""
    # The reports' columns.
    columns = (
        dim,
        "sessions",
        "session_share_pct",
        "orders",
        "conversion_rate_pct",
        "overall_conversion_rate_pct",
        "conversion_rate_gap_pp",
        "gross_revenue",
        "revenue_per_session",
        "overall_revenue_per_session",
        "revenue_per_session_gap",
    )
    return [*map(F.col, columns), status.alias(name)]


def device_opportunity(sessions: DataFrame, orders: DataFrame, share: float = 0.30) -> DataFrame:
    """Devices against the site average."""
    totals = segment_totals(sessions, orders, ["device_type"])
    compared = beside_site_average(rated_segments(totals, ["device_type"]), add_up(totals))
    # Opportunity labels; the first rule that holds decides.
    status = (
        F.when(has_volume(share) & ~converts_well(), "high_volume_underperforming_device")
        .when(converts_well() & earns_well(), "strong_device_segment")
        .otherwise("monitor")
    )
    return compared.select(compared_columns("device_type", status, "device_opportunity")).orderBy(
        F.desc("sessions"), "device_type"
    )


# --- Users -----------------------------------------------------------------------------------------------------------


def user_cohorts(sessions: DataFrame, grain: str = "month") -> DataFrame:
    """Users by the period of their first session and each period they were active in.

    The first period comes from a window over a user's distinct periods, which the calendar bounds.
    """
    first = f"first_{grain}"
    activity = sessions.where("user_id IS NOT NULL").select("user_id", period("created_at", grain)).distinct()
    return (
        activity.withColumn(first, F.min(grain).over(Window.partitionBy("user_id")))
        .groupBy(first, grain)
        .agg(F.count("*").alias("users"))
        .orderBy(first, grain)
    )
