"""Every job of the library on the driver's tables, by name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmart.functions.totals import stack_rows
from clickmart.operators import explore, journeys, marts, products, quality, reconcile, traffic
from clickmart.operators.journeys import FunnelStep
from clickmart.plans import metrics, staged
from clickmart.sources import readers, staging
from clickmart.sources.bindings import PRODUCT_TYPES, DriverTables
from clickmart.sources.schemas import RELATIONS, SCHEMAS

# The funnel of `events`; errors are no step.
EVENT_FUNNEL = (
    FunnelStep(1, "session_started", "Session started", ()),
    FunnelStep(2, "reached_view", "View", ("/view",)),
    FunnelStep(3, "reached_click", "Click", ("/click",)),
    FunnelStep(4, "reached_signup", "Signup", ("/signup",)),
    FunnelStep(5, "completed_order", "Order completed", ("/purchase",)),
)
EVENT_PAGES = ["/view", "/click", "/signup", "/purchase", "/error"]

# Volume floors that cut some groups and keep some at sf 0.01.
MIN_CAMPAIGN_SESSIONS = 250
MIN_LANDING_SESSIONS = 800

# The events span 30 days; spread out like this they fall into six months.
MONTHS_SPREAD = 6

# The month of the orders that is staged again.
REWRITTEN_MONTH = "1995-03"
ORDER_COLUMNS = ("order_id", "created_at", "user_id", "price_usd", "cogs_usd")

JOBS: dict[str, Callable[[DriverTables], DataFrame]] = {}
SPREAD: dict[str, int] = {}


def job(function: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    JOBS[function.__name__] = function
    return function


def monthly_job(function: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    """A job whose events are spread over several months."""
    SPREAD[function.__name__] = MONTHS_SPREAD
    return job(function)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[DriverTables], DataFrame], spread: int) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(DriverTables(spark, sf_dir, spread))

    return {name: bind(run, SPREAD.get(name, 1)) for name, run in JOBS.items()}


def _all_tables(t: DriverTables, items: DataFrame | None = None) -> dict[str, DataFrame]:
    return {
        "products": t.products(),
        "website_sessions": t.sessions(),
        "website_pageviews": t.pageviews(),
        "orders": t.orders(),
        "order_items": t.lines() if items is None else items,
        "order_item_refunds": t.refunds(),
    }


# --- Exploration ---


@job
def row_counts(t):
    return explore.row_counts(_all_tables(t))


@job
def date_ranges(t):
    return explore.date_ranges(_all_tables(t, t.dated_lines()))


@job
def product_catalog(t):
    return explore.product_catalog(t.products())


@job
def sessions_by_source(t):
    return explore.sessions_by(t.sessions(), "utm_source", "direct_or_none")


@job
def sessions_by_campaign(t):
    return explore.sessions_by(t.sessions(), "utm_campaign", "no_campaign")


@job
def sessions_by_content(t):
    return explore.sessions_by(t.sessions(), "utm_content", "no_content")


@job
def sessions_by_device(t):
    return explore.sessions_by(t.sessions(), "device_type")


@job
def referer_sessions(t):
    return explore.sessions_by(t.sessions(), "http_referer")


@job
def pageviews_by_url(t):
    return explore.pageviews_by_url(t.pageviews())


@job
def landing_page_sessions(t):
    return explore.landing_page_sessions(t.pageviews())


# --- Data quality ---


@job
def pk_uniqueness(t):
    return quality.pk_uniqueness(_all_tables(t))


@job
def pk_nulls(t):
    return quality.pk_nulls(_all_tables(t))


@job
def fk_orphans(t):
    path_a = {
        "website_sessions": t.sessions(),
        "website_pageviews": t.pageviews(),
        "orders": t.session_orders(),
    }
    path_b = {
        "products": t.products(),
        "orders": t.orders_with_primary(),
        "order_items": t.lines(),
        "order_item_refunds": t.refunds(),
    }
    to_session = [relation for relation in RELATIONS if relation.parent == "website_sessions"]
    others = [relation for relation in RELATIONS if relation.parent != "website_sessions"]
    return stack_rows([quality.fk_orphans(path_a, to_session), quality.fk_orphans(path_b, others)])


@job
def orders_per_session(t):
    return quality.most_per_parent(
        t.session_orders(), "website_session_id", "max_orders_per_session", "sessions_with_multiple_orders"
    )


@job
def pageviews_per_session(t):
    return quality.spread_per_parent(t.pageviews(), "website_session_id", "pageviews_per_session")


@job
def items_per_order(t):
    return quality.spread_per_parent(t.lines(), "order_id", "items_per_order")


@job
def refunds_per_item(t):
    return quality.most_per_parent(
        t.refunds(), "order_item_id", "max_refunds_per_order_item", "order_items_with_multiple_refunds"
    )


@job
def orders_before_session(t):
    return quality.events_before_parent(
        t.session_orders(), t.sessions(), "website_session_id", "orders_before_session_count"
    )


@job
def pageviews_before_session(t):
    return quality.events_before_parent(
        t.pageviews(), t.sessions(), "website_session_id", "pageviews_before_session_count"
    )


@job
def refunds_before_item(t):
    return quality.events_before_parent(
        t.refunds(), t.dated_lines(), "order_item_id", "refunds_before_order_item_count"
    )


@job
def refunds_before_order(t):
    return quality.events_before_parent(t.refunds(), t.orders(), "order_id", "refunds_before_order_count")


# --- KPIs ---


@job
def core_kpis(t):
    return traffic.core_kpis(t.sessions(), t.session_orders(), t.session_refunds())


@monthly_job
def monthly_kpis(t):
    return traffic.period_kpis(t.sessions(), t.session_orders(), t.session_refunds(), grain="month")


@job
def daily_kpis(t):
    return traffic.period_kpis(t.sessions(), t.session_orders(), t.session_refunds(), grain="day")


@job
def source_performance(t):
    labels = {"utm_source": "direct_or_none"}
    return traffic.segment_performance(t.sessions(), t.session_orders(), ["utm_source"], labels)


@job
def campaign_performance(t):
    labels = {"utm_campaign": "no_campaign"}
    return traffic.segment_performance(t.sessions(), t.session_orders(), ["utm_campaign"], labels)


@job
def device_performance(t):
    return traffic.segment_performance(t.sessions(), t.session_orders(), ["device_type"])


@job
def product_performance(t):
    return products.product_performance(t.lines(), t.products(), t.refunds())


# --- Business analysis ---


@monthly_job
def monthly_growth(t):
    return traffic.period_growth(t.sessions(), t.session_orders(), grain="month")


@job
def daily_growth(t):
    return traffic.period_growth(t.sessions(), t.session_orders(), grain="day")


@job
def source_campaign_segments(t):
    return traffic.source_campaign_segments(
        t.sessions(), t.session_orders(), explore.NULL_LABELS, min_sessions=MIN_CAMPAIGN_SESSIONS
    )


@job
def device_opportunity(t):
    return traffic.device_opportunity(t.sessions(), t.session_orders())


@job
def product_refund_risk(t):
    return products.product_refund_risk(t.lines(), t.products(), t.refunds())


@job
def landing_page_performance(t):
    return journeys.landing_page_performance(
        t.pageviews(), t.sessions(), t.session_orders(), min_sessions=MIN_LANDING_SESSIONS
    )


@job
def funnel_steps(t):
    return journeys.funnel_steps(t.pageviews(), EVENT_FUNNEL)


# --- Notebook jobs ---


@job
def core_kpis_check(t):
    return traffic.core_kpis_check(t.sessions(), t.session_orders(), t.session_refunds())


@monthly_job
def monthly_trend(t):
    return traffic.period_kpis(t.sessions(), t.session_orders(), grain="month")


@job
def daily_trend(t):
    return traffic.period_kpis(t.sessions(), t.session_orders(), grain="day")


@job
def monthly_items_per_order(t):
    return products.items_per_order_by_period(t.lines(), orders=t.orders())


@job
def monthly_product_sales(t):
    return products.product_sales_by_period(t.dated_lines(), t.products())


def _type_sales(t: DriverTables) -> DataFrame:
    return products.product_sales_by_period(t.dated_lines(), t.products(), label="product_type")


@job
def monthly_items_pivot(t):
    return products.pivot_periods(_type_sales(t), "month", "product_type", "items_sold", PRODUCT_TYPES)


@job
def monthly_product_mix(t):
    return products.product_mix(_type_sales(t), label="product_type")


@job
def monthly_mix_pivot(t):
    mix = products.product_mix(_type_sales(t), label="product_type")
    return products.pivot_periods(mix, "month", "product_type", "product_share_pct", PRODUCT_TYPES)


@job
def product_refund_summary(t):
    return products.product_refund_summary(t.lines(), t.products(), t.refunds())


# --- Marts ---


@job
def session_landing(t):
    return journeys.session_landing(t.pageviews())


@job
def session_funnel_flags(t):
    return journeys.funnel_flags(t.pageviews(), EVENT_FUNNEL)


@job
def session_funnel_long(t):
    return journeys.funnel_long(journeys.funnel_flags(t.pageviews(), EVENT_FUNNEL), EVENT_FUNNEL)


@job
def dim_landing_page(t):
    return marts.dim_landing_page(t.pageviews())


@job
def dim_date(t):
    return marts.dim_date(
        {"sessions": t.sessions(), "orders": t.session_orders(), "refunds": t.session_refunds()}
    )


@job
def dim_product(t):
    return marts.dim_product(t.products())


@job
def dim_channel(t):
    return marts.dim_channel(t.sessions())


@job
def dim_user(t):
    return marts.dim_user(t.sessions())


@job
def fact_session(t):
    return marts.fact_session(t.sessions())


@job
def fact_order(t):
    return marts.fact_order(t.session_orders())


@job
def fact_order_item(t):
    return marts.fact_order_item(t.items())


@job
def fact_refund(t):
    return marts.fact_refund(t.refunds())


# --- Metric registry ---


def _session_model(t: DriverTables) -> dict[str, DataFrame]:
    return metrics.build_model(
        {
            "website_sessions": t.sessions(),
            "orders": t.session_orders(),
            "order_items": t.session_items(),
            "order_item_refunds": t.session_refunds(),
            "products": t.products(),
            "website_pageviews": t.pageviews(),
        },
        EVENT_FUNNEL,
    )


CHANNEL_METRICS = [
    "total_sessions",
    "total_orders",
    "channel_conversion_rate",
    "gross_revenue",
    "channel_revenue_per_session",
    "net_revenue",
    "refunded_orders",
    "distinct_users",
]
REPEAT_METRICS = [
    "total_sessions",
    "new_sessions",
    "repeat_sessions",
    "repeat_session_share",
    "orders_from_repeat_sessions",
    "repeat_session_conversion_rate",
    "distinct_users",
]
STAGED_METRICS = [name for name in CHANNEL_METRICS if name not in ("refunded_orders", "distinct_users")]
FIRST_WEEKS = (dt.date(2024, 1, 5), dt.date(2024, 1, 20))


@job
def metrics_overall(t):
    return metrics.compute(_session_model(t))


@job
def metrics_by_source(t):
    return metrics.compute(_session_model(t), by=["utm_source"])


@job
def metrics_by_device(t):
    return metrics.compute(_session_model(t), CHANNEL_METRICS, by=["device_type"])


@job
def new_vs_repeat(t):
    return metrics.compute(_session_model(t), REPEAT_METRICS, by=["device_type"])


@job
def revenue_by_order_date(t):
    model = metrics.build_model({"orders": t.orders()})
    chosen = ["total_orders", "gross_revenue_order_date", "average_order_value", "gross_margin_rate"]
    return metrics.compute(model, chosen, by=["date"], date_role="order")


@job
def product_mix_pct(t):
    model = metrics.build_model({"order_item_refunds": t.refunds(), "products": t.products()})
    model["items"] = t.lines()  # dates and flags are not asked for
    chosen = ["items_sold", "product_mix", "product_net_revenue", "item_refund_rate"]
    return metrics.compute(model, chosen, by=["product_name"])


@job
def refund_order_rate_by_source(t):
    return metrics.compute(_session_model(t), ["refund_order_rate"], by=["utm_source"])


@job
def metrics_without_campaign(t):
    """Sessions that came by no advertisement, or by one of two; a missing value is chosen by None."""
    model = _session_model(t)
    raw = t.sessions().select("website_session_id", F.col("utm_content").alias("content"))
    model["sessions"] = model["sessions"].join(raw, "website_session_id")
    return metrics.compute(model, CHANNEL_METRICS, by=["device_type"], filters={"content": [None, "ad_1"]})


@job
def metrics_filtered(t):
    return metrics.compute(
        _session_model(t),
        CHANNEL_METRICS,
        by=["utm_campaign"],
        filters={
            "device_type": "desktop",
            "utm_source": ["gsearch", "bsearch"],
            "date": lambda day: day.between(*FIRST_WEEKS),
        },
    )


@monthly_job
def metrics_by_month(t):
    return metrics.compute(_session_model(t), CHANNEL_METRICS, by=["year_month"])


@monthly_job
def metrics_in_second_quarter(t):
    """Orders of one quarter, by month of the order."""
    model, chosen = _session_model(t), ["total_orders", "gross_revenue", "refund_amount", "refunded_orders"]
    return metrics.compute(model, chosen, by=["month_name", "utm_source"], filters={"quarter": 2}, date_role="order")


@job
def revenue_by_order_quarter(t):
    model = metrics.build_model({"orders": t.orders()})
    chosen = ["total_orders", "gross_revenue_order_date", "average_order_value", "gross_margin_rate"]
    return metrics.compute(model, chosen, by=["year", "quarter"], date_role="order")


@job
def metrics_by_landing_page(t):
    return metrics.compute(_session_model(t), CHANNEL_METRICS, by=["landing_page"])


@job
def metrics_by_funnel_step(t):
    return metrics.compute(_session_model(t), CHANNEL_METRICS, by=["funnel_step", "device_type"])


@job
def metrics_after_signup(t):
    """Orders and sessions of the sessions that reached one of two steps; a session that reached both counts once."""
    steps = {"funnel_step": ["reached_signup", "completed_order"]}
    return metrics.compute(_session_model(t), CHANNEL_METRICS, by=["utm_source"], filters=steps)


@monthly_job
def staged_metrics_by_month(t):
    """Distinct numbers from the facts, all else from staged totals."""
    model = _session_model(t)
    totals = staged.stage_totals(model, staging.new_folder(t.spark), ["utm_source"])
    return staged.compute_staged(model, totals, CHANNEL_METRICS, by=["year_month"])


@job
def staged_metrics_filtered(t):
    """Some days are staged again; a range of days is read from their partitions."""
    model, chosen = _session_model(t), {"device_type": "desktop", "utm_source": ["gsearch", "bsearch"]}
    totals = staged.stage_totals(model, staging.new_folder(t.spark), ["utm_source", "utm_campaign", "device_type"])
    staged.refresh_days(model, totals, [FIRST_WEEKS[0], dt.date(2023, 1, 1)])
    chosen["date"] = lambda day: day.between(*FIRST_WEEKS)
    return staged.compute_staged(model, totals, STAGED_METRICS, by=["utm_campaign"], filters=chosen)


# --- Reconciliation and documented uses ---


@job
def kpi_reconciliation(t):
    return reconcile.kpi_reconciliation(t.sessions(), t.session_orders(), t.session_refunds())


@job
def header_line_reconciliation(t):
    return quality.header_line_reconciliation(t.orders(), t.lines())


@job
def refund_consistency(t):
    return quality.refund_consistency(t.session_items(), t.session_refunds())


@job
def landing_rule_agreement(t):
    return journeys.landing_rule_agreement(t.pageviews())


@job
def time_to_refund(t):
    return products.time_to_refund(t.refunds(), t.orders(), "order_id")


@job
def time_to_refund_quantiles(t):
    return products.time_to_refund_quantiles(t.refunds(), t.dated_lines())


@job
def attach_rate(t):
    return products.attach_rate(t.flagged_lines())


@job
def user_cohorts(t):
    return traffic.user_cohorts(t.sessions(), grain="week")


@job
def session_paths(t):
    return journeys.session_paths(t.pageviews())


@job
def first_visit_orders(t):
    return journeys.first_visit_orders(t.pageviews(), EVENT_PAGES)


# --- Sources and sinks: the table is written, read back and reported ---


@job
def sessions_from_csv(t):
    """All sessions through CSV."""
    folder = staging.new_folder(t.spark)
    readers.write_csv(t.sessions(), "website_sessions", folder)
    return readers.read_csv(t.spark, "website_sessions", folder)


@job
def orders_from_flawed_csv(t):
    """Orders from CSV in which some lines have a bad price: good rows and rejected lines by reason."""
    folder = staging.new_folder(t.spark)
    price = F.expr("IF(order_id % 7 = 0, 'n/a', CAST(price_usd AS STRING))")
    columns = [price.alias(c) if c == "price_usd" else F.col(c) if c in ORDER_COLUMNS else F.lit(None).alias(c) for c in SCHEMAS["orders"].names]
    t.orders().select(*[c.cast("string") for c in columns]).write.options(**readers.CSV_OPTIONS).csv(f"{folder}/csv")
    good, rejected, _ = readers.read_csv_checked(t.spark, "orders", f"{folder}/csv", f"{folder}/parsed")
    usd = F.sum("price_usd").cast("decimal(22,2)").alias("revenue")
    kept = good.agg(F.lit("good").alias("kind"), F.count("*").alias("lines"), usd)
    refused = rejected.groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("lines"), F.lit(None).cast("decimal(22,2)").alias("revenue"))
    return kept.unionByName(refused)


@job
def staged_orders_by_month(t):
    """Orders staged by month and bucket, one month replaced by half of its rows, added up from the staged table."""
    folder, orders = staging.new_folder(t.spark), t.orders()
    name = "staged_" + folder.rsplit("/", 1)[1]
    staging.stage_bucketed(orders, name, "order_id", 8, folder)
    staging.rewrite_months(orders.where("order_id % 2 = 0"), name, [REWRITTEN_MONTH])
    return (
        t.spark.table(name)
        .groupBy(staging.MONTH)
        .agg(F.count("*").alias("orders"), F.sum("price_usd").cast("decimal(22,2)").alias("revenue"))
    )


@job
def latest_sessions(t):
    return explore.preview(t.sessions().select("website_session_id", "created_at", "user_id"), 50, F.desc("created_at"), F.desc("website_session_id"))


# --- Data quality on tables with flaws: missing and dangling keys, repeated, misdirected and excessive refunds ---


def _flawed_sessions(t: DriverTables) -> DataFrame:
    """Sessions without every eleventh, some without id, dated by their last page view instead of the first."""
    last = t.pageviews().groupBy("website_session_id").agg(F.max_by("created_at", "website_pageview_id").alias("created_at"))
    kept = last.where("website_session_id % 11 <> 0")
    return kept.withColumn("website_session_id", F.expr("IF(website_session_id % 13 <> 0, website_session_id, NULL)"))


def _flawed_items(t: DriverTables, lines: DataFrame) -> DataFrame:
    return lines.withColumn("order_item_id", F.expr("IF(order_item_id % 101 <> 0, order_item_id, NULL)"))


def _flawed_refunds(t: DriverTables) -> DataFrame:
    refunds = t.refunds()
    changed = refunds.withColumns(
        {
            "order_id": F.expr("order_id + IF(order_item_id % 7 = 0, 1, 0)"),
            "refund_amount_usd": F.expr("CAST(refund_amount_usd * (order_item_id % 3 + 1) * 0.50BD AS DECIMAL(12,2))"),
        }
    )
    again = refunds.where("order_item_id % 5 = 0").withColumn("order_item_refund_id", F.col("order_item_refund_id") + 1)
    return changed.unionByName(again)


def _flawed_products(t: DriverTables) -> DataFrame:
    return t.products().withColumn("product_id", F.expr("IF(product_id % 50 <> 0, product_id, NULL)"))


def _flawed_orders(t: DriverTables) -> DataFrame:
    return t.orders().withColumn("order_id", F.expr("IF(order_id % 97 <> 0, order_id, NULL)"))


@job
def pk_nulls_flawed(t):
    return quality.pk_nulls(
        {
            "products": _flawed_products(t),
            "website_sessions": _flawed_sessions(t),
            "orders": _flawed_orders(t),
            "order_items": _flawed_items(t, t.lines()),
        }
    )


@job
def fk_orphans_flawed(t):
    path_a = {
        "website_sessions": _flawed_sessions(t),
        "website_pageviews": t.pageviews(),
        "orders": t.session_orders(),
    }
    path_b = {
        "products": _flawed_products(t),
        "orders": _flawed_orders(t),
        "order_items": _flawed_items(t, t.lines()),
        "order_item_refunds": _flawed_refunds(t),
    }
    to_session = [relation for relation in RELATIONS if relation.parent == "website_sessions"]
    others = [r for r in RELATIONS if r.parent != "website_sessions" and r.fk != "primary_product_id"]
    return stack_rows([quality.fk_orphans(path_a, to_session), quality.fk_orphans(path_b, others)])


@job
def refunds_per_item_flawed(t):
    return quality.most_per_parent(
        _flawed_refunds(t), "order_item_id", "max_refunds_per_order_item", "order_items_with_multiple_refunds"
    )


@job
def metrics_lookups_flawed(t):
    """What the lookups of metrics by source meet where some sessions are there twice and others are missing."""
    model, checks = _session_model(t), metrics.LookupChecks()
    sessions, key = model["sessions"], "website_session_id"
    model["sessions"] = sessions.where(f"{key} % 7 <> 0").unionByName(sessions.where(f"{key} % 5 = 0"))
    metrics.compute(model, CHANNEL_METRICS, by=["utm_source"], checks=checks).write.format("noop").mode("overwrite").save()
    return checks.found(t.spark)


@job
def refund_consistency_flawed(t):
    return quality.refund_consistency(_flawed_items(t, t.lines()), _flawed_refunds(t))


@job
def orders_before_session_flawed(t):
    return quality.events_before_parent(
        t.session_orders(), _flawed_sessions(t), "website_session_id", "orders_before_session_count"
    )


@job
def pageviews_before_session_flawed(t):
    return quality.events_before_parent(
        t.pageviews(), _flawed_sessions(t), "website_session_id", "pageviews_before_session_count"
    )
