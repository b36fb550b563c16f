"""Session journeys: landing page, funnel steps, paths."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickmart.functions.ratios import pct
from clickmart.operators.traffic import (
    beside_site_average,
    compared_columns,
    converts_well,
    earns_well,
    filter_volume,
    has_volume,
    orders_per_session,
    rated_segments,
    site_totals,
)


class FunnelStep(NamedTuple):
    order: int
    key: str
    label: str
    urls: tuple[str, ...]


# The shop's funnel. The first step has no page of its own; every session with a pageview reaches it.
SHOP_FUNNEL: tuple[FunnelStep, ...] = (
    FunnelStep(1, "session_started", "Session started", ()),
    FunnelStep(2, "reached_products", "Products", ("/products",)),
    FunnelStep(
        3,
        "reached_product_detail",
        "Product detail",
        (
            "/the-original-mr-fuzzy",
            "/the-forever-love-bear",
            "/the-birthday-sugar-panda",
            "/the-hudson-river-mini-bear",
        ),
    ),
    FunnelStep(4, "reached_cart", "Cart", ("/cart",)),
    FunnelStep(5, "reached_shipping", "Shipping", ("/shipping",)),
    FunnelStep(6, "reached_billing", "Billing", ("/billing", "/billing-2")),
    FunnelStep(7, "completed_order", "Order completed", ("/thank-you-for-your-order",)),
)


def _first_page(rule: str) -> Column:
    """URL of the first pageview: the lowest id, or the earliest time and then the lowest id."""
    if rule == "id":
        return F.min_by("pageview_url", "website_pageview_id")
    if rule == "time":
        return F.min_by("pageview_url", F.struct("created_at", "website_pageview_id"))
    raise ValueError(f"rule must be 'id' or 'time', got {rule!r}")


def landing_pages(pageviews: DataFrame, rule: str = "id") -> DataFrame:
    """One row per session with its first page: an aggregate with map-side combine instead of a self-join."""
    return pageviews.groupBy("website_session_id").agg(_first_page(rule).alias("landing_page"))


def session_journeys(
    pageviews: DataFrame, steps: tuple[FunnelStep, ...] = SHOP_FUNNEL, rule: str = "time"
) -> DataFrame:
    """Landing page and one 0/1 flag per funnel page step, from one pass over the pageviews.

    Flags do not exclude each other and ignore order in time. Columns a caller drops cost nothing.
    """
    reached = [
        F.max(F.when(F.col("pageview_url").isin(*step.urls), 1).otherwise(0)).alias(step.key)
        for step in steps
        if step.urls
    ]
    return pageviews.groupBy("website_session_id").agg(_first_page(rule).alias("landing_page"), *reached)


def session_landing(pageviews: DataFrame) -> DataFrame:
    return landing_pages(pageviews, "time")


def funnel_flags(pageviews: DataFrame, steps: tuple[FunnelStep, ...] = SHOP_FUNNEL) -> DataFrame:
    return session_journeys(pageviews, steps).drop("landing_page")


def _reached(step: FunnelStep) -> Column:
    return F.col(step.key) if step.urls else F.lit(1)


def funnel_long(flags: DataFrame, steps: tuple[FunnelStep, ...] = SHOP_FUNNEL) -> DataFrame:
    """One row per session and step it reached."""
    entries = F.array(
        *[
            F.struct(
                F.lit(step.order).alias("funnel_step_order"),
                F.lit(step.key).alias("funnel_step"),
                _reached(step).alias("reached"),
            )
            for step in steps
        ]
    )
    reached = F.filter(entries, lambda entry: entry["reached"] == 1)
    return flags.select("website_session_id", F.explode(reached).alias("step")).select(
        "website_session_id", "step.funnel_step_order", "step.funnel_step"
    )


def funnel_steps(pageviews: DataFrame, steps: tuple[FunnelStep, ...] = SHOP_FUNNEL) -> DataFrame:
    """Sessions per step with conversion and drop-off. One scan; the windows see one row per step."""
    totals = funnel_flags(pageviews, steps).agg(
        *[F.coalesce(F.sum(_reached(step)), F.lit(0)).alias(step.key) for step in steps]
    )
    numbers = F.create_map(*[part for step in steps for part in (F.lit(step.key), F.lit(step.order))])
    per_step = totals.unpivot([], [step.key for step in steps], "funnel_step", "sessions_reached").select(
        numbers[F.col("funnel_step")].alias("funnel_step_order"), "funnel_step", "sessions_reached"
    )
    in_order = Window.orderBy("funnel_step_order")
    reached = F.col("sessions_reached")
    before = F.col("_before")
    return (
        per_step.withColumns(
            {"_all": F.first(reached).over(in_order), "_before": F.lag(reached).over(in_order)}
        )
        .select(
            "funnel_step_order",
            "funnel_step",
            "sessions_reached",
            pct(reached, F.col("_all")).alias("conversion_from_total_pct"),
            pct(reached, before).alias("conversion_from_previous_step_pct"),
            (before - reached).alias("dropoff_from_previous_step"),
            pct(before - reached, before).alias("dropoff_from_previous_step_pct"),
        )
        .orderBy("funnel_step_order")
    )


def dim_funnel_step(spark: SparkSession, steps: tuple[FunnelStep, ...] = SHOP_FUNNEL) -> DataFrame:
    return spark.createDataFrame(
        [(step.order, step.key, step.label, list(step.urls)) for step in steps],
        "funnel_step_order int, funnel_step string, funnel_step_label string, urls array<string>",
    )


def landing_page_performance(
    pageviews: DataFrame,
    sessions: DataFrame,
    orders: DataFrame,
    min_sessions: int = 1000,
    share: float = 0.10,
    rule: str = "id",
) -> DataFrame:
    """Landing pages against the site average. The average counts all sessions, also those without a pageview."""
    totals = (
        landing_pages(pageviews, rule)
        .join(orders_per_session(orders), "website_session_id", "left")
        .groupBy("landing_page")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("orders").alias("orders"),
            F.sum("revenue").alias("revenue"),
        )
    )
    rated = rated_segments(filter_volume(totals, min_sessions), ["landing_page"])
    compared = beside_site_average(rated, site_totals(sessions, orders))
    # Status labels; the first rule that holds decides.
    status = (
        F.when(has_volume(share) & ~converts_well(), "high_traffic_underperforming_landing_page")
        .when(converts_well() & earns_well(), "strong_landing_page")
        .otherwise("monitor")
    )
    return compared.select(compared_columns("landing_page", status, "landing_page_status")).orderBy(
        F.desc("sessions"), "landing_page"
    )


def landing_rule_agreement(pageviews: DataFrame) -> DataFrame:
    """Sessions whose landing page differs between the two rules, from one aggregate."""
    both = pageviews.groupBy("website_session_id").agg(
        _first_page("id").alias("by_id"), _first_page("time").alias("by_time")
    )
    return both.agg(
        F.count("*").alias("sessions"),
        F.count_if(~F.col("by_id").eqNullSafe(F.col("by_time"))).alias("sessions_with_different_landing"),
    )


def numbered_views(pageviews: DataFrame) -> DataFrame:
    """website_session_id, step (from 1, by time, then id) and page of every page view; views of no session are left out.

    Views are numbered within a minute of a session and minutes by the number of views before them, so that a session
    with very many views is not sorted as one.
    """
    views = pageviews.where("website_session_id IS NOT NULL").select(
        "website_session_id",
        "created_at",
        "website_pageview_id",
        F.col("pageview_url").alias("page"),
        F.date_trunc("minute", "created_at").alias("_minute"),
    )
    per_minute = views.groupBy("website_session_id", "_minute").agg(F.count("*").alias("_views"))
    minutes = Window.partitionBy("website_session_id").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    before = per_minute.select(
        F.col("website_session_id").alias("_session"),
        F.col("_minute").alias("_at"),
        F.coalesce(F.sum("_views").over(minutes), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("website_session_id", "_minute").orderBy("created_at", "website_pageview_id")
    same = (F.col("website_session_id") == F.col("_session")) & F.col("_minute").eqNullSafe(F.col("_at"))
    return (
        views.withColumn("_row", F.row_number().over(inside))
        .join(before, same)
        .select("website_session_id", (F.col("_before") + F.col("_row")).alias("step"), "page")
    )


def session_paths(pageviews: DataFrame) -> DataFrame:
    """How many sessions took each path, a path being all page views of a session in order, repeats included.

    One row per path and step: ``path_id`` is the least id of the sessions that took it. A session's path is told by a
    digest of its steps, so no value holds a whole path.
    """
    steps = numbered_views(pageviews)
    digest = F.xxhash64("step", "page", F.col("page").isNull())
    taken = steps.groupBy("website_session_id").agg(
        F.count("*").alias("n_steps"),
        F.bit_xor(digest).alias("by_xor"),
        F.sum(digest.cast("decimal(20,0)")).alias("by_sum"),
    )
    paths = taken.groupBy("n_steps", "by_xor", "by_sum").agg(
        F.min("website_session_id").alias("path_id"), F.count("*").alias("sessions")
    )
    chosen = paths.select("path_id", "sessions")
    return (
        steps.join(chosen, steps["website_session_id"] == chosen["path_id"])
        .select("path_id", "step", "page", "sessions")
        .orderBy(F.desc("sessions"), "path_id", "step")
    )


def first_visit_orders(pageviews: DataFrame, pages: list[str]) -> DataFrame:
    """How often each order of first visits to the given pages occurs, e.g. ``/home > /products > /cart``.

    A page counts at its first visit in the session. The state kept per session is one time and id per page, so a
    session with any number of pageviews stays small and is combined before the shuffle.
    """
    first_visits = pageviews.groupBy("website_session_id").agg(
        *[
            F.min(F.when(F.col("pageview_url") == page, F.struct("created_at", "website_pageview_id"))).alias(
                f"_page{i}"
            )
            for i, page in enumerate(pages)
        ]
    )
    visits = F.array(
        *[
            F.when(
                F.col(f"_page{i}").isNotNull(),
                F.struct(F.col(f"_page{i}").alias("at"), F.lit(page).alias("page")),
            )
            for i, page in enumerate(pages)
        ]
    )
    in_order = F.transform(F.array_sort(F.array_compact(visits)), lambda visit: visit["page"])
    return (
        first_visits.groupBy(F.array_join(in_order, " > ").alias("path"))
        .agg(F.count("*").alias("sessions"))
        .orderBy(F.desc("sessions"), "path")
    )
