import datetime as dt

from clickmart.operators import marts
from tests.conftest import at, rows, usd


def test_calendar_covers_every_event(make):
    facts = {
        "sessions": make("website_sessions", "website_session_id created_at", (1, at("2012-02-28 23:59:59"))),
        "refunds": make("order_item_refunds", "order_item_refund_id created_at", (1, at("2012-03-01 00:00:00"))),
        "orders": make("orders", "order_id"),
    }
    assert rows(marts.dim_date(facts)) == [
        (dt.date(2012, 2, 28), 2012, 1, 2, "February", "2012-02"),
        (dt.date(2012, 2, 29), 2012, 1, 2, "February", "2012-02"),
        (dt.date(2012, 3, 1), 2012, 1, 3, "March", "2012-03"),
    ]


def test_fact_session_blanks_flags_and_dates(make):
    sessions = make(
        "website_sessions",
        "website_session_id created_at user_id is_repeat_session utm_source utm_campaign utm_content device_type",
        (1, at("2012-01-01 23:30"), 7, 0, "", None, "ad", "mobile"),
        (2, at("2012-01-02 00:30"), 7, 1, "gsearch", "brand", "", None),
        (3, at("2012-01-02 00:30"), None, None, None, None, None, None),
    )
    assert rows(marts.fact_session(sessions)) == [
        (1, dt.date(2012, 1, 1), 7, False, "New", "direct_or_none", "no_campaign", "ad", "mobile"),
        (2, dt.date(2012, 1, 2), 7, True, "Repeat", "gsearch", "brand", "no_content", None),
        (3, dt.date(2012, 1, 2), None, None, None, "direct_or_none", "no_campaign", "no_content", None),
    ]
    assert len(rows(marts.dim_channel(sessions))) == 3
    assert rows(marts.dim_user(sessions)) == [(7,)]


def test_other_facts_and_dimensions(make):
    day = at("2012-01-01 12:00")
    order = make("orders", "order_id created_at website_session_id user_id price_usd cogs_usd", (1, day, 2, 3, usd("1"), usd("0.5")))
    assert rows(marts.fact_order(order)) == [(1, day.date(), 2, 3, usd("1.00"), usd("0.50"))]
    item = make("order_items", "order_item_id created_at order_id product_id is_primary_item price_usd cogs_usd", (1, day, 2, 3, 0, usd("1"), usd("0.5")))
    assert rows(marts.fact_order_item(item)) == [(1, day.date(), 2, 3, False, usd("1.00"), usd("0.50"))]
    refund = make("order_item_refunds", "order_item_refund_id created_at order_item_id order_id refund_amount_usd", (1, day, 2, 3, usd("1")))
    assert rows(marts.fact_refund(refund)) == [(1, day.date(), 2, 3, usd("1.00"))]
    product = make("products", "product_id created_at product_name", (1, day, "Bear"))
    assert rows(marts.dim_product(product)) == [(1, "Bear", day.date())]
    views = make("website_pageviews", "website_pageview_id created_at website_session_id pageview_url", (1, day, 1, "/a"), (2, day, 2, "/a"))
    assert rows(marts.dim_landing_page(views)) == [("/a",)]


def test_calendar_between_given_dates(spark):
    days = marts.dim_date_between(spark, dt.date(2012, 3, 1), dt.date(2014, 12, 31))
    assert days.count() == 1036
    assert rows(days)[-1] == (dt.date(2014, 12, 31), 2014, 4, 12, "December", "2014-12")
