"""Metrics by calendar, landing page and funnel step."""

import datetime as dt
import re

import pytest

from clickmart.operators.journeys import FunnelStep
from clickmart.plans.metrics import build_model, compute
from tests.conftest import at, by, usd

STEPS = (
    FunnelStep(1, "session_started", "Session started", ()),
    FunnelStep(2, "reached_cart", "Cart", ("/cart",)),
    FunnelStep(3, "completed_order", "Order completed", ("/thanks",)),
)
ADDITIVE = ["total_sessions", "total_orders", "gross_revenue", "items_sold", "refund_amount", "refunded_orders"]


@pytest.fixture
def tables(make):
    return {
        "website_sessions": make(
            "website_sessions",
            "website_session_id created_at user_id is_repeat_session device_type",
            (1, at("2011-12-31"), 1, 0, "mobile"),
            (2, at("2012-01-01"), 2, 0, "desktop"),
            (3, at("2012-01-31"), 1, 1, "desktop"),
            (4, at("2012-04-03"), 3, 0, "desktop"),
            (5, None, 4, 0, "mobile"),
        ),
        "orders": make(
            "orders",
            "order_id created_at website_session_id price_usd cogs_usd",
            (1, at("2012-01-05"), 1, usd("80.00"), usd("30.00")),
            (2, at("2012-01-31"), 3, usd("20.00"), usd("10.00")),
            (3, at("2012-02-06"), 3, usd("10.00"), usd("5.00")),
            (4, at("2012-04-06"), 99, usd("1.00"), usd("1.00")),  # its session is missing
            (5, at("2012-04-07"), 5, usd("2.00"), usd("1.00")),
        ),
        "order_items": make(
            "order_items",
            "order_item_id created_at order_id product_id price_usd cogs_usd",
            (1, at("2012-01-05"), 1, 1, usd("50.00"), usd("20.00")),
            (2, at("2012-01-05"), 1, 2, usd("30.00"), usd("10.00")),
            (3, at("2012-01-31"), 2, 2, usd("20.00"), usd("10.00")),
        ),
        "order_item_refunds": make(
            "order_item_refunds",
            "order_item_refund_id created_at order_item_id order_id refund_amount_usd",
            (1, at("2012-02-01"), 1, 1, usd("50.00")),
            (2, at("2012-02-01"), 2, 1, usd("6.00")),
            (3, at("2012-05-02"), 3, 2, usd("20.00")),
        ),
        "products": make("products", "product_id product_name", (1, "Bear"), (2, "Panda")),
        "website_pageviews": make(
            "website_pageviews",
            "website_pageview_id created_at website_session_id pageview_url",
            (1, at("2011-12-31T10:00"), 1, "/home"),
            (2, at("2011-12-31T10:01"), 1, "/cart"),
            (3, at("2011-12-31T10:02"), 1, "/cart"),
            (4, at("2011-12-31T10:03"), 1, "/thanks"),
            (6, at("2012-01-01T10:01"), 2, "/cart"),
            (5, at("2012-01-01T10:05"), 2, "/home"),
            (7, at("2012-01-31T10:00"), 3, "/home"),
            (8, at("2012-01-31T10:02"), 3, "/thanks"),
            (9, at("2012-04-03T10:00"), 4, "/lander"),
            (10, at("2012-04-03T10:00"), None, "/cart"),
        ),
    }


@pytest.fixture
def model(tables):
    return build_model(tables, STEPS)


def test_by_month(model):
    found = by(compute(model, [*ADDITIVE, "distinct_users", "conversion_rate"], by=["year_month"]), "year_month")
    assert set(found) == {"2011-12", "2012-01", "2012-04", None}
    january = found["2012-01"]
    assert january["total_sessions"] == 2 and january["distinct_users"] == 2 and january["total_orders"] == 2
    assert january["gross_revenue"] == usd("30.00") and january["refunded_orders"] == 1 and january["conversion_rate"] == 1
    assert found["2011-12"]["refund_amount"] == usd("56.00")  # refunds follow their session
    assert found[None]["total_sessions"] == 1 and found[None]["gross_revenue"] == usd("3.00")


def test_quarters_and_years_add_up_to_the_whole(model):
    (whole,) = compute(model, ADDITIVE).collect()
    for parts in (["year"], ["year", "quarter"], ["quarter", "month", "month_name"], ["date"]):
        rows = compute(model, ADDITIVE, by=parts).collect()
        for metric in ADDITIVE:
            assert sum(row[metric] or 0 for row in rows) == whole[metric], (parts, metric)


@pytest.mark.parametrize("role, wanted", [("session", {1: 2}), ("order", {1: 2, 2: 1, 4: 2})])
def test_orders_by_month_of_each_role(model, role, wanted):
    found = by(compute(model, ["total_orders"], by=["month"], filters={"year": 2012}, date_role=role), "month")
    assert {month: row["total_orders"] for month, row in found.items()} == wanted


def test_refunds_by_their_own_month(model):
    found = by(compute(model, ["refund_amount", "refunded_orders"], by=["month_name"], date_role="refund"), "month_name")
    assert found["February"]["refund_amount"] == usd("56.00") and found["February"]["refunded_orders"] == 1
    assert found["May"]["refund_amount"] == usd("20.00")


def test_order_date_metric_keeps_its_role(model):
    found = by(compute(model, ["gross_revenue", "gross_revenue_order_date"], by=["year_month"]), "year_month")
    assert found["2012-01"]["gross_revenue_order_date"] == usd("100.00")
    assert found["2012-01"]["gross_revenue"] == usd("30.00")


def test_distinct_users_of_a_quarter_count_once(tables, make):
    extra = make("website_sessions", "website_session_id created_at user_id is_repeat_session", (6, at("2012-02-01"), 1, 1), (7, at("2012-02-01"), 1, 1))
    model = build_model(tables | {"website_sessions": tables["website_sessions"].union(extra)}, STEPS)
    found = by(compute(model, ["distinct_users", "total_sessions"], by=["year", "quarter"]), "year", "quarter")
    assert found[(2012, 1)]["distinct_users"] == 2 and found[(2012, 1)]["total_sessions"] == 4


def test_calendar_filters(model):
    def sessions(**filters):
        return compute(model, ["total_sessions"], filters=filters).collect()[0][0]

    assert sessions(year=2012) == 3 and sessions(quarter=[1, 2]) == 3 and sessions(year=None) == 1
    assert sessions(month=lambda m: m < 4) == 2
    assert sessions(year_month="2012-01", device_type="desktop") == 2
    assert sessions(month=1, date=dt.date(2012, 1, 31)) == 1


def test_a_calendar_of_ones_own(spark, model):
    seasons = [(dt.date(2012, 1, d), "sale" if d < 15 else "after") for d in range(1, 32)]
    model["dates"] = spark.createDataFrame(seasons, "date date, season string")
    found = by(compute(model, ["total_orders"], by=["season"], date_role="order"), "season")
    assert {k: v["total_orders"] for k, v in found.items()} == {"sale": 1, "after": 1, None: 3}
    with pytest.raises(ValueError, match="quarter"):
        compute(model, ["total_orders"], by=["quarter"])


def test_facts_are_folded_by_day_before_the_calendar(model, plan_settings):
    """Below the join with the calendar there is an aggregate by day and group."""
    plan = compute(model, ["total_sessions"], by=["year_month", "device_type"])._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join LeftOuter" in line and "_day" in line)
    below = plan.splitlines()[join + 1 :]
    aggregate = next(line for line in below if "Aggregate [" in line)
    assert re.search(r"Aggregate \[device_type#\d+, session_date#\d+\]", aggregate), aggregate


def test_by_landing_page(model):
    found = by(compute(model, [*ADDITIVE, "distinct_users"], by=["landing_page"]), "landing_page")
    assert set(found) == {"/home", "/cart", "/lander", None}
    assert found["/home"]["total_sessions"] == 2 and found["/home"]["gross_revenue"] == usd("110.00")
    assert found["/home"]["items_sold"] == 3 and found["/home"]["refunded_orders"] == 2 and found["/home"]["distinct_users"] == 1
    assert found["/cart"]["total_sessions"] == 1 and found["/cart"]["total_orders"] == 0  # by time, not by id
    assert found[None]["total_sessions"] == 1 and found[None]["total_orders"] == 2  # no page view, no session
    (whole,) = compute(model, ADDITIVE).collect()
    for metric in ADDITIVE:
        assert sum(row[metric] or 0 for row in found.values()) == whole[metric]


def test_landing_page_filter_reaches_every_fact(model):
    (row,) = compute(model, ADDITIVE, filters={"landing_page": "/home"}).collect()
    assert tuple(row) == (2, 3, usd("110.00"), 3, usd("76.00"), 2)


def test_by_funnel_step(model):
    found = by(compute(model, [*ADDITIVE, "distinct_users"], by=["funnel_step"]), "funnel_step")
    sessions = {step: row["total_sessions"] for step, row in found.items()}
    assert sessions == {"session_started": 4, "reached_cart": 2, "completed_order": 2, None: 1}
    assert found["completed_order"]["gross_revenue"] == usd("110.00") and found["completed_order"]["distinct_users"] == 1
    assert found["reached_cart"]["total_orders"] == 1 and found["reached_cart"]["refund_amount"] == usd("56.00")
    assert found[None]["total_orders"] == 2
    (whole,) = compute(model, ADDITIVE).collect()
    assert sum(sessions.values()) > whole["total_sessions"]  # steps overlap


def test_by_funnel_step_with_other_attributes(model):
    found = by(compute(model, ["total_sessions", "total_orders"], by=["device_type", "funnel_step", "year"]), "device_type", "funnel_step", "year")
    assert found[("desktop", "session_started", 2012)]["total_sessions"] == 3
    assert found[("mobile", "reached_cart", 2011)]["total_orders"] == 1
    assert ("mobile", "completed_order", 2012) not in found


def test_filter_by_reached_step(model):
    """Sessions that reached any of the steps count once, with all their orders."""
    (row,) = compute(model, ADDITIVE, filters={"funnel_step": "reached_cart"}).collect()
    assert tuple(row) == (2, 1, usd("80.00"), 2, usd("56.00"), 1)
    (row,) = compute(model, ADDITIVE, filters={"funnel_step": ["reached_cart", "completed_order"]}).collect()
    assert row["total_sessions"] == 3 and row["total_orders"] == 3 and row["refunded_orders"] == 2
    (row,) = compute(model, ["total_sessions", "total_orders"], filters={"funnel_step": None}).collect()
    assert tuple(row) == (1, 2)
    found = by(compute(model, ["total_sessions"], by=["funnel_step"], filters={"funnel_step_order": lambda k: k > 1}), "funnel_step")
    assert {k: v["total_sessions"] for k, v in found.items()} == {"reached_cart": 2, "completed_order": 2}


def test_nothing_is_read_that_is_not_asked_for(model):
    plan = compute(model, ["total_sessions"], by=["device_type"])._jdf.queryExecution().optimizedPlan().toString()
    assert "pageview" not in plan


def test_without_page_views(tables):
    del tables["website_pageviews"]
    model = build_model(tables, STEPS)
    for name in ("landing_page", "funnel_step"):
        with pytest.raises(ValueError, match=name):
            compute(model, ["total_sessions"], by=[name])
        with pytest.raises(ValueError, match=name):
            compute(model, ["total_sessions"], filters={name: "x"})
