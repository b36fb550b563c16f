import datetime as dt

import pytest

from clickmart.operators import reconcile, traffic
from clickmart.operators.explore import NULL_LABELS
from tests.conftest import at, by, rows, usd


@pytest.fixture
def shop(make):
    """January: 3 sessions, 2 orders. February: orders and no session. March: 1 session, no order, 1 refund."""
    sessions = make(
        "website_sessions",
        "website_session_id created_at user_id is_repeat_session utm_source utm_campaign device_type",
        (1, at("2012-01-05"), 1, 0, None, "brand", "mobile"),
        (2, at("2012-01-06"), 2, 0, "gsearch", None, "desktop"),
        (3, at("2012-01-31 23:59:59"), 1, 1, "gsearch", None, None),
        (4, at("2012-03-01"), 2, 1, "gsearch", "brand", "mobile"),
    )
    orders = make(
        "orders",
        "order_id created_at website_session_id price_usd cogs_usd",
        (1, at("2012-01-06"), 2, usd("50.00"), usd("20.00")),
        (2, at("2012-01-07"), 2, usd("30.01"), usd("10.00")),
        (3, at("2012-02-01"), 3, usd("20.00"), usd("5.00")),
    )
    refunds = make(
        "order_item_refunds",
        "order_item_refund_id created_at order_id refund_amount_usd",
        (1, at("2012-03-02"), 1, usd("25.00")),
        (2, at("2012-02-02"), 1, usd("5.00")),
    )
    return sessions, orders, refunds


def test_core_kpis(shop):
    found = dict(rows(traffic.core_kpis(*shop)))
    assert list(found) == [
        "total_sessions",
        "total_orders",
        "session_to_order_conversion_rate_pct",
        "gross_revenue",
        "total_refund_amount",
        "net_revenue",
        "average_order_value",
        "revenue_per_session",
        "net_revenue_per_session",
        "gross_margin",
        "gross_margin_rate_pct",
        "refund_share_of_revenue_pct",
        "refund_order_rate_pct",
    ]
    assert found["total_sessions"] == 4 and found["total_orders"] == 3
    assert found["session_to_order_conversion_rate_pct"] == usd("75.00")
    assert found["gross_revenue"] == usd("100.01")
    assert found["net_revenue"] == usd("70.01")
    assert found["average_order_value"] == usd("33.34")
    assert found["gross_margin"] == usd("65.01")
    assert found["gross_margin_rate_pct"] == usd("65.00")
    assert found["refund_order_rate_pct"] == usd("33.33")  # two refunds of one order


def test_core_kpis_of_empty_tables(make):
    empty = [make(t, "created_at") for t in ("website_sessions", "orders", "order_item_refunds")]
    found = dict(rows(traffic.core_kpis(*empty)))
    assert found["total_sessions"] == 0 and found["total_refund_amount"] == 0
    assert found["gross_revenue"] is None and found["revenue_per_session"] is None
    check = dict(rows(traffic.core_kpis_check(*empty)))
    assert check["gross_revenue"] == 0 and check["conversion_rate_pct"] is None


def test_both_kpi_computations_agree(shop):
    found = reconcile.kpi_reconciliation(*shop).collect()
    assert len(found) == 10 and all(row.difference == 0 for row in found)


def test_months_come_from_each_tables_own_dates_and_need_sessions(shop):
    found = by(traffic.period_kpis(*shop), "month")
    assert list(found) == [dt.date(2012, 1, 1), dt.date(2012, 3, 1)]  # February has no session
    january, march = found.values()
    assert (january["sessions"], january["orders"], january["gross_revenue"]) == (3, 2, usd("80.01"))
    assert january["refund_amount"] == 0
    assert (march["orders"], march["refund_amount"], march["net_revenue"]) == (0, usd("25.00"), usd("-25.00"))
    assert march["average_order_value"] is None and march["gross_margin_rate_pct"] is None
    assert march["conversion_rate_pct"] == 0


def test_trend_without_refunds_has_the_short_columns(shop):
    sessions, orders, _ = shop
    assert traffic.period_kpis(sessions, orders).columns == [
        "month",
        "sessions",
        "orders",
        "conversion_rate_pct",
        "gross_revenue",
        "average_order_value",
        "revenue_per_session",
    ]


def test_undated_rows(make):
    sessions = make("website_sessions", "website_session_id created_at", (1, None), (2, at("2012-01-01")))
    orders = make("orders", "order_id created_at price_usd", (1, None, usd("5.00")))
    found = by(traffic.period_kpis(sessions, orders), "month")
    assert found[None]["sessions"] == 1 and found[None]["orders"] == 0


def test_growth_skips_missing_months(shop):
    sessions, orders, _ = shop
    first, second = traffic.period_growth(sessions, orders).collect()
    assert first.sessions_mom_change_pct is None
    assert second.sessions_mom_change_pct == usd("-66.67")
    assert second.orders_mom_change_pct == usd("-100.00")
    assert second.revenue_mom_change_pct == usd("-100.00")


def test_sessions_with_several_orders_or_none(shop):
    sessions, orders, _ = shop
    found = by(traffic.segment_performance(sessions, orders, ["utm_source"], NULL_LABELS), "utm_source")
    assert list(found) == ["gsearch", "direct_or_none"]
    assert found["gsearch"] == {
        "utm_source": "gsearch",
        "sessions": 3,
        "orders": 3,
        "conversion_rate_pct": usd("100.00"),
        "gross_revenue": usd("100.01"),
        "average_order_value": usd("33.34"),
        "revenue_per_session": usd("33.34"),
    }
    assert found["direct_or_none"]["orders"] == 0
    assert found["direct_or_none"]["average_order_value"] is None
    assert None in by(traffic.segment_performance(sessions, orders, ["device_type"]), "device_type")


def test_segments_add_up_to_the_site(shop):
    sessions, orders, refunds = shop
    kpis = dict(rows(traffic.core_kpis(sessions, orders, refunds)))
    for dim in ("utm_source", "utm_campaign", "device_type"):
        found = traffic.segment_performance(sessions, orders, [dim]).collect()
        assert sum(r.sessions for r in found) == kpis["total_sessions"]
        assert sum(r.gross_revenue for r in found) == kpis["gross_revenue"]


def _traffic(make, *groups):
    """groups of (source, campaign, device, sessions, orders, price)."""
    sessions, orders, n = [], [], 0
    for source, campaign, device, visits, bought, price in groups:
        for i in range(visits):
            n += 1
            sessions.append((n, source, campaign, device))
            if i < bought:
                orders.append((n, n, usd(price)))
    return (
        make("website_sessions", "website_session_id utm_source utm_campaign device_type", *sessions),
        make("orders", "order_id website_session_id price_usd", *orders),
    )


def test_source_campaign_labels_and_threshold(make):
    sessions, orders = _traffic(
        make,
        ("a", "x", "mobile", 40, 20, "10.00"),  # good on both
        ("b", "x", "mobile", 50, 5, "10.00"),  # large and poor
        ("c", "x", "mobile", 9, 1, "90.00"),  # small, converts poorly, earns well
        ("d", "x", "mobile", 5, 1, "1.00"),  # small and poor
        ("e", None, "mobile", 4, 0, "1.00"),  # below the floor, still part of the average
    )
    found = by(
        traffic.source_campaign_segments(sessions, orders, NULL_LABELS, min_sessions=5), "utm_source"
    )
    assert {k: v["business_segment"] for k, v in found.items()} == {
        "a": "high_quality_traffic",
        "b": "high_volume_lower_efficiency",
        "c": "smaller_but_high_value",
        "d": "average_or_low_priority",
    }
    assert found["a"]["session_share_pct"] == usd("37.04")  # 40 of 108
    everyone = traffic.source_campaign_segments(sessions, orders, NULL_LABELS, min_sessions=0)
    assert by(everyone, "utm_source")["e"]["utm_campaign"] == "no_campaign"


def test_exactly_the_volume_floor_is_kept(make):
    sessions, orders = _traffic(make, ("a", "x", "m", 999, 1, "1.00"), ("b", "x", "m", 1000, 1, "1.00"))
    found = traffic.source_campaign_segments(sessions, orders, NULL_LABELS)
    assert [r.utm_source for r in found.collect()] == ["b"]


def test_conversion_equal_to_the_average_is_good(make):
    sessions, orders = _traffic(make, ("a", "x", "mobile", 10, 5, "2.00"), ("a", "x", "desktop", 10, 5, "2.00"))
    found = traffic.device_opportunity(sessions, orders).collect()
    assert {r.device_opportunity for r in found} == {"strong_device_segment"}
    assert all(r.conversion_rate_gap_pp == 0 and r.revenue_per_session_gap == 0 for r in found)


def test_device_labels(make):
    sessions, orders = _traffic(
        make,
        ("a", "x", "desktop", 60, 30, "10.00"),
        ("a", "x", "mobile", 35, 1, "10.00"),
        ("a", "x", "tablet", 5, 0, "10.00"),
    )
    found = by(traffic.device_opportunity(sessions, orders), "device_type")
    assert {k: v["device_opportunity"] for k, v in found.items()} == {
        "desktop": "strong_device_segment",
        "mobile": "high_volume_underperforming_device",
        "tablet": "monitor",
    }
    assert found["mobile"]["overall_conversion_rate_pct"] == usd("31.00")
    assert found["mobile"]["conversion_rate_gap_pp"] == usd("2.86") - usd("31.00")


def test_user_cohorts(shop):
    assert rows(traffic.user_cohorts(shop[0])) == [
        (dt.date(2012, 1, 1), dt.date(2012, 1, 1), 2),
        (dt.date(2012, 1, 1), dt.date(2012, 3, 1), 1),
    ]
