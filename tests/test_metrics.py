import datetime as dt

import pytest

from clickmart.operators import traffic
from clickmart.plans.metrics import BASE, DERIVED, METRICS, build_model, compute
from tests.conftest import at, by, rows, usd


@pytest.fixture
def tables(make):
    return {
        "website_sessions": make(
            "website_sessions",
            "website_session_id created_at user_id is_repeat_session utm_source device_type",
            (1, at("2012-01-01"), 1, 0, "g", "mobile"),
            (2, at("2012-01-01"), 2, 0, None, "desktop"),
            (3, at("2012-01-02"), 1, 1, "g", "desktop"),
            (4, at("2012-01-03"), 3, 0, "b", None),
        ),
        "orders": make(
            "orders",
            "order_id created_at website_session_id price_usd cogs_usd",
            (1, at("2012-01-05"), 1, usd("80.00"), usd("30.00")),
            (2, at("2012-01-05"), 3, usd("20.00"), usd("10.00")),
            (3, at("2012-01-06"), 3, usd("10.00"), usd("5.00")),
            (4, at("2012-01-06"), 99, usd("1.00"), usd("1.00")),  # its session is missing
        ),
        "order_items": make(
            "order_items",
            "order_item_id created_at order_id product_id is_primary_item price_usd cogs_usd",
            (1, at("2012-01-05"), 1, 1, 1, usd("50.00"), usd("20.00")),
            (2, at("2012-01-05"), 1, 2, 0, usd("30.00"), usd("10.00")),
            (3, at("2012-01-05"), 2, 2, 1, usd("20.00"), usd("10.00")),
            (4, at("2012-01-06"), 3, 7, 1, usd("10.00"), usd("5.00")),  # its product is missing
        ),
        "order_item_refunds": make(
            "order_item_refunds",
            "order_item_refund_id created_at order_item_id order_id refund_amount_usd",
            (1, at("2012-02-01"), 1, 1, usd("50.00")),
            (2, at("2012-02-01"), 2, 1, usd("6.00")),
            (3, at("2012-02-02"), 3, 2, usd("20.00")),
        ),
        "products": make("products", "product_id product_name", (1, "Bear"), (2, "Panda")),
    }


def test_registry_is_complete():
    assert len(METRICS) == 31 and len(set(METRICS)) == 31
    assert all(metric in BASE or metric in DERIVED for metric in METRICS)


def test_overall(tables):
    (row,) = compute(build_model(tables)).collect()
    assert list(row.asDict()) == list(METRICS)
    assert row.total_sessions == 4 and row.new_sessions == 3 and row.repeat_sessions == 1
    assert row.repeat_session_share == usd("0.25")
    assert row.total_orders == 4 and row.conversion_rate == 1
    assert row.gross_revenue == usd("111.00") and row.gross_revenue_order_date == usd("111.00")
    assert row.net_revenue == usd("35.00") and row.net_revenue_per_session == usd("8.75")
    assert row.refunded_items == 3 and row.refunded_orders == 2 and row.refund_order_rate == usd("0.5")
    assert row.items_sold == 4 and row.item_refund_rate == usd("0.75") and row.product_mix == 1
    assert row.orders_from_repeat_sessions == 2 and row.repeat_session_conversion_rate == 2
    assert row.distinct_users == 3


def test_overall_agrees_with_the_kpi_table(tables):
    kpis = dict(
        rows(traffic.core_kpis(tables["website_sessions"], tables["orders"], tables["order_item_refunds"]))
    )
    (row,) = compute(build_model(tables)).collect()
    for name in ("total_sessions", "total_orders", "gross_revenue", "net_revenue", "gross_margin"):
        assert kpis[name] == row[name]
    assert kpis["refund_order_rate_pct"] == row.refund_order_rate * 100


def test_by_session_attribute_reaches_every_fact(tables):
    found = by(
        compute(
            build_model(tables),
            ["total_sessions", "total_orders", "gross_revenue", "items_sold", "refund_amount", "refunded_orders"],
            by=["device_type"],
        ),
        "device_type",
    )
    assert found["mobile"] == {
        "device_type": "mobile",
        "total_sessions": 1,
        "total_orders": 1,
        "gross_revenue": usd("80.00"),
        "items_sold": 2,
        "refund_amount": usd("56.00"),
        "refunded_orders": 1,
    }
    assert found["desktop"]["total_orders"] == 2 and found["desktop"]["refund_amount"] == usd("20.00")
    # The session without a device and the order without a session are one group, as NULL is one group.
    assert found[None]["total_sessions"] == 1 and found[None]["gross_revenue"] == usd("1.00")
    assert sum(row["total_orders"] for row in found.values()) == 4


def test_by_product(tables):
    found = by(
        compute(
            build_model(tables),
            ["items_sold", "product_mix", "product_net_revenue", "item_refund_rate"],
            by=["product_name"],
        ),
        "product_name",
    )
    assert found["Panda"]["product_mix"] == usd("0.5") and found["Panda"]["product_net_revenue"] == usd("24.00")
    assert found["Bear"]["product_net_revenue"] == 0 and found["Bear"]["item_refund_rate"] == 1
    assert found[None]["items_sold"] == 1 and found[None]["product_net_revenue"] == usd("10.00")


def test_product_mix_is_a_share_of_the_selection(tables):
    model = build_model(tables)
    per_day = by(compute(model, ["product_mix"], by=["item_date", "product_name"]), "item_date", "product_name")
    assert per_day[(dt.date(2012, 1, 5), "Panda")]["product_mix"] == usd("0.666667")
    assert per_day[(dt.date(2012, 1, 6), None)]["product_mix"] == 1
    named = {"product_name": ["Bear", "Panda"]}
    selected = by(compute(model, ["product_mix"], by=["product_name"], filters=named), "product_name")
    assert selected["Bear"]["product_mix"] == usd("0.333333") and None not in selected


def test_date_roles(tables):
    model = build_model(tables)
    mixed = by(compute(model, ["total_sessions", "gross_revenue", "gross_revenue_order_date"], by=["date"]), "date")
    assert mixed[dt.date(2012, 1, 1)]["gross_revenue"] == usd("80.00")
    assert mixed[dt.date(2012, 1, 1)]["gross_revenue_order_date"] is None
    assert mixed[dt.date(2012, 1, 5)]["gross_revenue_order_date"] == usd("100.00")
    assert mixed[None]["gross_revenue"] == usd("1.00")
    by_order = by(compute(model, ["gross_revenue", "refund_amount"], by=["date"], date_role="order"), "date")
    assert by_order[dt.date(2012, 1, 5)]["refund_amount"] == usd("76.00")
    by_refund = by(compute(model, ["refund_amount"], by=["date"], date_role="refund"), "date")
    assert by_refund[dt.date(2012, 2, 2)]["refund_amount"] == usd("20.00")


def test_filters_act_before_aggregation(tables):
    model = build_model(tables)
    chosen = ["total_sessions", "total_orders", "refund_amount", "distinct_users"]
    (row,) = compute(model, chosen, filters={"utm_source": "g", "device_type": ["mobile", "desktop"]}).collect()
    assert tuple(row) == (2, 3, usd("76.00"), 1)
    (row,) = compute(model, chosen, filters={"date": lambda d: d <= dt.date(2012, 1, 1)}).collect()
    assert tuple(row) == (2, 1, usd("56.00"), 2)


def test_product_filter_leaves_sessions_alone(tables):
    (row,) = compute(
        build_model(tables), ["total_sessions", "items_sold"], filters={"product_name": "Bear"}
    ).collect()
    assert tuple(row) == (4, 1)


def test_groups_out_of_reach_and_unknown_names_are_errors(tables):
    model = build_model(tables)
    with pytest.raises(ValueError, match="product_name"):
        compute(model, ["total_sessions"], by=["product_name"])
    with pytest.raises(ValueError, match="date"):
        compute(model, ["total_sessions"], by=["date"], date_role="order")
    with pytest.raises(ValueError, match="profit"):
        compute(model, ["profit"])


def test_empty_tables(make):
    names = ("website_sessions", "orders", "order_items", "order_item_refunds", "products")
    (row,) = compute(build_model({name: make(name, "created_at") for name in names})).collect()
    assert row.total_sessions == 0 and row.conversion_rate is None and row.gross_revenue is None


def test_each_metric_alone(tables):
    """Ungrouped, grouped by an attribute of sessions, and filtered: as in the table of all metrics."""
    model = build_model(tables)
    (whole,) = compute(model).collect()
    grouped = by(compute(model, by=["utm_source"]), "utm_source")
    (filtered,) = compute(model, filters={"device_type": "mobile"}).collect()
    for metric in METRICS:
        assert compute(model, [metric]).collect()[0][metric] == whole[metric]
        for source, row in by(compute(model, [metric], by=["utm_source"]), "utm_source").items():
            assert row[metric] == grouped[source][metric]
        assert compute(model, [metric], filters={"device_type": "mobile"}).collect()[0][metric] == filtered[metric]


def test_refunded_orders_alone(tables):
    model = build_model(tables)
    found = by(compute(model, ["refunded_orders"], by=["utm_source"]), "utm_source")
    assert found["g"]["refunded_orders"] == 2
    assert compute(model, ["refunded_orders"], filters={"device_type": "mobile"}).collect()[0][0] == 1


def test_missing_values_can_be_chosen(tables):
    model = build_model(tables)

    def sessions(wanted):
        return compute(model, ["total_sessions"], filters={"device_type": wanted}).collect()[0][0]

    assert sessions(None) == 1 and sessions([None]) == 1
    assert sessions([None, "mobile"]) == 2 and sessions({"mobile"}) == 1 and sessions([]) == 0


def test_names_that_no_table_has_are_errors(tables):
    model = build_model(tables)
    with pytest.raises(ValueError, match="devise_type"):
        compute(model, ["total_sessions"], filters={"devise_type": "mobile"})
    compute(model, ["total_sessions"], filters={"product_name": "Bear", "date": dt.date(2012, 1, 1)}).collect()
