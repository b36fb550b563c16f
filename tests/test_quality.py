from clickmart.operators import quality
from clickmart.sources.schemas import PRIMARY_KEYS, RELATIONS
from tests.conftest import at, rows, usd


def test_null_and_duplicate_keys(make):
    tables = {"orders": make("orders", "order_id", (1,), (1,), (None,)), "products": make("products", "product_id")}
    assert rows(quality.pk_uniqueness(tables)) == [("orders", 3, 1, 2), ("products", 0, 0, 0)]
    assert rows(quality.pk_nulls(tables)) == [("orders.order_id", 1), ("products.product_id", 0)]


def test_null_and_dangling_foreign_keys_are_orphans(make):
    tables = {
        "products": make("products", "product_id", (1,)),
        "website_sessions": make("website_sessions", "website_session_id", (1,)),
        "website_pageviews": make(
            "website_pageviews", "website_pageview_id website_session_id", (1, 1), (2, 9), (3, 9)
        ),
        "orders": make(
            "orders", "order_id website_session_id primary_product_id", (1, 1, 1), (2, None, 7), (3, 8, None)
        ),
        "order_items": make("order_items", "order_item_id order_id product_id", (1, 1, 1), (2, 5, 5)),
        "order_item_refunds": make(
            "order_item_refunds", "order_item_refund_id order_item_id order_id", (1, 1, 1), (2, 1, None)
        ),
    }
    assert dict(rows(quality.fk_orphans(tables))) == {
        "orders_without_matching_session": 2,
        "order_items_without_matching_order": 1,
        "order_items_without_matching_product": 1,
        "order_item_refunds_without_matching_order_item": 0,
        "order_item_refunds_without_matching_order": 1,
        "website_pageviews_without_matching_session": 2,
        "orders_without_matching_primary_product": 2,
    }


def test_children_per_parent(make):
    orders = make("orders", "order_id website_session_id", (1, 1), (2, 1), (3, 2))
    assert rows(quality.most_per_parent(orders, "website_session_id", "most", "several")) == [(2, 1)]
    found = quality.spread_per_parent(orders, "website_session_id", "orders")
    assert found.columns == ["min_orders", "avg_orders", "max_orders"]
    assert rows(found) == [(1, usd("1.50"), 2)]
    empty = make("orders", "order_id")
    assert rows(quality.most_per_parent(empty, "website_session_id", "most", "several")) == [(None, 0)]
    assert rows(quality.spread_per_parent(empty, "website_session_id", "orders")) == [(None, None, None)]


def test_events_before_their_parent(make):
    sessions = make("website_sessions", "website_session_id created_at", (1, at("2012-01-01 10:00:00")))
    orders = make(
        "orders",
        "order_id website_session_id created_at",
        (1, 1, at("2012-01-01 09:59:59")),
        (2, 1, at("2012-01-01 10:00:00")),
        (3, 2, at("2011-01-01 10:00:00")),
    )
    assert rows(quality.events_before_parent(orders, sessions, "website_session_id", "n")) == [(1,)]


def test_header_line_reconciliation(make):
    orders = make(
        "orders",
        "order_id price_usd cogs_usd",
        (1, usd("10.00"), usd("4.00")),
        (2, usd("10.00"), usd("4.00")),
        (3, usd("5.00"), usd("1.00")),
    )
    items = make(
        "order_items",
        "order_item_id order_id price_usd cogs_usd",
        (1, 1, usd("6.00"), usd("3.00")),
        (2, 1, usd("4.00"), usd("1.00")),
        (3, 2, usd("9.99"), usd("4.00")),
    )
    found = quality.header_line_reconciliation(orders, items).orderBy("order_id")
    assert [(r.order_id, r.lines, r.price_difference, r.cogs_difference) for r in found.collect()] == [
        (2, 1, usd("0.01"), usd("0.00")),
        (3, 0, usd("5.00"), usd("1.00")),
    ]


def test_refund_consistency(make):
    items = make(
        "order_items", "order_item_id order_id price_usd", (1, 1, usd("10.00")), (2, 1, usd("5.00"))
    )
    refunds = make(
        "order_item_refunds",
        "order_item_refund_id order_item_id order_id refund_amount_usd",
        (1, 1, 1, usd("10.00")),
        (2, 2, 2, usd("4.00")),
        (3, 2, 1, usd("6.00")),
        (4, 9, 1, usd("6.00")),  # no such line
        (5, None, 1, usd("6.00")),
    )
    assert rows(quality.refund_consistency(items, refunds)) == [(5, 2, 1, 1, 1)]


def test_keys_cover_all_relations():
    assert {r.parent for r in RELATIONS} | {r.child for r in RELATIONS} == set(PRIMARY_KEYS)
