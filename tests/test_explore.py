from clickmart.operators import explore
from tests.conftest import at, rows


def test_row_counts_and_ranges_with_an_empty_table(make):
    tables = {
        "products": make("products", "product_id created_at", (1, at("2012-01-01")), (2, at("2013-01-01"))),
        "orders": make("orders", "order_id"),
    }
    assert rows(explore.row_counts(tables)) == [("products", 2), ("orders", 0)]
    assert rows(explore.date_ranges(tables)) == [
        ("products", at("2012-01-01"), at("2013-01-01")),
        ("orders", None, None),
    ]


def test_product_catalog_is_sorted(make):
    products = make("products", "product_id product_name", (2, "B"), (1, "A"))
    assert rows(explore.product_catalog(products)) == [(1, None, "A"), (2, None, "B")]


def test_null_groups_with_and_without_label(make):
    sessions = make(
        "website_sessions",
        "website_session_id utm_source device_type",
        (1, None, None),
        (2, "gsearch", "mobile"),
        (3, "gsearch", None),
        (4, None, None),
    )
    assert rows(explore.sessions_by(sessions, "utm_source", "direct_or_none")) == [
        ("direct_or_none", 2),
        ("gsearch", 2),
    ]
    assert rows(explore.sessions_by(sessions, "device_type")) == [(None, 3), ("mobile", 1)]


def test_pageviews_by_url_counts_sessions_once(make):
    views = make(
        "website_pageviews",
        "website_pageview_id website_session_id pageview_url",
        (1, 1, "/home"),
        (2, 1, "/home"),
        (3, 2, "/home"),
        (4, 2, "/cart"),
    )
    assert rows(explore.pageviews_by_url(views)) == [("/home", 3, 2), ("/cart", 1, 1)]
    assert rows(explore.landing_page_sessions(views)) == [("/home", 2)]
