import random
from collections import Counter

import pytest

from clickmart.operators import journeys as jobs
from clickmart.operators.journeys import FunnelStep
from tests.conftest import at, by, rows, usd

STEPS = (
    FunnelStep(1, "session_started", "Start", ()),
    FunnelStep(2, "reached_list", "List", ("/list", "/list-2")),
    FunnelStep(3, "reached_cart", "Cart", ("/cart",)),
    FunnelStep(4, "completed_order", "Done", ("/done",)),
)


@pytest.fixture
def views(make):
    return make(
        "website_pageviews",
        "website_pageview_id created_at website_session_id pageview_url",
        (1, at("2012-01-01 10:05"), 1, "/list"),  # lowest id, but later than the next
        (2, at("2012-01-01 10:00"), 1, "/home"),
        (3, at("2012-01-01 10:06"), 1, "/cart"),
        (4, at("2012-01-01 10:07"), 1, "/list-2"),
        (5, at("2012-01-01 11:00"), 2, "/cart"),
        (6, at("2012-01-01 11:00"), 2, "/done"),  # same time as the one before
        (7, at("2012-01-01 12:00"), 3, "/home"),
        (8, at("2012-01-01 12:01"), 3, "/home"),
    )


def test_landing_page_rules(views):
    assert dict(rows(jobs.landing_pages(views, "id"))) == {1: "/list", 2: "/cart", 3: "/home"}
    assert dict(rows(jobs.landing_pages(views, "time"))) == {1: "/home", 2: "/cart", 3: "/home"}
    assert rows(jobs.landing_rule_agreement(views)) == [(3, 1)]
    with pytest.raises(ValueError):
        jobs.landing_pages(views, "luck")


def test_flags_and_long_form(views):
    flags = jobs.funnel_flags(views, STEPS)
    assert sorted(rows(flags)) == [(1, 1, 1, 0), (2, 0, 1, 1), (3, 0, 0, 0)]
    assert sorted(rows(jobs.funnel_long(flags, STEPS))) == [
        (1, 1, "session_started"),
        (1, 2, "reached_list"),
        (1, 3, "reached_cart"),
        (2, 1, "session_started"),
        (2, 3, "reached_cart"),
        (2, 4, "completed_order"),
        (3, 1, "session_started"),
    ]


def test_funnel_with_a_step_larger_than_the_one_before(views):
    assert rows(jobs.funnel_steps(views, STEPS)) == [
        (1, "session_started", 3, usd("100.00"), None, None, None),
        (2, "reached_list", 1, usd("33.33"), usd("33.33"), 2, usd("66.67")),
        (3, "reached_cart", 2, usd("66.67"), usd("200.00"), -1, usd("-100.00")),
        (4, "completed_order", 1, usd("33.33"), usd("50.00"), 1, usd("50.00")),
    ]


def test_funnel_of_nothing_and_after_an_empty_step(make):
    empty = jobs.funnel_steps(make("website_pageviews", "website_pageview_id"), STEPS)
    assert [r[2:] for r in rows(empty)] == [(0, None, None, None, None)] + [(0, None, None, 0, None)] * 3
    one = make("website_pageviews", "website_pageview_id website_session_id pageview_url", (1, 1, "/cart"))
    assert rows(jobs.funnel_steps(one, STEPS))[2][2:] == (1, usd("100.00"), None, -1, None)


def test_shop_funnel_has_seven_steps(spark):
    found = rows(jobs.dim_funnel_step(spark))
    assert [r[0] for r in found] == [1, 2, 3, 4, 5, 6, 7]
    assert found[2][1] == "reached_product_detail" and len(found[2][3]) == 4
    assert found[6][1] == "completed_order"


def test_landing_page_labels_and_base(make):
    views, sessions, orders, n = [], [], [], 0
    for page, visits, bought, price in (
        ("/home", 60, 10, "10.00"),
        ("/lander-1", 30, 20, "10.00"),
        ("/lander-2", 8, 1, "9.00"),
        (None, 12, 0, "0.00"),  # sessions without a pageview
    ):
        for i in range(visits):
            n += 1
            sessions.append((n,))
            if page:
                views.append((n, n, page))
            if i < bought:
                orders.append((n, n, usd(price)))
    found = by(
        jobs.landing_page_performance(
            make("website_pageviews", "website_pageview_id website_session_id pageview_url", *views),
            make("website_sessions", "website_session_id", *sessions),
            make("orders", "order_id website_session_id price_usd", *orders),
            min_sessions=8,
        ),
        "landing_page",
    )
    assert {k: v["landing_page_status"] for k, v in found.items()} == {
        "/home": "high_traffic_underperforming_landing_page",
        "/lander-1": "strong_landing_page",
        "/lander-2": "monitor",
    }
    assert found["/home"]["overall_conversion_rate_pct"] == usd("28.18")  # 31 of 110
    assert found["/home"]["session_share_pct"] == usd("54.55")


def _random_views(make, n_sessions):
    """Visits that repeat pages, in the same minute and second, of pages no list names, and of no session."""
    rng = random.Random(3)
    data = [
        (
            i,
            at(f"2012-01-01 10:{rng.randrange(4):02}:{rng.choice(['00', '30'])}"),
            rng.choice([None, *range(n_sessions)]),
            rng.choice(["/a", "/b", "/c", "/other", None]),
        )
        for i in range(400)
    ]
    columns = "website_pageview_id created_at website_session_id pageview_url"
    return make("website_pageviews", columns, *data), sorted(data, key=lambda r: (r[1], r[0]))


def test_first_visit_orders_against_brute_force(make):
    pages = ["/a", "/b", "/c"]
    views, in_order = _random_views(make, 40)
    walks: dict[int, list[str]] = {}
    for _, _, session, page in in_order:
        walk = walks.setdefault(session, [])
        if page in pages and page not in walk:
            walk.append(page)
    expected = Counter(" > ".join(walk) for walk in walks.values())
    assert dict(rows(jobs.first_visit_orders(views, pages))) == expected


@pytest.mark.parametrize("n_sessions", [2, 40, 300])
def test_session_paths_against_brute_force(make, n_sessions):
    views, in_order = _random_views(make, n_sessions)
    walks: dict[int, tuple] = {}
    for _, _, session, page in in_order:
        if session is not None:
            walks[session] = (*walks.get(session, ()), page)
    taken = Counter(walks.values())
    least = {path: min(s for s, p in walks.items() if p == path) for path in taken}
    expected = {(least[p], k, page, n) for p, n in taken.items() for k, page in enumerate(p, 1)}
    found = rows(jobs.session_paths(views))
    assert set(found) == expected and len(found) == len(expected)
    assert sum(r[3] for r in found) == sum(session is not None for _, _, session, _ in in_order)
