import datetime as dt
import random
from decimal import Decimal

import pytest

from clickmart.functions.ranking import rank_over_all, ranks_over_all
from clickmart.operators import products as jobs
from tests.conftest import at, by, rows, usd


@pytest.fixture
def shop(make):
    products = make("products", "product_id product_name", (1, "Bear"), (2, "Panda"), (3, "Bear"), (4, None))
    items = make(
        "order_items",
        "order_item_id created_at order_id product_id is_primary_item price_usd cogs_usd",
        (1, at("2012-01-10"), 1, 1, 1, usd("50.00"), usd("20.00")),
        (2, at("2012-01-10"), 1, 2, 0, usd("30.00"), usd("10.00")),
        (3, at("2012-01-11"), 2, 1, 1, usd("50.00"), usd("20.00")),
        (4, at("2012-02-01"), 3, 3, 1, usd("10.00"), usd("9.00")),
        (5, at("2012-02-02"), 4, 9, 1, usd("70.00"), usd("1.00")),  # no such product
        (6, at("2012-02-02"), 4, 4, 0, usd("5.00"), usd("1.00")),  # a product without a name
        (7, at("2012-02-02"), 4, 4, 0, usd("5.00"), usd("1.00")),
    )
    refunds = make(
        "order_item_refunds",
        "order_item_refund_id created_at order_item_id order_id refund_amount_usd",
        (1, at("2012-03-01"), 2, 1, usd("10.00")),
        (2, at("2012-03-02"), 2, 1, usd("5.00")),  # the same line again
        (3, at("2012-01-20"), 1, 1, usd("50.00")),
    )
    return items, products, refunds


def test_product_performance(shop):
    found = by(jobs.product_performance(*shop), "product_id")
    assert list(found) == [1, 2, 3, 4]  # by revenue, the unknown product 9 is left out
    assert found[1] == {
        "product_id": 1,
        "product_name": "Bear",
        "items_sold": 2,
        "gross_revenue": usd("100.00"),
        "total_cogs": usd("40.00"),
        "gross_margin": usd("60.00"),
        "gross_margin_rate_pct": usd("60.00"),
        "refunded_items": 1,
        "refund_amount": usd("50.00"),
        "item_refund_rate_pct": usd("50.00"),
        "net_revenue": usd("50.00"),
    }
    # A line with two refunds is sold once.
    assert (found[2]["items_sold"], found[2]["gross_revenue"], found[2]["refunded_items"]) == (1, usd("30.00"), 2)


def test_summary_by_name_joins_products_of_one_name(shop):
    found = by(jobs.product_refund_summary(*shop), "product_name")
    assert list(found) == ["Panda", "Bear"]  # by refund rate; nameless and unknown products are left out
    assert found["Bear"]["items_sold"] == 3 and found["Bear"]["gross_revenue"] == usd("110.00")
    assert found["Bear"]["item_refund_rate_pct"] == usd("33.33")


def test_refund_risk_labels(make):
    products = make("products", "product_id product_name", *[(i, f"p{i}") for i in range(1, 6)])
    lines, returned, n = [], [], 0
    # product, lines, refunds, price, cost
    for product, sold, refunded, price, cost in (
        (1, 100, 20, "100.00", "90.00"),  # highest net revenue, but risky
        (2, 50, 9, "10.00", "9.00"),  # rate above average, fewer than 10 refunds
        (3, 40, 0, "5.00", "1.00"),  # strong margin
        (4, 10, 0, "5.00", "4.00"),
        (5, 90, 0, "60.00", "50.00"),
    ):
        for i in range(sold):
            n += 1
            lines.append((n, product, usd(price), usd(cost)))
            if i < refunded:
                returned.append((n, n, usd(price)))
    items = make("order_items", "order_item_id product_id price_usd cogs_usd", *lines)
    refunds = make("order_item_refunds", "order_item_refund_id order_item_id refund_amount_usd", *returned)
    found = by(jobs.product_refund_risk(items, products, refunds), "product_id")
    assert {k: v["product_business_status"] for k, v in found.items()} == {
        1: "refund_risk",
        5: "standard_product",
        2: "standard_product",
        3: "strong_margin_product",
        4: "standard_product",
    }
    assert [v["net_revenue_rank"] for v in found.values()] == [1, 2, 3, 4, 5]
    assert {k: v["refund_rate_rank"] for k, v in found.items()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}
    calm = by(jobs.product_refund_risk(items, products, refunds, min_refunds=1000), "product_id")
    assert calm[1]["product_business_status"] == "top_net_revenue_product"


def test_refund_rate_equal_to_the_average_is_no_risk(make):
    products = make("products", "product_id product_name", (1, "a"))
    items = make("order_items", "order_item_id product_id price_usd cogs_usd", *[(i, 1, usd("1"), usd("1")) for i in range(20)])
    refunds = make(
        "order_item_refunds", "order_item_refund_id order_item_id refund_amount_usd", *[(i, i, usd("1")) for i in range(10)]
    )
    (row,) = jobs.product_refund_risk(items, products, refunds).collect()
    assert row.item_refund_rate_pct == row.overall_item_refund_rate_pct == usd("50.00")
    assert row.product_business_status == "top_net_revenue_product"


@pytest.mark.parametrize("kind", ["long", "decimal(22,2)"])
def test_rank_over_all_equals_rank(spark, kind):
    """With ties held by a third of all rows, NULLs, both signs and values of very different size."""
    rng = random.Random(kind)
    values = [0] * 400 + [rng.randrange(-50, 50) for _ in range(300)] + [None] * 5 + [10**9, -(10**9)]
    values += [rng.randrange(-(10**k), 10**k) for k in range(1, 12) for _ in range(40)]
    if kind != "long":
        values = [v if v is None else Decimal(v) / 100 for v in values]
    rng.shuffle(values)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}")
    found = rank_over_all(df, "v", "r").collect()
    order = lambda v: (0, 0) if v is None else (1, -v)
    assert len(found) == len(values)
    for row in found:
        assert row.r == 1 + sum(order(v) < order(row.v) for v in values)


def test_several_ranks_in_one_pass(spark):
    """As the single ranks; equal rows, a row that is NULL in all columns and a hot tie stay as they are."""
    rng = random.Random(3)
    values = [(i % 3, Decimal(0) if rng.random() < 0.4 else Decimal(rng.randrange(-900, 900)) / 100, rng.randrange(5)) for i in range(300)]
    values += [(1, None, None), (1, Decimal("1.00"), None), (None, None, 3), (None, None, None), (None, None, None)] + values[:5]
    df = spark.createDataFrame(values, "k int, a decimal(18,2), b bigint")
    found = ranks_over_all(df, {"a": "a_rank", "b": "b_rank"})
    assert found.columns == ["k", "a", "b", "a_rank", "b_rank"]
    order = lambda v: (0, 0) if v is None else (1, -v)
    wanted = [
        (k, a, b, 1 + sum(order(v[1]) < order(a) for v in values), 1 + sum(order(v[2]) < order(b) for v in values))
        for k, a, b in values
    ]
    assert sorted(rows(found), key=repr) == sorted(wanted, key=repr)
    assert ranks_over_all(df.where("false"), {"a": "a_rank", "b": "b_rank"}).collect() == []


def test_product_refund_risk_starts_no_job(spark, shop, tmp_path):
    spark.sparkContext.setJobGroup("lazy", "")
    jobs.product_refund_risk(*shop)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rank_over_all_of_nothing(spark):
    assert rank_over_all(spark.createDataFrame([], "v long"), "v", "r").collect() == []


def test_items_per_order_by_month(shop):
    assert rows(jobs.items_per_order_by_period(shop[0])) == [
        (dt.date(2012, 1, 1), usd("1.50")),
        (dt.date(2012, 2, 1), usd("2.00")),
    ]


def test_items_per_order_dated_by_the_order(shop, make):
    """Lines without a date of their own; an order that is unknown or undated is left out."""
    items = make("order_items", "order_item_id order_id", (1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4))
    orders = make("orders", "order_id created_at", (1, at("2012-01-31")), (2, at("2012-01-01")), (3, None))
    assert rows(jobs.items_per_order_by_period(items, orders=orders)) == [(dt.date(2012, 1, 1), usd("2.00"))]


def test_sales_mix_and_pivot(shop):
    items, products, _ = shop
    sales = jobs.product_sales_by_period(items, products)
    january, february = dt.date(2012, 1, 1), dt.date(2012, 2, 1)
    assert rows(sales) == [
        (january, "Bear", 2, usd("100.00")),
        (january, "Panda", 1, usd("30.00")),
        (february, "Bear", 1, usd("10.00")),
    ]
    mix = jobs.product_mix(sales)
    assert [r.product_share_pct for r in mix.collect()] == [usd("66.67"), usd("33.33"), usd("100.00")]
    assert rows(jobs.pivot_periods(sales, "month", "product_name", "items_sold", ["Panda", "Bear", "None such"])) == [
        (january, 1, 2, 0, 0),
        (february, 0, 1, 0, 0),
    ]
    assert rows(jobs.pivot_periods(mix, "month", "product_name", "product_share_pct", ["Panda"])) == [
        (january, usd("33.33"), usd("66.67")),  # what is not listed is not lost
        (february, usd("0.00"), usd("100.00")),
    ]
    with pytest.raises(ValueError, match="Panda"):
        jobs.pivot_periods(mix, "month", "product_name", "product_share_pct", ["Panda"], rest="Panda")


def test_time_to_refund(shop, make):
    items, _, refunds = shop
    assert rows(jobs.time_to_refund(refunds, items, "order_item_id")) == [
        (10, 1, usd("50.00")),
        (51, 1, usd("10.00")),
        (52, 1, usd("5.00")),
    ]
    orders = make("orders", "order_id created_at", (1, at("2012-01-21 23:00:00")))
    assert rows(jobs.time_to_refund(refunds, orders, "order_id"))[0] == (-1, 1, usd("50.00"))


def test_time_to_refund_quantiles(make):
    """Least days that half, or nine tenths, of the refunds don't pass; repeated refunds of a line all count."""
    items = make(
        "order_items", "order_item_id product_id created_at", *[(i, 1 + i // 8, at("2012-01-01")) for i in range(16)], (20, 5, None), (21, None, at("2012-01-01"))
    )
    days = [(0, 3), (1, 1), (2, 1), (3, 9), (8, 4), (8, 4), (9, -2), (20, 1), (21, 1), (99, 1)]
    refunds = make(
        "order_item_refunds",
        "order_item_refund_id order_item_id created_at",
        *[(n, line, at("2012-01-01") + dt.timedelta(days=d)) for n, (line, d) in enumerate(days)],
    )
    found = jobs.time_to_refund_quantiles(refunds, items, (0.25, 0.5, 0.9, 1))
    assert found.columns == ["product_id", "refunds", "days_p25", "days_p50", "days_p90", "days_p100"]
    assert rows(found) == [(1, 4, 1, 1, 9, 9), (2, 3, -2, 4, 4, 4)]


def test_attach_rate(shop):
    assert rows(jobs.attach_rate(shop[0])) == [
        (1, 2, 2, 1, 1, usd("50.00")),
        (9, 4, 1, 1, 2, usd("100.00")),  # the add-on twice in one order
    ]


def test_attach_rate_with_several_primary_lines_in_an_order(make):
    items = make(
        "order_items",
        "order_item_id order_id product_id is_primary_item",
        (1, 1, 5, 1),
        (2, 1, 6, 1),
        (3, 1, 7, 0),
    )
    assert rows(jobs.attach_rate(items)) == [(5, 7, 1, 1, 1, usd("100.00"))]
