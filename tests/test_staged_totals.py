"""Metrics from staged totals equal those from the facts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickmart.plans.metrics import METRICS, build_model, compute
from clickmart.plans.staged import compute_staged, covered, refresh_days, stage_totals
from tests.conftest import at, rows, usd
from tests.test_metric_attributes import STEPS, tables  # noqa: F401

NO_PRODUCTS = [name for name in METRICS if name != "product_mix"]
ADD_UP = [name for name in METRICS if name not in ("refunded_orders", "refund_order_rate", "distinct_users", "product_mix")]


@pytest.fixture
def model(spark, tables, tmp_path):  # noqa: F811
    """The facts as files, so that plans tell what is read."""
    kept = {}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")
    return build_model(kept, STEPS)


@pytest.fixture
def staged(model, tmp_path):
    return stage_totals(model, f"{tmp_path}/totals", ["device_type", "landing_page"])


def same(model, staged, metrics, by=(), filters=None, role="session"):
    wanted = rows(compute(model, metrics, by, filters, role))
    assert rows(compute_staged(model, staged, metrics, by, filters, role)) == wanted
    return wanted


def files_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


REQUESTS = [
    ([], {}),
    (["device_type"], {}),
    (["year_month"], {}),
    (["quarter", "device_type"], {"device_type": [None, "mobile"]}),
    (["landing_page", "date"], {}),
    (["landing_page"], {"landing_page": None}),
    (["device_type"], {"date": lambda day: day >= dt.date(2012, 1, 1)}),
    (["device_type"], {"date": None}),
    (["device_type"], {"year": 2011, "month": [12]}),
    ([], {"device_type": "no such"}),
]


@pytest.mark.parametrize("by, filters", REQUESTS)
def test_the_rows_are_those_of_the_facts(model, staged, by, filters):
    assert covered(model, staged, NO_PRODUCTS, by, filters)
    same(model, staged, NO_PRODUCTS, by, filters)


@pytest.mark.parametrize("metrics", [["net_revenue"], ["total_sessions", "refunded_orders"], ["gross_revenue_order_date"]])
def test_groups_are_those_of_the_facts_asked_for(model, staged, metrics):
    same(model, staged, metrics, ["landing_page", "date"])


def test_the_facts_are_not_read(model, staged):
    by, filters = ["device_type"], {"date": lambda day: day.between(dt.date(2012, 1, 1), dt.date(2012, 1, 31))}
    scans = files_of(compute_staged(model, staged, ADD_UP, by, filters))
    assert len(scans) == 1 and "totals" in scans[0] and "PartitionFilters: [isnotnull(date" in scans[0]
    scans = files_of(compute_staged(model, staged, ["total_sessions", "distinct_users"], by))
    assert sorted("totals" in scan for scan in scans) == [False, True]


def test_what_is_not_covered_comes_from_the_facts(model, staged):
    assert covered(model, staged, ["total_sessions"], ["utm_source"]) == []
    same(model, staged, ["total_sessions", "net_revenue"], ["utm_source"])
    assert covered(model, staged, ["total_orders"], ["date"], [], "order") == []
    same(model, staged, ["total_orders"], ["date"], None, "order")
    assert covered(model, staged, ["total_orders"], ["device_type"], [], "order") == ["total_orders"]
    same(model, staged, ["total_orders"], ["device_type"], None, "order")
    same(model, staged, ["total_sessions"], ["funnel_step"])
    same(model, staged, ["total_sessions"], ["device_type"], {"funnel_step": "reached_cart"})
    with pytest.raises(ValueError, match="utm_nothing"):
        compute_staged(model, staged, ["total_sessions"], [], {"utm_nothing": 1})
    with pytest.raises(ValueError, match="unknown metric"):
        compute_staged(model, staged, ["no such"])


def test_overlapping_and_unreachable_attributes_are_refused(model, tmp_path):
    with pytest.raises(ValueError, match="overlap"):
        stage_totals(model, f"{tmp_path}/none", ["funnel_step"])
    with pytest.raises(ValueError, match="no fact"):
        stage_totals(model, f"{tmp_path}/none", ["product_name", "no such"])


def test_products_by_the_date_of_their_line(model, tmp_path):
    items = stage_totals(model, f"{tmp_path}/items", ["product_name"], "item")
    assert items.metrics and "total_sessions" not in items.metrics
    chosen = ["items_sold", "product_mix", "product_gross_revenue"]
    assert same(model, items, chosen, ["product_name"], None, "item")
    assert same(model, items, chosen, ["year_month", "product_name"], None, "item")


def test_only_changed_days_are_staged_again(spark, tables, staged):  # noqa: F811
    def changed(df, ts):
        day = F.to_date(ts)
        return df.where((day != dt.date(2012, 4, 3)) | day.isNull()).withColumn(
            "device_type", F.when((day == dt.date(2012, 1, 1)) | day.isNull(), "tablet").otherwise(F.col("device_type"))
        )

    new = build_model(tables | {"website_sessions": changed(tables["website_sessions"], "created_at")}, STEPS)
    by = ["date", "device_type"]
    before = rows(compute_staged(new, staged, ["total_sessions"], by))
    refresh_days(new, staged, [dt.date(2012, 1, 1), None])
    after = rows(compute_staged(new, staged, ["total_sessions"], by))
    kept = {dt.date(2011, 12, 31), dt.date(2012, 1, 31), dt.date(2012, 4, 3)}
    assert [r for r in after if r[0] in kept] == [r for r in before if r[0] in kept]
    assert (dt.date(2012, 1, 1), "tablet", 1) in after and (None, "tablet", 1) in after
    # The first has no session any more; on the second, the session that is a tablet now had an order.
    refresh_days(new, staged, [dt.date(2012, 4, 3), dt.date(2012, 4, 7)])
    assert same(new, staged, ADD_UP, by) != after
    assert not [r for r in rows(compute_staged(new, staged, ["total_sessions"], by)) if r[0] == dt.date(2012, 4, 3)]


def test_nothing_to_stage(model, tmp_path):
    empty = {name: df.where("false") for name, df in model.items()}
    totals = stage_totals(empty, f"{tmp_path}/empty", ["device_type"])
    same(empty, totals, NO_PRODUCTS)
    same(empty, totals, NO_PRODUCTS, ["device_type"])


def test_sums_of_money_that_are_missing(make, tmp_path):
    order = make("orders", "order_id created_at price_usd", (1, at("2012-01-01"), None), (2, at("2012-01-02"), usd("3.00")))
    model = build_model({"orders": order})
    totals = stage_totals(model, f"{tmp_path}/orders", [], "order")
    assert [r[1] for r in same(model, totals, ["gross_revenue", "total_orders"], ["date"], None, "order")] == [None, usd("3.00")]
