"""Physical plans as they are for large tables: what is scanned, shuffled and joined."""

import re

import pytest

from clickmart_checks import jobs

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return jobs.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(jobs.queries()))
def test_no_cross_joins_and_no_python(plan_settings, name):
    text = plan(plan_settings, name)
    assert not re.search("CartesianProduct|NestedLoopJoin|PythonUDF|ArrowEval|MapInPandas|collect_list", text)


@pytest.mark.parametrize(
    "name", ["source_performance", "campaign_performance", "device_performance", "source_campaign_segments"]
)
def test_conversion_needs_no_expand(plan_settings, name):
    assert "Expand" not in plan(plan_settings, name)


@pytest.mark.parametrize(
    "name", ["funnel_steps", "session_funnel_flags", "first_visit_orders", "landing_rule_agreement", "pageviews_by_url"]
)
def test_pageviews_are_scanned_once(plan_settings, name):
    assert plan(plan_settings, name).count("FileScan") == 1


def test_orphans_are_anti_joins_of_counted_keys(plan_settings):
    text = plan(plan_settings, "fk_orphans")
    assert len(re.findall(r"SortMergeJoin .*LeftAnti", text)) == 7
    assert not re.search(r"SortMergeJoin .*LeftOuter(?=[^\n]*check)", text)


def test_filters_and_columns_reach_the_scan(plan_settings):
    text = plan(plan_settings, "orders_per_session")
    assert "EqualTo(event_type,purchase)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    text = plan(plan_settings, "items_per_order")
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def test_products_meet_totals_not_lines(plan_settings):
    """The product table is joined above the aggregate by product, where a bestseller is one row."""
    text = plan(plan_settings, "product_performance")
    join = text.index("SortMergeJoin [product_id")
    assert "keys=[product_id" in text[join : text.index("SortMergeJoin [order_item_id")]


def test_primary_flags_are_joined_by_line_not_by_order(plan_settings):
    assert "SortMergeJoin [order_item_id" in plan(plan_settings, "fact_order_item")


def test_flags_are_hash_aggregated(plan_settings):
    assert "SortAggregate" not in plan(plan_settings, "funnel_steps")


def test_segment_totals_are_shared_with_the_site_average(spark):
    """The one-row site average reads the same shuffle as the segments instead of the tables again."""
    df = jobs.queries()["source_campaign_segments"](spark, SF)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_windows_never_run_over_fact_rows(plan_settings):
    """An unpartitioned window only follows an aggregate by period, step or value range."""
    for name in ("monthly_growth", "funnel_steps"):
        text = plan(plan_settings, name)
        below = text[text.index("Window") :]
        assert "HashAggregate" in below[: below.index("FileScan")]


def test_no_line_is_sorted_before_it_is_combined(plan_settings):
    for name in ("attach_rate", "product_performance", "fk_orphans"):
        assert "SortAggregate" not in plan(plan_settings, name)


def test_baskets_and_primary_products_meet_before_an_exchange(plan_settings):
    """A join whose rows are shuffled again can be split where an order is large."""
    text = plan(plan_settings, "attach_rate")
    join = text.index("SortMergeJoin [order_id")
    assert "Exchange hashpartitioning(primary_product_id" in text[:join]


def test_items_are_added_up_once_for_their_share(spark):
    df = jobs.queries()["product_mix_pct"](spark, SF)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
