"""Observed lookups: repeated and missing parents show, without a further scan, and totals stay as they are."""

import pytest

from clickmart.plans.metrics import LookupChecks, build_model, compute
from tests.conftest import at, rows, usd

NAMES = ["total_orders", "gross_revenue"]


@pytest.fixture
def tables(make):
    return {
        "website_sessions": make(
            "website_sessions",
            "website_session_id created_at user_id is_repeat_session utm_source",
            (1, at("2012-01-01"), 1, 0, "gsearch"),
            (2, at("2012-01-02"), 2, 0, "bsearch"),
            (3, at("2012-01-03"), 3, 0, "bsearch"),
        ),
        "orders": make(
            "orders",
            "order_id created_at website_session_id price_usd cogs_usd",
            (1, at("2012-01-01"), 1, usd("10.00"), usd("5.00")),
            (2, at("2012-01-01"), 1, usd("20.00"), usd("5.00")),
            (3, at("2012-01-02"), 2, usd("40.00"), usd("5.00")),
            (4, at("2012-01-02"), 99, usd("80.00"), usd("5.00")),
            (5, at("2012-01-02"), None, usd("1.00"), usd("1.00")),
        ),
    }


def found(spark, model, **options):
    checks = LookupChecks()
    result = rows(compute(model, NAMES, checks=checks, **options))
    return result, rows(checks.found(spark)), checks


def test_sound_parents(spark, tables):
    model = build_model(tables)
    result, lookups, checks = found(spark, model, by=["utm_source"])
    assert result == rows(compute(model, NAMES, by=["utm_source"]))
    assert lookups == [("orders", "orders", "sessions", 4, 0, 2)]  # sessions 1, 2, 99 and none
    checks.require_unique()


def test_a_repeated_session(spark, tables, make):
    again = tables["website_sessions"].where("website_session_id = 1 OR website_session_id = 3")
    tables["website_sessions"] = tables["website_sessions"].unionByName(again)
    result, lookups, checks = found(spark, build_model(tables), by=["utm_source"])
    assert dict(r[:2] for r in result)["gsearch"] == 4  # doubled
    assert lookups == [("orders", "orders", "sessions", 4, 1, 2)]  # nothing asks for session 3
    with pytest.raises(ValueError, match=r"sessions \(looked up by orders: 1 rows too many\)"):
        checks.require_unique()


def test_a_repeated_day_of_the_calendar(spark, tables):
    model = build_model(tables)
    model["dates"] = model["dates"].unionByName(model["dates"].where("date = DATE '2012-01-02'"))
    _, lookups, checks = found(spark, model, by=["year_month"], date_role="order")
    assert [r[:5] for r in lookups] == [("orders", "orders", "dates", 2, 1)]
    with pytest.raises(ValueError, match="dates"):
        checks.require_unique()


def test_filters_act_as_without_checks(spark, tables):
    model = build_model(tables)
    result, lookups, _ = found(spark, model, by=["utm_source"], filters={"utm_source": "gsearch"})
    assert result == rows(compute(model, NAMES, by=["utm_source"], filters={"utm_source": "gsearch"}))
    assert lookups == [("orders", "orders", "sessions", 4, 0, 2)]


def test_no_lookup_and_no_rows(spark, tables):
    model = build_model(tables)
    _, lookups, checks = found(spark, model)
    assert lookups == []
    checks.require_unique()
    sessions = tables["website_sessions"].where("website_session_id = 0")
    _, lookups, _ = found(spark, build_model(tables | {"website_sessions": sessions}), by=["utm_source"])
    assert [r[3:] for r in lookups] == [(4, 0, 4)]
    nothing = {name: df.where("created_at > TIMESTAMP_NTZ '2030-01-01 00:00:00'") for name, df in tables.items()}
    result, lookups, _ = found(spark, build_model(nothing), by=["utm_source"])
    assert result == [] and [r[3:] for r in lookups] in ([], [(0, 0, 0)])


def test_checks_add_no_scan_or_shuffle(plan_settings, tables):
    model = build_model(tables)
    plans = [
        compute(model, NAMES, by=["utm_source"], **options)._jdf.queryExecution().executedPlan().toString()
        for options in ({}, {"checks": LookupChecks()})
    ]
    assert "CollectMetrics" in plans[1] and "CollectMetrics" not in plans[0]
    for node in ("Exchange", "Scan", "Join"):
        assert plans[0].count(node) == plans[1].count(node)
