"""Bucketed months, rewriting a month, distinct counts from bitmaps, and rejected CSV rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clickmart.sources import staging
from clickmart.sources.readers import read_csv, read_csv_checked
from clickmart.sources.schemas import SCHEMAS
from tests.conftest import at, rows, usd


@pytest.fixture
def tables(make):
    sessions = [(i, at(f"2012-0{1 + i % 3}-0{1 + i % 9}"), i % 7) for i in range(1, 60)]
    orders = [(i, at(f"2012-0{1 + i % 4}-10"), 1 + i % 50, usd("2.00"), usd("1.00")) for i in range(1, 120)]
    return {
        "website_sessions": make("website_sessions", "website_session_id created_at user_id", *sessions),
        "orders": make("orders", "order_id created_at website_session_id price_usd cogs_usd", *orders),
        "products": make("products", "product_id product_name", (1, "Bear")),
    }


@pytest.fixture
def staged(spark, tables, tmp_path):
    found = staging.stage_tables(tables, 4, "t_", str(tmp_path))
    yield found
    for name in ("website_sessions", "orders"):
        spark.sql(f"DROP TABLE IF EXISTS t_{name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def orders_by_session(tables):
    bought = tables["orders"].groupBy("website_session_id").agg(F.count("*").alias("orders"), F.sum("price_usd").alias("usd"))
    joined = tables["website_sessions"].select("website_session_id", "user_id").join(bought, "website_session_id", "left")
    return joined.select("website_session_id", "user_id", "orders", "usd")


def test_the_session_join_has_no_exchange(tables, staged, plan_settings):
    plan = plan_of(orders_by_session(staged))
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert "Exchange" in plan_of(orders_by_session(tables))
    assert sorted(rows(orders_by_session(staged)), key=repr) == sorted(rows(orders_by_session(tables)), key=repr)


def test_months_are_pruned(staged):
    june = staged["orders"].where(F.col(staging.MONTH) == "2012-02")
    assert "PartitionFilters: [isnotnull(created_month" in plan_of(june)
    assert june.count() == sum(1 + i % 4 == 2 for i in range(1, 120))


def test_a_rewritten_month_leaves_the_others(spark, staged, make):
    def sums():
        found = spark.table("t_orders").groupBy(staging.MONTH).agg(F.count("*").alias("n"), F.sum("price_usd").alias("usd"))
        return {r[0]: (r[1], r[2]) for r in found.collect()}

    before = sums()
    new = make(
        "orders",
        "order_id created_at website_session_id price_usd cogs_usd",
        (1, at("2012-02-10"), 5, usd("7.00"), usd("1.00")),
        (2, at("2012-03-10"), 5, usd("9.00"), usd("1.00")),
    )
    staging.rewrite_months(new, "t_orders", ["2012-02"])
    assert sums() == before | {"2012-02": (1, usd("7.00"))}
    staging.rewrite_months(new, "t_orders")
    assert sums() == before | {"2012-02": (1, usd("7.00")), "2012-03": (1, usd("9.00"))}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"
    staging.rewrite_months(new.where("false"), "t_orders")
    assert sums()["2012-02"] == (1, usd("7.00"))


def test_rewritten_buckets_still_join_without_exchange(spark, staged, tables, plan_settings):
    staging.rewrite_months(tables["orders"], "t_orders", ["2012-02"])
    again = staged | {"orders": spark.table("t_orders")}
    assert "Exchange" not in plan_of(orders_by_session(again))
    assert sorted(rows(orders_by_session(again)), key=repr) == sorted(rows(orders_by_session(tables)), key=repr)


def test_distinct_counts_from_bitmaps(spark, tmp_path):
    rng = random.Random(1)
    views = [
        (rng.choice([None, 0, 1, 32767, 32768, 5_000_000_000, rng.randrange(200_000)]), f"2012-01-{rng.randrange(1, 10):02d}", rng.choice("ab"))
        for _ in range(2000)
    ] + [(7, None, "a")]
    df = spark.createDataFrame(views, "user_id bigint, at string, source string").withColumn("created_at", F.to_timestamp_ntz("at"))
    staging.distinct_bitmaps(df, "user_id", ["source"]).write.parquet(f"{tmp_path}/bitmaps")
    kept = spark.read.parquet(f"{tmp_path}/bitmaps")
    for first, last in ((1, 9), (3, 5), (4, 4), (20, 21)):
        days = F.col("day").between(dt.date(2012, 1, first), dt.date(2012, 1, last))
        raw = df.where(F.to_date("created_at").between(dt.date(2012, 1, first), dt.date(2012, 1, last)))
        found = staging.distinct_ids(kept.where(days), "users")
        assert rows(found) == rows(raw.agg(F.count_distinct("user_id")))
        assert "user_id" not in plan_of(found)
        by_source = staging.distinct_ids(kept.where(days), "users", ["source"])
        assert sorted(rows(by_source)) == sorted(rows(raw.groupBy("source").agg(F.count_distinct("user_id"))))


CSV = """order_id,created_at,website_session_id,user_id,primary_product_id,items_purchased,price_usd,cogs_usd
1,2012-03-19 10:42:46,20,20,1,1,49.99,19.49
2,2012-03-19 19,104,104,1,1,49.99,19.49
3,2012-03-20 02:44:31,NULL,147,1,1,49.99,19.49
4,2012-03-20 02:44:32,1,x,1,1,49.99,19.49
5,2012-03-20 02:44:33,1,1,1
6,2012-03-20 02:44:34,1,1,1,1,12.50,
"""


def test_rejected_rows_are_set_apart(spark, tmp_path):
    path = f"{tmp_path}/orders.csv"
    (tmp_path / "orders.csv").write_text(CSV)
    good, rejected, counts = read_csv_checked(spark, "orders", path, str(tmp_path / "parsed"))
    assert [f.name for f in good.schema] == SCHEMAS["orders"].names
    assert sorted(r["order_id"] for r in good.collect()) == [1, 3, 6]
    told = {r["line"].split(",")[0]: r["reason"] for r in rejected.collect()}
    assert told == {"2": "created_at", "4": "user_id", "5": "columns"}
    assert counts == {"rows": 3, "rejected": 3}
    with pytest.raises(Exception):  # noqa: B017, PT011
        read_csv(spark, "orders", path).collect()


def test_a_clean_file_and_an_empty_one(spark, tmp_path):
    lines = CSV.splitlines()
    for k, kept in enumerate((lines[:2], lines[:1])):
        (tmp_path / f"{k}.csv").write_text("\n".join(kept) + "\n")
        good, rejected, counts = read_csv_checked(spark, "orders", f"{tmp_path}/{k}.csv", str(tmp_path / f"parsed{k}"))
        assert counts == {"rows": len(kept) - 1, "rejected": 0} and rejected.count() == 0
        assert rows(good) == (rows(read_csv(spark, "orders", f"{tmp_path}/{k}.csv")) if len(kept) > 1 else [])


def test_checked_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(CSV)
    good, rejected, _ = read_csv_checked(spark, "orders", f"{tmp_path}/orders.csv", str(tmp_path / "parsed"))
    assert "FileScan csv" not in plan_of(good) + plan_of(rejected)
    assert "FileScan parquet" in plan_of(good)
