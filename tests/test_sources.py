import pytest
from pyspark.sql.types import DecimalType, TimestampNTZType

from clickmart.operators.explore import preview
from clickmart.sources.readers import read_csv, read_parquet, read_tables, write_staging
from clickmart.sources.schemas import PRIMARY_KEYS, RELATIONS, SCHEMAS
from tests.conftest import at, rows, usd


def test_keys_and_relations_refer_to_declared_columns():
    assert list(SCHEMAS) == list(PRIMARY_KEYS) and len(RELATIONS) == 7
    for relation in RELATIONS:
        assert relation.fk in SCHEMAS[relation.child].names
        assert relation.parent in PRIMARY_KEYS


def test_csv_empty_and_null_text_become_null(spark, tmp_path):
    path = tmp_path / "website_sessions.csv"
    path.write_text(
        "﻿website_session_id,created_at,user_id,is_repeat_session,utm_source,utm_campaign,utm_content,"
        "device_type,http_referer\n"
        "1,2012-03-19 08:04:16,1,0,gsearch,nonbrand,g_ad_1,mobile,https://www.gsearch.com\n"
        '2,2012-03-19 08:16:49,2,1,NULL,,"",desktop,\n'
    )
    df = read_csv(spark, "website_sessions", str(path))
    assert df.schema == SCHEMAS["website_sessions"]
    assert rows(df) == [
        (1, at("2012-03-19 08:04:16"), 1, 0, "gsearch", "nonbrand", "g_ad_1", "mobile", "https://www.gsearch.com"),
        (2, at("2012-03-19 08:16:49"), 2, 1, None, None, None, "desktop", None),
    ]


def test_csv_bad_number_fails_loudly(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text("product_id,created_at,product_name\nx,2012-03-19 08:00:00,Bear\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|x"):
        read_csv(spark, "products", str(path)).collect()


def test_staging_round_trip_and_column_pruning(spark, make, tmp_path):
    orders = make(
        "orders",
        "order_id created_at price_usd cogs_usd",
        (1, at("2012-03-19 10:42:46"), usd("49.99"), usd("19.49")),
    )
    write_staging(orders, str(tmp_path / "orders.parquet"))
    back = read_parquet(spark, "orders", str(tmp_path / "orders.parquet"))
    assert rows(back) == rows(orders)
    assert isinstance(back.schema["price_usd"].dataType, DecimalType)
    assert isinstance(back.schema["created_at"].dataType, TimestampNTZType)
    plan = back.select("price_usd")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price_usd:decimal(12,2)>" in plan


def test_partitioned_staging_is_pruned(spark, make, tmp_path):
    df = make("products", "product_id product_name", (1, "A"), (2, "B"))
    write_staging(df, str(tmp_path / "p"), partition_by=("product_name",))
    one = spark.read.parquet(str(tmp_path / "p")).where("product_name = 'B'")
    assert [r.product_id for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(product_name" in one._jdf.queryExecution().executedPlan().toString()


def test_read_tables(spark, make, tmp_path):
    for table in SCHEMAS:
        write_staging(make(table, PRIMARY_KEYS[table], (1,)), str(tmp_path / f"{table}.parquet"))
    tables = read_tables(spark, str(tmp_path))
    assert {name: df.count() for name, df in tables.items()} == dict.fromkeys(SCHEMAS, 1)


def test_preview_is_ordered(make):
    df = make("products", "product_id", (3,), (1,), (2,))
    assert [r.product_id for r in preview(df, 2, "product_id").collect()] == [1, 2]
