"""Schemas, keys and relations of the six tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "id": LongType(),
    "count": IntegerType(),
    "flag": IntegerType(),
    "time": TimestampNTZType(),
    "text": StringType(),
    "usd": DecimalType(12, 2),
}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Table and column names of the data model.
SCHEMAS: dict[str, StructType] = {
    "products": _table(product_id="id", created_at="time", product_name="text"),
    "website_sessions": _table(
        website_session_id="id",
        created_at="time",
        user_id="id",
        is_repeat_session="flag",
        utm_source="text",
        utm_campaign="text",
        utm_content="text",
        device_type="text",
        http_referer="text",
    ),
    "website_pageviews": _table(
        website_pageview_id="id", created_at="time", website_session_id="id", pageview_url="text"
    ),
    "orders": _table(
        order_id="id",
        created_at="time",
        website_session_id="id",
        user_id="id",
        primary_product_id="id",
        items_purchased="count",
        price_usd="usd",
        cogs_usd="usd",
    ),
    "order_items": _table(
        order_item_id="id",
        created_at="time",
        order_id="id",
        product_id="id",
        is_primary_item="flag",
        price_usd="usd",
        cogs_usd="usd",
    ),
    "order_item_refunds": _table(
        order_item_refund_id="id",
        created_at="time",
        order_item_id="id",
        order_id="id",
        refund_amount_usd="usd",
    ),
}

PRIMARY_KEYS: dict[str, str] = {name: schema.fields[0].name for name, schema in SCHEMAS.items()}


class Relation(NamedTuple):
    """A foreign key: every ``child.fk`` should exist as a primary key of ``parent``."""

    check_name: str
    child: str
    fk: str
    parent: str


# The seven relations and the names of their checks.
RELATIONS: list[Relation] = [
    Relation("orders_without_matching_session", "orders", "website_session_id", "website_sessions"),
    Relation("order_items_without_matching_order", "order_items", "order_id", "orders"),
    Relation("order_items_without_matching_product", "order_items", "product_id", "products"),
    Relation(
        "order_item_refunds_without_matching_order_item",
        "order_item_refunds",
        "order_item_id",
        "order_items",
    ),
    Relation("order_item_refunds_without_matching_order", "order_item_refunds", "order_id", "orders"),
    Relation(
        "website_pageviews_without_matching_session",
        "website_pageviews",
        "website_session_id",
        "website_sessions",
    ),
    Relation("orders_without_matching_primary_product", "orders", "primary_product_id", "products"),
]
