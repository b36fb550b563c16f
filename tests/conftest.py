from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

from clickmart.sources.schemas import SCHEMAS


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("clickmart-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "America/New_York")  # results must not depend on it
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def plan_settings(spark):
    """Joins as they are for large tables: no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def usd(text: str) -> Decimal:
    return Decimal(text)


@pytest.fixture
def make(spark):
    """make("orders", "order_id created_at", (1, at(...)), ...): rows of a table, other columns NULL."""

    def build(table: str, columns: str, *rows: tuple):
        names = columns.split()
        full = [tuple(dict(zip(names, row)).get(c) for c in SCHEMAS[table].names) for row in rows]
        return spark.createDataFrame(full, SCHEMAS[table])

    return build


def rows(df) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def by(df, *keys: str) -> dict:
    """Rows as dicts by key."""
    found = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        found[key[0] if len(keys) == 1 else key] = row.asDict()
    return found
