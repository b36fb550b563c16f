"""The six tables derived from the driver's parquet tables, for checks and benchmarks.

Path A reads ``events``: a session is one user on one calendar day, a purchase is an order with one line, and every
tenth purchase is refunded. Path B reads ``lineitem``, ``orders`` and ``part``: lines marked R are refunded.
Campaign values are invented.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COGS_A = "CAST(price_usd * CAST((k % 50 + 20) * 0.01BD AS DECIMAL(3,2)) AS DECIMAL(10,2))"

# Columns of the driver's tables that are used, so that no file is opened to find them out.
COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
}

# Product types of `part`, for pivots.
PRODUCT_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


class DriverTables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: int = 1):
        """``spread`` times as many days lie between events, so that their month becomes several."""
        self.spark = spark
        self._dir = sf_dir
        self._spread = spread
        self._opened: dict[str, DataFrame] = {}

    def _read(self, table: str) -> DataFrame:
        if table not in self._opened:
            self._opened[table] = self.spark.read.schema(COLUMNS[table]).parquet(f"{self._dir}/{table}.parquet")
        return self._opened[table]

    # --- Path A ---

    def _events(self) -> DataFrame:
        day = "datediff(CAST(ts AS DATE), DATE '2024-01-01')"
        later = f" + make_dt_interval({day} * {self._spread - 1})" if self._spread > 1 else ""
        return self._read("events").selectExpr(
            "event_id AS website_pageview_id",
            f"ts{later} AS created_at",
            "user_id",
            f"user_id * 100000 + {day} AS website_session_id",
            "event_type",
            "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
            "CAST(value AS DECIMAL(10,2)) AS price_usd",
        )

    def pageviews(self) -> DataFrame:
        return self._events().selectExpr(
            "website_pageview_id", "created_at", "website_session_id", "concat('/', event_type) AS pageview_url"
        )

    def sessions(self) -> DataFrame:
        """One row per user and day; traits come from the session's first event."""
        visits = (
            self._events()
            .groupBy("website_session_id")
            .agg(
                F.min("created_at").alias("created_at"),
                F.min("user_id").alias("user_id"),
                F.min_by("k", "website_pageview_id").alias("k"),
            )
        )
        source = "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'gsearch' WHEN 2 THEN 'bsearch' ELSE 'socialbook' END"
        return visits.selectExpr(
            "website_session_id",
            "created_at",
            "user_id",
            # A user has one row per day here, so the window stays small.
            "CAST(created_at > MIN(created_at) OVER (PARTITION BY user_id) AS INT) AS is_repeat_session",
            f"{source} AS utm_source",
            "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'brand' WHEN 2 THEN 'pilot' ELSE 'nonbrand' END AS utm_campaign",
            "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ad_1' ELSE 'ad_2' END AS utm_content",
            "IF(k % 3 = 0, 'mobile', 'desktop') AS device_type",
            f"concat('https://', {source}, '.example') AS http_referer",
        )

    def _purchases(self) -> DataFrame:
        return self._events().where("event_type = 'purchase'")

    def session_orders(self) -> DataFrame:
        return self._purchases().selectExpr(
            "website_pageview_id AS order_id",
            "created_at",
            "website_session_id",
            "user_id",
            "CAST(k AS BIGINT) AS primary_product_id",
            "1 AS items_purchased",
            "price_usd",
            f"{COGS_A} AS cogs_usd",
        )

    def session_items(self) -> DataFrame:
        return self._purchases().selectExpr(
            "website_pageview_id AS order_item_id",
            "created_at",
            "website_pageview_id AS order_id",
            "CAST(k AS BIGINT) AS product_id",
            "1 AS is_primary_item",
            "price_usd",
            f"{COGS_A} AS cogs_usd",
        )

    def session_refunds(self) -> DataFrame:
        return (
            self._purchases()
            .where("k % 10 = 0")
            .selectExpr(
                "website_pageview_id AS order_item_refund_id",
                "created_at + make_dt_interval(k % 7) AS created_at",
                "website_pageview_id AS order_item_id",
                "website_pageview_id AS order_id",
                "CAST(price_usd * 0.50BD AS DECIMAL(10,2)) AS refund_amount_usd",
            )
        )

    # --- Path B ---

    def products(self) -> DataFrame:
        return self._read("part").selectExpr(
            "p_partkey AS product_id",
            "TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(CAST(p_partkey % 365 AS INT)) AS created_at",
            "p_name AS product_name",
            "p_type AS product_type",
        )

    def orders(self) -> DataFrame:
        price = "CAST(o_totalprice AS DECIMAL(12,2))"
        return self._read("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_orderdate AS created_at",
            "CAST(NULL AS BIGINT) AS website_session_id",
            "o_custkey AS user_id",
            f"{price} AS price_usd",
            f"CAST({price} * 0.60BD AS DECIMAL(12,2)) AS cogs_usd",
        )

    def _lines(self) -> DataFrame:
        """Lines under an id made of their own columns: no numbering, so an order of any size needs no single task.

        The id is 60 bits of a digest of all columns. Equal lines would share it; ``pk_uniqueness`` counts them.
        """
        price = "CAST(l_extendedprice AS DECIMAL(12,2))"
        own = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unix_date(CAST(l_shipdate AS DATE))")
        own += ("CAST(l_quantity AS DECIMAL(12,2))", price, "l_returnflag")
        told = ", ".join(f"COALESCE(CAST({column} AS STRING), '~')" for column in own)
        return self._read("lineitem").selectExpr(
            f"CAST(conv(substring(md5(concat_ws('-', {told})), 1, 15), 16, 10) AS BIGINT) AS order_item_id",
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            f"{price} AS price_usd",
            f"CAST({price} * CAST((l_partkey % 50 + 20) * 0.01BD AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS cogs_usd",
            "l_shipdate AS shipped_at",
            "l_returnflag",
        )

    def lines(self) -> DataFrame:
        """Order lines without the columns that need their order."""
        return self._lines().drop("shipped_at", "l_returnflag")

    def dated_lines(self) -> DataFrame:
        """Order lines with the time of their order."""
        times = self.orders().select("order_id", "created_at")
        return self.lines().join(times, "order_id", "left")

    def primary_lines(self) -> DataFrame:
        """The line with the least id of every order, and its product."""
        return self.lines().groupBy("order_id").agg(
            F.min("order_item_id").alias("primary_item_id"),
            F.min_by("product_id", "order_item_id").alias("primary_product_id"),
        )

    def _flag_primary(self, lines: DataFrame) -> DataFrame:
        """Lines with is_primary_item. The join is by line id, so the lines of a large order stay spread out."""
        flags = self.primary_lines().select(
            F.col("primary_item_id").alias("order_item_id"), F.lit(1).alias("is_primary_item")
        )
        return lines.join(flags, "order_item_id", "left").withColumn(
            "is_primary_item", F.coalesce("is_primary_item", F.lit(0))
        )

    def flagged_lines(self) -> DataFrame:
        """Order lines with the primary flag, without the time."""
        return self._flag_primary(self.lines())

    def items(self) -> DataFrame:
        """Order lines with all columns of the schema."""
        return self._flag_primary(self.dated_lines())

    def orders_with_primary(self) -> DataFrame:
        return self.orders().join(self.primary_lines().drop("primary_item_id"), "order_id", "left")

    def refunds(self) -> DataFrame:
        return (
            self._lines()
            .where("l_returnflag = 'R'")
            .select(
                F.col("order_item_id").alias("order_item_refund_id"),
                F.col("shipped_at").alias("created_at"),
                "order_item_id",
                "order_id",
                F.col("price_usd").alias("refund_amount_usd"),
            )
        )
