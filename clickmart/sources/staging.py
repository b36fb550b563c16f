"""Staged tables that spare later jobs a shuffle, a scan or a recount.

``stage_bucketed`` stores a table by month and in buckets of a key, sorted by it: tables staged with the same key and
number of buckets join and add up per key without a shuffle. ``rewrite_months`` replaces some months and leaves the
others. ``distinct_bitmaps`` keeps the ids of a day as bitmaps, so that the distinct ids of any range of days are counted
from the staged rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The key by which each table is joined and added up, for co-located buckets.
BUCKET_KEYS = {
    "website_sessions": "website_session_id",
    "website_pageviews": "website_session_id",
    "orders": "website_session_id",
    "order_items": "order_item_id",
    "order_item_refunds": "order_item_id",
}
MONTH = "created_month"


def new_folder(spark: SparkSession) -> str:
    """A new folder for tables on the way: below ``spark.checkpoint.dir``, or the session's warehouse if that is unset."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    shared = shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{shared.rstrip('/')}/{context.applicationId}/{uuid.uuid4().hex}"


def with_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """The month of ``ts`` as yyyy-MM, for partitions; rows without a time are in the partition of NULL."""
    return df.withColumn(MONTH, F.date_format(F.to_date(ts), "yyyy-MM"))


def stage_bucketed(
    df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, ts: str | None = "created_at"
) -> DataFrame:
    """Store ``df`` as the table ``name``, partitioned by month of ``ts`` and bucketed by ``key``; read it back.

    Each bucket of a month is one file, written by the task that the key is dealt to, however many tasks read ``df``. A
    table of that name is replaced.
    """
    rows = with_month(df, ts) if ts else df
    writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if ts:
        writer = writer.partitionBy(MONTH)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def stage_tables(
    tables: dict[str, DataFrame], buckets: int, prefix: str = "staged_", folder: str | None = None
) -> dict[str, DataFrame]:
    """All tables bucketed by the key of their joins; tables without such a key (products) are left as they are."""
    staged = {}
    for name, df in tables.items():
        if name in BUCKET_KEYS:
            path = f"{folder}/{name}" if folder else None
            staged[name] = stage_bucketed(df, f"{prefix}{name}", BUCKET_KEYS[name], buckets, path)
        else:
            staged[name] = df
    return staged


def rewrite_months(df: DataFrame, name: str, months: Iterable[str] | None = None, ts: str = "created_at") -> None:
    """Replace the months of the staged table ``name`` that ``df`` has rows of, and leave the others as they are.

    ``months`` (yyyy-MM) limits ``df`` to them; a month without rows in ``df`` is left alone, too. The table keeps its
    buckets.
    """
    spark = df.sparkSession
    rows = with_month(df, ts)
    if months is not None:
        rows = rows.where(F.col(MONTH).isin(*months))
    table = spark.table(name)
    rows = rows.select(table.columns)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        _dealt_like(spark, rows, name).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def _dealt_like(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` dealt out by the table's buckets, so that each is written by one task."""
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    if "Num Buckets" not in told:
        return rows
    columns = told["Bucket Columns"].strip("[]").replace("`", "").split(", ")
    return rows.repartition(int(told["Num Buckets"]), *columns)


def distinct_bitmaps(df: DataFrame, id_: str, by: Iterable[str] = (), ts: str = "created_at") -> DataFrame:
    """day, the columns of ``by``, bucket and bitmap: which whole-number ids (not negative) occur, to be staged.

    A bitmap holds the 32,768 ids of a bucket in 4 KB; rows without id, or without time, are left out.
    """
    known = df.where(F.col(id_).isNotNull() & F.col(ts).isNotNull())
    bucket, position = F.bitmap_bucket_number(F.col(id_)), F.bitmap_bit_position(F.col(id_))
    keys = [F.to_date(ts).alias("day"), *[F.col(name) for name in by], bucket.alias("bucket")]
    return known.groupBy(*keys).agg(F.bitmap_construct_agg(position).alias("bitmap"))


def distinct_ids(bitmaps: DataFrame, name: str = "distinct_ids", by: Iterable[str] = ()) -> DataFrame:
    """The exact number of different ids in the chosen rows of ``distinct_bitmaps``, for each group of ``by``.

    Days and groups may overlap in their ids: bitmaps of a bucket are merged first, then counted.
    """
    by = list(by)
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    counted = merged.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
    return counted.withColumn(name, F.coalesce(name, F.lit(0)))
