"""Data quality: keys, relations, cardinalities, order of events, consistency between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmart.functions.ratios import money, money_or_zero, per
from clickmart.functions.totals import stack_rows
from clickmart.sources.schemas import PRIMARY_KEYS, RELATIONS, Relation


def pk_uniqueness(tables: dict[str, DataFrame], keys: dict[str, str] = PRIMARY_KEYS) -> DataFrame:
    """Rows and distinct keys per table; rows with a NULL key count as duplicates."""
    rows, ids = F.count("*"), F.count_distinct
    return stack_rows(
        [
            df.agg(rows.alias("total_rows"), ids(keys[name]).alias("distinct_ids")).select(
                F.lit(name).alias("table_name"),
                "total_rows",
                "distinct_ids",
                (F.col("total_rows") - F.col("distinct_ids")).alias("duplicate_ids"),
            )
            for name, df in tables.items()
        ]
    )


def pk_nulls(tables: dict[str, DataFrame], keys: dict[str, str] = PRIMARY_KEYS) -> DataFrame:
    return stack_rows(
        [
            df.where(F.col(keys[name]).isNull())
            .agg(F.count("*").alias("null_count"))
            .select(F.lit(f"{name}.{keys[name]}").alias("field_name"), "null_count")
            for name, df in tables.items()
        ]
    )


def fk_orphans(
    tables: dict[str, DataFrame],
    relations: list[Relation] = RELATIONS,
    keys: dict[str, str] = PRIMARY_KEYS,
) -> DataFrame:
    """Rows whose foreign key has no parent; a NULL key counts.

    Children are counted per key first, so the anti join sees each key once however many rows share it.
    """

    def orphans(relation: Relation) -> DataFrame:
        key = F.col(relation.fk).alias("key")
        children = tables[relation.child].groupBy(key).agg(F.count("*").alias("rows"))
        parents = tables[relation.parent].select(F.col(keys[relation.parent]).alias("key"))
        return (
            children.join(parents, "key", "left_anti")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_count"))
            .select(F.lit(relation.check_name).alias("check_name"), "orphan_count")
        )

    return stack_rows([orphans(relation) for relation in relations])


def _rows_per(child: DataFrame, fk: str) -> DataFrame:
    return child.groupBy(fk).agg(F.count("*").alias("rows"))


def most_per_parent(child: DataFrame, fk: str, largest: str, multiple: str) -> DataFrame:
    """Largest number of rows per parent, and how many parents have more than one."""
    return _rows_per(child, fk).agg(
        F.max("rows").alias(largest), F.count_if(F.col("rows") > 1).alias(multiple)
    )


def spread_per_parent(child: DataFrame, fk: str, suffix: str) -> DataFrame:
    """Least, average and largest number of rows per parent."""
    return _rows_per(child, fk).agg(
        F.min("rows").alias(f"min_{suffix}"),
        per(F.sum("rows"), F.count("*")).alias(f"avg_{suffix}"),
        F.max("rows").alias(f"max_{suffix}"),
    )


def events_before_parent(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Rows dated before the parent they point to. One equi-join; the date comparison is part of it.

    A key with very many children is split over tasks by adaptive skew handling, as the join keeps every row.
    """
    born = parent.select(key, F.col("created_at").alias("_parent_time"))
    early = F.col("created_at") < F.col("_parent_time")
    return child.select(key, "created_at").join(born, key).where(early).agg(F.count("*").alias(name))


def header_line_reconciliation(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose price or cost differs from the sum of their lines; an order without lines sums to zero."""
    lines = items.groupBy("order_id").agg(
        F.count("*").alias("lines"),
        F.sum("price_usd").alias("lines_price"),
        F.sum("cogs_usd").alias("lines_cogs"),
    )
    compared = orders.join(lines, "order_id", "left").select(
        "order_id",
        F.coalesce("lines", F.lit(0)).alias("lines"),
        money("price_usd").alias("header_price"),
        money_or_zero("lines_price").alias("lines_price"),
        money("cogs_usd").alias("header_cogs"),
        money_or_zero("lines_cogs").alias("lines_cogs"),
    )
    return compared.select(
        "*",
        money(F.col("header_price") - F.col("lines_price")).alias("price_difference"),
        money(F.col("header_cogs") - F.col("lines_cogs")).alias("cogs_difference"),
    ).where("price_difference <> 0 OR cogs_difference <> 0")


def refund_consistency(items: DataFrame, refunds: DataFrame) -> DataFrame:
    """Refunds against the line they refund: no such line, other order, partial amount, more than the price.

    Refunds of one line to the same order and amount are counted before the join.
    """
    grouped = refunds.groupBy("order_item_id", "order_id", "refund_amount_usd").agg(
        F.count("*").alias("rows")
    )
    lines = items.select("order_item_id", F.col("order_id").alias("line_order_id"), "price_usd", F.lit(True).alias("found"))
    amount, price, found = F.col("refund_amount_usd"), F.col("price_usd"), F.col("found")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    return grouped.join(lines, "order_item_id", "left").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("refunds"),
        rows_where(found.isNull()).alias("refunds_without_line"),
        rows_where(found & ~F.col("order_id").eqNullSafe(F.col("line_order_id"))).alias("order_id_mismatches"),
        rows_where(amount < price).alias("partial_refunds"),
        rows_where(amount > price).alias("refunds_above_price"),
    )
