"""Path B: products, revenue and refunds from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickmart.functions.periods import period
from clickmart.functions.ranking import ranks_over_all
from clickmart.functions.ratios import count_or_zero, money, money_or_zero, pct, per, share_of
from clickmart.functions.totals import as_row


def refunds_per_item(refunds: DataFrame) -> DataFrame:
    """Refund rows and amount per line, so that a line with several refunds is still sold once."""
    return refunds.groupBy("order_item_id").agg(
        F.count("*").alias("refund_rows"), F.sum("refund_amount_usd").alias("refund_amount")
    )


def product_totals(items: DataFrame, refunds: DataFrame) -> DataFrame:
    """Sales and refunds per product id. Both sides of the join have one row per line, so no key is hot."""
    return (
        items.select("order_item_id", "product_id", "price_usd", "cogs_usd")
        .join(refunds_per_item(refunds), "order_item_id", "left")
        .groupBy("product_id")
        .agg(
            F.count("order_item_id").alias("items_sold"),
            F.sum("price_usd").alias("revenue"),
            F.sum("cogs_usd").alias("cogs"),
            F.sum("refund_rows").alias("refund_rows"),
            F.sum("refund_amount").alias("refund_amount"),
        )
    )


def _ratings(*names: str) -> list[Column]:
    """The named columns of a product report, from product totals."""
    gross, cogs = F.col("revenue"), F.col("cogs")
    refunded, amount, sold = count_or_zero("refund_rows"), money_or_zero("refund_amount"), F.col("items_sold")
    ratings = {
        "items_sold": sold,
        "gross_revenue": money(gross),
        "total_cogs": money(cogs),
        "gross_margin": money(gross - cogs),
        "gross_margin_rate_pct": pct(gross - cogs, money(gross)),
        "refunded_items": refunded,
        "refund_amount": amount,
        "item_refund_rate_pct": pct(refunded, sold),
        "net_revenue": money(money(gross) - amount),
    }
    return [ratings[name].alias(name) for name in names]


def product_performance(items: DataFrame, products: DataFrame, refunds: DataFrame) -> DataFrame:
    """Sales, margin and refunds per product. Products are joined after the aggregate, one row each."""
    named = product_totals(items, refunds).join(products.select("product_id", "product_name"), "product_id")
    return named.select(
        "product_id",
        "product_name",
        *_ratings(
            "items_sold",
            "gross_revenue",
            "total_cogs",
            "gross_margin",
            "gross_margin_rate_pct",
            "refunded_items",
            "refund_amount",
            "item_refund_rate_pct",
            "net_revenue",
        ),
    ).orderBy(F.desc_nulls_first("gross_revenue"), "product_id")


def product_refund_risk(
    items: DataFrame,
    products: DataFrame,
    refunds: DataFrame,
    min_refunds: int = 10,
    min_margin_pct: float = 60,
) -> DataFrame:
    """Products with their ranks by net revenue and refund rate and a status.

    The site's refund rate, which also counts lines of unknown products, and the highest net revenue are one aggregate
    of the totals per product; both ranks are found in one pass over them.
    """
    known = products.select("product_id", "product_name", F.lit(True).alias("is_known"))
    totals = product_totals(items, refunds).join(known, "product_id", "left")
    net = F.when(F.col("is_known"), *_ratings("net_revenue"))
    site = as_row(
        totals.agg(
            pct(F.sum(count_or_zero("refund_rows")), F.sum("items_sold")).alias("refund_rate"),
            F.max(net).alias("best_net_revenue"),
        )
    )
    rated = totals.where("is_known").select(
        "product_id",
        "product_name",
        *_ratings(
            "items_sold",
            "gross_revenue",
            "gross_margin",
            "gross_margin_rate_pct",
            "refunded_items",
            "refund_amount",
            "item_refund_rate_pct",
            "net_revenue",
        ),
    )
    ranked = ranks_over_all(rated, {"net_revenue": "net_revenue_rank", "item_refund_rate_pct": "refund_rate_rank"})
    ranked = ranked.withColumn("overall_item_refund_rate_pct", site["refund_rate"])
    # Status labels; the first rule that holds decides.
    status = (
        F.when(
            (F.col("item_refund_rate_pct") > F.col("overall_item_refund_rate_pct"))
            & (F.col("refunded_items") >= min_refunds),
            "refund_risk",
        )
        .when(F.col("net_revenue") == site["best_net_revenue"], "top_net_revenue_product")
        .when(F.col("gross_margin_rate_pct") >= min_margin_pct, "strong_margin_product")
        .otherwise("standard_product")
    )
    return ranked.withColumn("product_business_status", status).orderBy(
        F.desc_nulls_first("net_revenue"), "product_id"
    )


def product_refund_summary(
    items: DataFrame, products: DataFrame, refunds: DataFrame, label: str = "product_name"
) -> DataFrame:
    """Sales and refunds per product label; products that share a name are one group, nameless lines are left out."""
    named = products.where(F.col(label).isNotNull()).select("product_id", label)
    sums = ("items_sold", "revenue", "cogs", "refund_rows", "refund_amount")
    return (
        product_totals(items, refunds)
        .join(named, "product_id")
        .groupBy(label)
        .agg(*[F.sum(name).alias(name) for name in sums])
        .select(
            label,
            *_ratings(
                "items_sold",
                "refunded_items",
                "gross_revenue",
                "refund_amount",
                "item_refund_rate_pct",
                "net_revenue",
            ),
        )
        .orderBy(F.desc("item_refund_rate_pct"), label)
    )


def items_per_order_by_period(items: DataFrame, grain: str = "month", orders: DataFrame | None = None) -> DataFrame:
    """Average lines per order; an order with lines in two periods counts in both.

    Lines have a date of their own, or that of their order if ``orders`` are given. Then they are counted per order
    first, so the join sees each order once, however many lines it has.
    """
    if orders is None:
        lines = items.where("created_at IS NOT NULL AND order_id IS NOT NULL")
        baskets = lines.groupBy(period("created_at", grain), "order_id").agg(F.count("order_item_id").alias("lines"))
    else:
        counted = items.groupBy("order_id").agg(F.count("order_item_id").alias("lines"))
        dated = orders.where("created_at IS NOT NULL").select("order_id", period("created_at", grain))
        baskets = counted.join(dated, "order_id")
    return (
        baskets.groupBy(grain)
        .agg(per(F.sum("lines"), F.count("*")).alias("avg_items_per_order"))
        .orderBy(grain)
    )


def product_sales_by_period(
    items: DataFrame, products: DataFrame, grain: str = "month", label: str = "product_name"
) -> DataFrame:
    """Lines and revenue per period and product label.

    Lines are added up per product before they meet the products, so a bestseller is a few rows in the join.
    """
    per_product = (
        items.where("created_at IS NOT NULL")
        .groupBy(period("created_at", grain), "product_id")
        .agg(F.count("order_item_id").alias("items_sold"), F.sum("price_usd").alias("revenue"))
    )
    named = products.where(F.col(label).isNotNull()).select("product_id", label)
    return (
        per_product.join(named, "product_id")
        .groupBy(grain, label)
        .agg(F.sum("items_sold").alias("items_sold"), money(F.sum("revenue")).alias("gross_revenue"))
        .orderBy(grain, label)
    )


def product_mix(sales: DataFrame, grain: str = "month", label: str = "product_name") -> DataFrame:
    """Share of each label in the period's lines. Totals per period are joined back, one row per period."""
    sold = sales.select(grain, label, "items_sold")
    per_period = sold.groupBy(grain).agg(F.sum("items_sold").alias("total_items"))
    return (
        sold.join(per_period, grain)
        .select(
            grain,
            label,
            "items_sold",
            "total_items",
            pct(F.col("items_sold"), F.col("total_items")).alias("product_share_pct"),
        )
        .orderBy(grain, label)
    )


def pivot_periods(
    df: DataFrame, grain: str, label: str, value: str, labels: list[str], rest: str = "other"
) -> DataFrame:
    """Periods down, the given labels across, 0 where a label has no row; all other labels add up in ``rest``."""
    if rest in labels:
        raise ValueError(f"{rest!r} is one of the labels; choose another name for the rest")
    column = F.when(F.col(label).isin(*labels), F.col(label)).otherwise(rest)
    wide = df.withColumn(label, column).groupBy(grain).pivot(label, [*labels, rest]).agg(F.sum(value))
    kind = df.schema[value].dataType
    return wide.select(
        grain, *[F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast(kind).alias(name) for name in [*labels, rest]]
    ).orderBy(grain)


def time_to_refund(refunds: DataFrame, started: DataFrame, key: str) -> DataFrame:
    """Refunds and amount by days from the order (or the line) to the refund.

    ``started`` is the orders or the lines and ``key`` their id. Refunds of one day and parent are added up first.
    """
    per_day = refunds.groupBy(key, F.to_date("created_at").alias("refund_date")).agg(
        F.count("*").alias("refunds"), F.sum("refund_amount_usd").alias("refund_amount")
    )
    start = started.select(key, F.to_date("created_at").alias("start_date"))
    days = F.date_diff("refund_date", "start_date").alias("days_to_refund")
    return (
        per_day.join(start, key)
        .groupBy(days)
        .agg(F.sum("refunds").alias("refunds"), money(F.sum("refund_amount")).alias("refund_amount"))
        .orderBy("days_to_refund")
    )


def time_to_refund_quantiles(
    refunds: DataFrame, items: DataFrame, shares: tuple[float, ...] = (0.5, 0.9), label: str = "product_id"
) -> DataFrame:
    """Days from the line to its refund, at the given shares of each product's refunds: exact discrete quantiles.

    The quantile at share p is the least number of days that p of the refunds do not pass. Refunds are folded to a
    histogram by product and day first, so the running sums see days, not refunds. Refunds of unknown lines and of lines
    without a date or product are left out.
    """
    per_line = refunds.groupBy("order_item_id", F.to_date("created_at").alias("refund_date")).agg(F.count("*").alias("refunds"))
    lines = items.where(F.col(label).isNotNull()).select("order_item_id", label, F.to_date("created_at").alias("item_date"))
    days = F.date_diff("refund_date", "item_date").alias("days")
    histogram = per_line.join(lines, "order_item_id").groupBy(label, days).agg(F.sum("refunds").alias("refunds"))
    histogram = histogram.where("days IS NOT NULL")
    to_day = Window.partitionBy(label).orderBy("days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumns(
        {"up_to": F.sum("refunds").over(to_day), "of_all": F.sum("refunds").over(Window.partitionBy(label))}
    )
    reached = [
        F.min(F.when(F.col("up_to") >= F.ceil(share_of(F.col("of_all"), share)), F.col("days"))).alias(f"days_p{share * 100:g}")
        for share in shares
    ]
    return summed.groupBy(label).agg(F.sum("refunds").alias("refunds"), *reached).orderBy(label)


def attach_rate(items: DataFrame) -> DataFrame:
    """How often orders with a primary product also hold an add-on product.

    Baskets are folded to one row per order and product before they meet their primary product (that of the first
    primary line, should there be several). So an order brings at most one row per product of the catalog, however many
    lines it has, and the pairs are one per add-on, never all pairs of an order. The primary product is one row per
    order, so adaptive execution can split the baskets of a large one.
    """
    is_primary = F.col("is_primary_item") == 1
    product = F.col("product_id")
    baskets = items.groupBy("order_id", product.alias("add_on_product_id")).agg(
        F.count_if(~is_primary).alias("add_on_items")
    )
    first = items.where(is_primary & F.col("order_id").isNotNull()).groupBy("order_id")
    first = first.agg(F.min_by(product, "order_item_id").alias("primary_product_id")).where("primary_product_id IS NOT NULL")
    attached = (
        baskets.where("add_on_items > 0")
        .join(first, "order_id")
        .groupBy("primary_product_id", "add_on_product_id")
        .agg(F.count("*").alias("attached_orders"), F.sum("add_on_items").alias("add_on_items"))
    )
    primary = first.groupBy("primary_product_id").agg(F.count("*").alias("primary_orders"))
    return (
        attached.join(primary, "primary_product_id")
        .select(
            "primary_product_id",
            "add_on_product_id",
            "primary_orders",
            "attached_orders",
            "add_on_items",
            pct(F.col("attached_orders"), F.col("primary_orders")).alias("attach_rate_pct"),
        )
        .orderBy(F.desc("attached_orders"), "primary_product_id", "add_on_product_id")
    )
