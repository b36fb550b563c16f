"""The metric registry: 31 named metrics over a star of fact tables, in any grouping and selection.

``compute`` filters each fact, adds it up at its own grain and sets the totals side by side; facts are never joined to
each other at row level, so revenue of order headers and of order lines cannot mix. Ratios are fractions with six
decimals and NULL where the denominator is zero.

Attributes filter and group along the many-to-one relations: sessions reach orders, order lines and refunds; products
reach order lines and refunds; the landing page is an attribute of the session. The primary product of an order is no
such relation.

Two relations work otherwise. The calendar hangs on the date of the chosen role: totals are folded by day first, and one
row per day and group meets the calendar. The funnel has several rows for each session: a session counts in every step it
reached, so groups overlap and don't add up to the whole; a filter on steps chooses the sessions that reached one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmart.functions.ratios import fraction, money, money_or_zero
from clickmart.functions.totals import as_row, merge_totals
from clickmart.operators.journeys import SHOP_FUNNEL, FunnelStep, funnel_flags, funnel_long, session_landing
from clickmart.operators.marts import dim_date, dim_product, fact_order, fact_order_item, fact_refund, fact_session
from clickmart.plans.lookups import LookupChecks, look_up

# Many-to-one relations: table -> {parent: foreign key}. The parent's primary key has the same name.
PARENTS: dict[str, dict[str, str]] = {
    "sessions": {"landings": "website_session_id"},
    "landings": {},
    "products": {},
    "orders": {"sessions": "website_session_id"},
    "items": {"orders": "order_id", "products": "product_id"},
    "refunds": {"orders": "order_id", "items": "order_item_id"},
}

# One-to-many relations that are used backwards: table -> key of the rows that belong to each of its rows.
BRIDGES = {"funnel": "website_session_id"}

# The date column that `date`, and the day of the calendar, stand for in each role.
DATE_ROLES = {
    "session": "session_date",
    "order": "order_date",
    "item": "item_date",
    "refund": "refund_date",
}


@dataclass(frozen=True)
class Base:
    """A sum over one fact, or the number of distinct values of one of its columns."""

    fact: str
    value: Callable[[], Column] | None = None
    distinct: str | None = None
    flag: str | None = None  # boolean attribute the rows must have
    date_role: str | None = None  # fixed date role, whatever the caller chose
    is_money: bool = False


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _rows(fact: str, **kw: Any) -> Base:
    return Base(fact, _one, **kw)


def _usd(fact: str, value: Callable[[], Column], **kw: Any) -> Base:
    return Base(fact, value, is_money=True, **kw)


def _is_new() -> Column:
    return F.when(~F.col("is_repeat_session"), _one())


def _is_repeat() -> Column:
    return F.when(F.col("is_repeat_session"), _one())


def _has_order_id() -> Column:
    return F.when(F.col("order_id").isNotNull(), _one())  # the primary key, so rows are distinct ids


def _price() -> Column:
    return F.col("price_usd")


def _margin() -> Column:
    return F.col("price_usd") - F.col("cogs_usd")


def _refund() -> Column:
    return F.col("refund_amount_usd")


BASE: dict[str, Base] = {
    "total_sessions": _rows("sessions"),
    "new_sessions": Base("sessions", _is_new),
    "repeat_sessions": Base("sessions", _is_repeat),
    "distinct_users": Base("sessions", distinct="user_id"),
    "total_orders": _rows("orders"),
    "distinct_orders": Base("orders", _has_order_id),
    "orders_from_repeat_sessions": Base("orders", _has_order_id, flag="is_repeat_session"),
    "gross_revenue": _usd("orders", _price),
    "gross_revenue_order_date": _usd("orders", _price, date_role="order"),
    "gross_margin": _usd("orders", _margin),
    "refund_amount": _usd("refunds", _refund),
    "refunded_items": _rows("refunds"),
    "refunded_orders": Base("refunds", distinct="order_id"),
    "items_sold": _rows("items"),
    "product_gross_revenue": _usd("items", _price),
    "product_refund_amount": _usd("refunds", _refund),
}

# Derived metrics: (form, first, second).
DERIVED: dict[str, tuple[str, str, str]] = {
    "repeat_session_share": ("ratio", "repeat_sessions", "total_sessions"),
    "conversion_rate": ("ratio", "total_orders", "total_sessions"),
    "session_conversion_rate": ("ratio", "distinct_orders", "total_sessions"),
    "average_order_value": ("ratio", "gross_revenue", "total_orders"),
    "revenue_per_session": ("ratio", "gross_revenue", "total_sessions"),
    "net_revenue": ("difference", "gross_revenue", "refund_amount"),
    "net_revenue_per_session": ("ratio", "net_revenue", "total_sessions"),
    "gross_margin_rate": ("ratio", "gross_margin", "gross_revenue"),
    "refund_share_of_revenue": ("ratio", "refund_amount", "gross_revenue"),
    "refund_order_rate": ("ratio", "refunded_orders", "total_orders"),
    "product_net_revenue": ("difference", "product_gross_revenue", "product_refund_amount"),
    "item_refund_rate": ("ratio", "refunded_items", "items_sold"),
    "product_mix": ("share_of_selection", "items_sold", "items_sold"),
    "channel_conversion_rate": ("ratio", "distinct_orders", "total_sessions"),
    "channel_revenue_per_session": ("ratio", "gross_revenue", "total_sessions"),
    "repeat_session_conversion_rate": ("ratio", "orders_from_repeat_sessions", "repeat_sessions"),
}

# The 31 metrics in order.
METRICS: tuple[str, ...] = (
    "total_sessions",
    "new_sessions",
    "repeat_sessions",
    "repeat_session_share",
    "total_orders",
    "conversion_rate",
    "session_conversion_rate",
    "gross_revenue",
    "gross_revenue_order_date",
    "average_order_value",
    "revenue_per_session",
    "net_revenue",
    "net_revenue_per_session",
    "gross_margin",
    "gross_margin_rate",
    "refund_amount",
    "refunded_items",
    "refunded_orders",
    "refund_share_of_revenue",
    "refund_order_rate",
    "items_sold",
    "product_gross_revenue",
    "product_net_revenue",
    "product_refund_amount",
    "item_refund_rate",
    "product_mix",
    "channel_conversion_rate",
    "channel_revenue_per_session",
    "orders_from_repeat_sessions",
    "repeat_session_conversion_rate",
    "distinct_users",
)


def build_model(tables: Mapping[str, DataFrame], steps: tuple[FunnelStep, ...] = SHOP_FUNNEL) -> dict[str, DataFrame]:
    """The star from base tables; tables that are absent are left out with the metrics that need them.

    Landing pages, the funnel of ``steps`` and the calendar are computed only where they are asked for. The calendar can
    be replaced by any table ``dates`` with one row per ``date``.
    """
    builders = {
        "sessions": ("website_sessions", fact_session),
        "orders": ("orders", fact_order),
        "items": ("order_items", fact_order_item),
        "refunds": ("order_item_refunds", fact_refund),
        "products": ("products", dim_product),
        "landings": ("website_pageviews", session_landing),
        "funnel": ("website_pageviews", lambda views: funnel_long(funnel_flags(views, steps), steps)),
    }
    model = {name: build(tables[table]) for name, (table, build) in builders.items() if table in tables}
    dated = [table for name, (table, _) in builders.items() if table in tables and _dated(model[name])]
    return model | ({"dates": dim_date({table: tables[table] for table in dated})} if dated else {})


def _dated(fact: DataFrame) -> bool:
    return any(column in fact.columns for column in DATE_ROLES.values())


def calendar_columns(model: Mapping[str, DataFrame]) -> list[str]:
    return [column for column in model["dates"].columns if column != "date"] if "dates" in model else []


def bridge_of(model: Mapping[str, DataFrame], name: str) -> str | None:
    """The bridge that has the attribute."""
    return next((b for b, key in BRIDGES.items() if b in model and name != key and name in model[b].columns), None)


def route(model: Mapping[str, DataFrame], table: str, column: str) -> str | None:
    """'' if the column is on the table, the parent to go to if an ancestor has it, None if out of reach."""
    if column in model[table].columns:
        return ""
    for parent in PARENTS[table]:
        if parent in model and route(model, parent, column) is not None:
            return parent
    return None


def _with_ancestors(
    model: Mapping[str, DataFrame], table: str, rows: DataFrame, columns: set[str], join: Callable[..., DataFrame]
) -> DataFrame:
    """Add ancestor attributes to rows that carry the foreign keys they need."""
    for parent, fk in PARENTS[table].items():
        there = {c for c in columns if route(model, table, c) == parent}
        if there:
            rows = join(rows, _lookup(model, parent, fk, there, join), fk, table, parent)
    return rows


def _foreign_keys(model: Mapping[str, DataFrame], table: str, columns: set[str]) -> list[str]:
    routes = {route(model, table, c) for c in columns}
    return [fk for parent, fk in PARENTS[table].items() if parent in routes]


def _lookup(
    model: Mapping[str, DataFrame], table: str, key: str, columns: set[str], join: Callable[..., DataFrame]
) -> DataFrame:
    """Key and attributes of a table, its own and its ancestors'."""
    own = {c for c in columns if route(model, table, c) == ""}
    fks = _foreign_keys(model, table, columns - own)
    keep = dict.fromkeys([key, *sorted(own), *fks])
    rows = _with_ancestors(model, table, model[table].select(*keep), columns - own, join)
    return rows.select(key, *sorted(columns - {key}))


def matches(column: str, wanted: Any) -> Column:
    """None, alone or in a collection, chooses the rows without a value."""
    if callable(wanted):
        return wanted(F.col(column))
    if wanted is None:
        return F.col(column).isNull()
    if isinstance(wanted, (list, tuple, set, frozenset)):
        chosen = F.col(column).isin(*[value for value in wanted if value is not None])
        return chosen | F.col(column).isNull() if None in wanted else chosen
    return F.col(column) == wanted


def _takes_missing(wanted: Any) -> bool:
    return wanted is None or (isinstance(wanted, (list, tuple, set, frozenset)) and None in wanted)


def _folded(rows: DataFrame, keys: Iterable[str], sums: Iterable[str]) -> DataFrame:
    """One row for each combination of the keys."""
    keys = list(dict.fromkeys(keys))
    added = [F.sum(f"_{name}").alias(f"_{name}") for name in sums]
    return rows.groupBy(*keys).agg(*added) if added else rows.select(*keys).distinct()


def _across(rows: DataFrame, bridge: DataFrame, key: str, names: list[str], filters: Mapping[str, Any]) -> DataFrame:
    """``rows`` with the bridge's attributes, once for each of its rows; without ``names`` only chosen by the filters."""
    if names:
        several = rows.join(bridge.select(key, *dict.fromkeys([*names, *filters])), key, "left")
        return reduce(DataFrame.where, [matches(name, wanted) for name, wanted in filters.items()], several)
    chosen = reduce(DataFrame.where, [matches(name, wanted) for name, wanted in filters.items()], bridge)
    reached = rows.join(chosen.select(key), key, "left_semi")
    if all(_takes_missing(wanted) for wanted in filters.values()):
        return reached.unionByName(rows.join(bridge.select(key), key, "left_anti"))
    return reached


def fact_totals(
    model: Mapping[str, DataFrame],
    names: list[str],
    by: tuple[str, ...],
    filters: Mapping[str, Any],
    role: str,
    checks: LookupChecks | None = None,
) -> DataFrame:
    """Totals of base metrics that share a fact and a date role."""
    fact, day = BASE[names[0]].fact, DATE_ROLES[role]
    join = checks.watching(fact) if checks else look_up
    parts = calendar_columns(model)
    bridges = {name: bridge_of(model, name) for name in (*by, *filters)}

    def column_of(name: str) -> str:
        """The column of the facts and their parents by which the attribute is reached."""
        return day if name == "date" or name in parts else BRIDGES[bridges[name]] if bridges.get(name) else name

    missing = [name for name in by if route(model, fact, column_of(name)) is None]
    if missing:
        raise ValueError(f"{names} cannot be grouped by {missing}: {fact} has no relation to them")
    # Filters act along the relations only: one on another table leaves this fact as it is.
    filters = {name: wanted for name, wanted in filters.items() if route(model, fact, column_of(name)) is not None}
    plain = {column_of(name): wanted for name, wanted in filters.items() if name not in parts and not bridges[name]}

    base = {name: BASE[name] for name in names}
    flags = {b.flag for b in base.values() if b.flag}
    distinct = sorted({b.distinct for b in base.values() if b.distinct})
    grouped = {column_of(name) for name in (*by, *filters) if name in by or name in parts or bridges[name]}
    needed = {*grouped, *plain, *flags}
    own = {c for c in needed if route(model, fact, c) == ""}
    fks = _foreign_keys(model, fact, needed - own)

    rows = model[fact]
    for column in sorted(own & set(plain)):
        rows = rows.where(matches(column, plain[column]))
    keys = list(dict.fromkeys([*sorted(own), *fks, *distinct]))
    sums = {name: b.value() for name, b in base.items() if b.value}
    rows = rows.select(*keys, *[value.alias(f"_{name}") for name, value in sums.items()])
    if fks:
        # One row per foreign key before the join: a session with very many orders is one row, not a hot key.
        rows = _with_ancestors(model, fact, _folded(rows, keys, sums), needed - own, join)
        for column in sorted(set(plain) - own):
            rows = rows.where(matches(column, plain[column]))

    kept = [*sorted(grouped), *sorted(flags), *distinct]
    for bridge in sorted({b for b in bridges.values() if b}):
        key = BRIDGES[bridge]
        theirs = [name for name in by if bridges[name] == bridge]
        chosen = {name: wanted for name, wanted in filters.items() if bridges[name] == bridge}
        if theirs or chosen:
            if fact != "sessions":  # which has one row per session
                rows = _folded(rows, kept, sums)
            rows = _across(rows, model[bridge], key, theirs, chosen)
            kept = [*theirs, *kept]
    if asked := [name for name in dict.fromkeys([*by, *filters]) if name in parts]:
        rows = _folded(rows, kept, sums)
        rows = join(rows, model["dates"].select(F.col("date").alias("_day"), *asked), day, fact, "dates", "_day")
        for name in asked:
            if name in filters:
                rows = rows.where(matches(name, filters[name]))

    totals = []
    for name, b in base.items():
        if b.distinct:
            totals.append(F.count_distinct(b.distinct).alias(name))
        else:
            value = F.when(F.col(b.flag), F.col(f"_{name}")) if b.flag else F.col(f"_{name}")
            totals.append(F.sum(value).alias(name))
    dims = {name: day if name == "date" else name for name in by}
    return rows.groupBy(*[F.col(column).alias(name) for name, column in dims.items()]).agg(*totals)


def base_names(metrics: Iterable[str]) -> list[str]:
    names: dict[str, None] = {}
    for metric in metrics:
        if metric in BASE:
            names[metric] = None
        elif metric in DERIVED:
            names |= dict.fromkeys(base_names(DERIVED[metric][1:]))
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return list(names)


def _value(metric: str) -> Column:
    """A metric from the base totals of its row. Counts of nothing are 0, sums of money stay NULL."""
    if metric in BASE:
        column = F.col(metric)
        return money(column) if BASE[metric].is_money else F.coalesce(column, F.lit(0))
    form, first, second = DERIVED[metric]
    if form == "difference":
        return money(_value(first) - money_or_zero(_value(second)))
    if form == "share_of_selection":
        return fraction(_value(first), F.col("_selection"))
    return fraction(_value(first), _value(second))


def _with_selection_total(model: Mapping[str, DataFrame], totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Add the items sold over all selected products, in each group of the remaining attributes, from the totals."""
    products = set(model["products"].columns) if "products" in model else set()
    rest = [name for name in by if name not in products]
    selection = totals.groupBy(*rest).agg(F.sum("items_sold").alias("_selection"))
    if not rest:
        return totals.withColumn("_selection", as_row(selection)["_selection"])
    other = selection.withColumnsRenamed({name: f"_{name}" for name in rest})
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in rest]
    return totals.join(other, same, "left").drop(*[f"_{name}" for name in rest])


def check_filters(model: Mapping[str, DataFrame], filters: Mapping[str, Any], role: str) -> None:
    known = {column for table in model.values() for column in table.columns}
    unknown = [name for name in filters if (DATE_ROLES[role] if name == "date" else name) not in known]
    if unknown:
        raise ValueError(f"no table has the attributes {unknown} to filter by")


def compute(
    model: Mapping[str, DataFrame],
    metrics: Iterable[str] = METRICS,
    by: Iterable[str] = (),
    filters: Mapping[str, Any] | None = None,
    date_role: str = "session",
    checks: LookupChecks | None = None,
) -> DataFrame:
    """Metrics grouped by attributes.

    ``by`` names attributes of the facts and dimensions, or ``date``, which means the date of ``date_role``, or columns
    of the calendar, which is asked for that date. Rows without the date are a group of their own.
    ``filters`` maps an attribute to a value, a collection of values, or a function from its column to a condition;
    they apply before aggregation. None stands for a missing value. A filter acts on the facts that its table reaches
    and leaves the others as they are; a name that no table has is an error. ``checks`` observes the lookups.
    """
    metrics, by, filters = tuple(metrics), tuple(by), dict(filters or {})
    check_filters(model, filters, date_role)
    groups = fact_groups(base_names(metrics), uses_dates(model, by, filters), date_role)
    parts = [fact_totals(model, names, by, filters, role, checks) for (_, role), names in groups.items()]
    return from_totals(model, merge_totals(parts, by), metrics, by)


def uses_dates(model: Mapping[str, DataFrame], by: Iterable[str], filters: Iterable[str]) -> bool:
    return not {"date", *calendar_columns(model)}.isdisjoint({*by, *filters})


def fact_groups(names: Iterable[str], by_date: bool, date_role: str) -> dict[tuple[str, str], list[str]]:
    """Base metrics by their fact and date role; the role of a metric that has its own counts where dates are asked for."""
    groups: dict[tuple[str, str], list[str]] = {}
    for name in names:
        role = (BASE[name].date_role if by_date else None) or date_role
        groups.setdefault((BASE[name].fact, role), []).append(name)
    return groups


def from_totals(
    model: Mapping[str, DataFrame], totals: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...]
) -> DataFrame:
    """The metrics from base totals with one row per group."""
    if "product_mix" in metrics:
        totals = _with_selection_total(model, totals, by)
    result = totals.select(*by, *[_value(metric).alias(metric) for metric in metrics])
    return result.orderBy(*by) if by else result
