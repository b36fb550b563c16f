"""The same answers in SQL for DuckDB, written from the definitions and not from the Spark plans.

Conversion uses plain distinct counts over sessions and orders, ranks use RANK, shares use windows. Ratios are rounded
half away from zero in whole numbers (cents), which is exact in any engine.
"""

from __future__ import annotations

from clickmart_checks.jobs import (
    EVENT_FUNNEL,
    EVENT_PAGES,
    FIRST_WEEKS,
    MIN_CAMPAIGN_SESSIONS,
    MIN_LANDING_SESSIONS,
    MONTHS_SPREAD,
    PRODUCT_TYPES,
    REWRITTEN_MONTH,
    STAGED_METRICS,
)

# --- Rounded division ---


def _half_up(a: str, b: str) -> str:
    """a / b for whole numbers, b > 0, rounded half away from zero; NULL if b is 0."""
    a, b = f"CAST({a} AS HUGEINT)", f"NULLIF(CAST({b} AS HUGEINT), 0)"
    return f"CAST(sign({a}) * ((2 * abs({a}) + {b}) // (2 * {b})) AS DECIMAL(20,0))"


def _cents(amount: str) -> str:
    return f"CAST(({amount}) * 100 AS HUGEINT)"


def pct(n: str, d: str) -> str:
    return f"CAST({_half_up(f'({n}) * 10000', d)} * 0.01 AS DECIMAL(18,2))"


def pct_usd(n: str, d: str) -> str:
    return pct(_cents(n), _cents(d))


def per(amount: str, d: str) -> str:
    return f"CAST({_half_up(_cents(amount), d)} * 0.01 AS DECIMAL(18,2))"


def avg(n: str, d: str) -> str:
    return per(n, d)


def fraction(n: str, d: str) -> str:
    return f"CAST({_half_up(f'({n}) * 1000000', d)} * 0.000001 AS DECIMAL(18,6))"


def fraction_usd(n: str, d: str, per_count: bool = False) -> str:
    if per_count:
        return f"CAST({_half_up(f'{_cents(n)} * 10000', d)} * 0.000001 AS DECIMAL(18,6))"
    return fraction(_cents(n), _cents(d))


def usd(amount: str) -> str:
    return f"CAST({amount} AS DECIMAL(22,2))"


def usd0(amount: str) -> str:
    return f"CAST(COALESCE({amount}, 0) AS DECIMAL(22,2))"


def big(count: str) -> str:
    return f"CAST({count} AS BIGINT)"


# --- The six tables from the driver's tables ---

BINDINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "pv": (
        (),
        """
        SELECT event_id AS website_pageview_id, ts AS created_at, user_id,
               user_id * 100000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS website_session_id,
               concat('/', event_type) AS pageview_url, event_type,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k, CAST(value AS DECIMAL(10,2)) AS v
        FROM events""",
    ),
    "first_pv": (
        ("pv",),
        "SELECT website_session_id, min(website_pageview_id) AS first_id FROM pv GROUP BY 1",
    ),
    "ws": (
        ("pv", "first_pv"),
        """
        SELECT s.website_session_id, s.created_at, s.user_id,
               CASE WHEN ROW_NUMBER() OVER (PARTITION BY s.user_id ORDER BY s.created_at) > 1 THEN 1 ELSE 0 END
                 AS is_repeat_session,
               CASE f.k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'gsearch' WHEN 2 THEN 'bsearch' ELSE 'socialbook' END
                 AS utm_source,
               CASE f.k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'brand' WHEN 2 THEN 'pilot' ELSE 'nonbrand' END
                 AS utm_campaign,
               CASE f.k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ad_1' ELSE 'ad_2' END AS utm_content,
               CASE WHEN f.k % 3 = 0 THEN 'mobile' ELSE 'desktop' END AS device_type
        FROM (SELECT website_session_id, min(created_at) AS created_at, min(user_id) AS user_id
              FROM pv GROUP BY 1) s
        JOIN first_pv p ON p.website_session_id = s.website_session_id
        JOIN pv f ON f.website_pageview_id = p.first_id""",
    ),
    "wo": (
        ("pv",),
        """
        SELECT website_pageview_id AS order_id, created_at, website_session_id, user_id, k, v AS price_usd,
               CAST(v * (k % 50 + 20) * 0.01 AS DECIMAL(10,2)) AS cogs_usd
        FROM pv WHERE event_type = 'purchase'""",
    ),
    "wr": (
        ("wo",),
        """
        SELECT order_id AS order_item_refund_id, order_id AS order_item_id, order_id,
               created_at + (k % 7) * INTERVAL '1' DAY AS created_at,
               CAST(price_usd * 0.50 AS DECIMAL(10,2)) AS refund_amount_usd
        FROM wo WHERE k % 10 = 0""",
    ),
    "pr": (
        (),
        """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_type,
               TIMESTAMP '1995-01-01 00:00:00' + CAST(p_partkey % 365 AS INT) * INTERVAL '1' DAY AS created_at
        FROM part""",
    ),
    "od": (
        (),
        """
        SELECT o_orderkey AS order_id, o_orderdate AS created_at, o_custkey AS user_id,
               CAST(o_totalprice AS DECIMAL(12,2)) AS price_usd,
               CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.60 AS DECIMAL(12,2)) AS cogs_usd
        FROM orders""",
    ),
    "ln": (
        (),
        """
        SELECT CAST('0x' || substr(md5(concat_ws('-', COALESCE(CAST(l_orderkey AS VARCHAR), '~'),
                 COALESCE(CAST(l_linenumber AS VARCHAR), '~'), COALESCE(CAST(l_partkey AS VARCHAR), '~'),
                 COALESCE(CAST(l_suppkey AS VARCHAR), '~'),
                 COALESCE(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR), '~'),
                 COALESCE(CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), '~'),
                 COALESCE(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '~'),
                 COALESCE(l_returnflag, '~'))), 1, 15) AS BIGINT) AS order_item_id,
               l_orderkey AS order_id, l_partkey AS product_id, l_shipdate, l_returnflag,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price_usd,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (l_partkey % 50 + 20) * 0.01 AS DECIMAL(12,2))
                 AS cogs_usd
        FROM lineitem""",
    ),
    "it": (
        ("ln", "od"),
        """
        SELECT ln.*, od.created_at,
               CASE WHEN ROW_NUMBER() OVER (PARTITION BY ln.order_id ORDER BY ln.order_item_id) = 1
                    THEN 1 ELSE 0 END AS is_primary_item
        FROM ln LEFT JOIN od ON od.order_id = ln.order_id""",
    ),
    "rf": (
        ("ln",),
        """
        SELECT order_item_id AS order_item_refund_id, l_shipdate AS created_at, order_item_id, order_id,
               price_usd AS refund_amount_usd
        FROM ln WHERE l_returnflag = 'R'""",
    ),
}


def _with(tables: str, more: dict[str, str] | None = None) -> str:
    """WITH clause for the named tables and what they need, followed by CTEs of the query itself."""
    needed: dict[str, None] = {}

    def need(name: str) -> None:
        for other in BINDINGS[name][0]:
            need(other)
        needed[name] = None

    for name in tables.split():
        need(name)
    ctes = [f"{name} AS ({BINDINGS[name][1]})" for name in needed]
    ctes += [f"{name} AS ({sql})" for name, sql in (more or {}).items()]
    return "WITH " + ",\n".join(ctes) + "\n"


# Name in results -> (table, primary key).
SIX = {
    "products": ("pr", "product_id"),
    "website_sessions": ("ws", "website_session_id"),
    "website_pageviews": ("pv", "website_pageview_id"),
    "orders": ("od", "order_id"),
    "order_items": ("it", "order_item_id"),
    "order_item_refunds": ("rf", "order_item_refund_id"),
}


def _per_table(select: str) -> str:
    rows = [
        "SELECT " + select.format(name=name, table=table, key=key) + f" FROM {table}"
        for name, (table, key) in SIX.items()
    ]
    return _with("pr ws pv od it rf") + " UNION ALL ".join(rows)


def _sessions_by(dim: str, label: str | None = None) -> str:
    value = f"COALESCE({dim}, '{label}')" if label else dim
    return _with("ws") + f"SELECT {value} AS {dim}, count(*) AS sessions FROM ws GROUP BY 1"


def _orphans() -> str:
    relations = [
        ("orders_without_matching_session", "wo", "website_session_id", "ws", "website_session_id"),
        ("order_items_without_matching_order", "it", "order_id", "od", "order_id"),
        ("order_items_without_matching_product", "it", "product_id", "pr", "product_id"),
        ("order_item_refunds_without_matching_order_item", "rf", "order_item_id", "it", "order_item_id"),
        ("order_item_refunds_without_matching_order", "rf", "order_id", "od", "order_id"),
        ("website_pageviews_without_matching_session", "pv", "website_session_id", "ws", "website_session_id"),
        ("orders_without_matching_primary_product", "od_primary", "product_id", "pr", "product_id"),
    ]
    rows = [
        f"SELECT '{name}' AS check_name, count(*) AS orphan_count FROM {child} c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})"
        for name, child, fk, parent, pk in relations
    ]
    primary = (
        "SELECT od.order_id, it.product_id FROM od "
        "LEFT JOIN it ON it.order_id = od.order_id AND it.is_primary_item = 1"
    )
    return _with("ws wo pv pr od it rf", {"od_primary": primary}) + " UNION ALL ".join(rows)


def _most(table: str, fk: str, largest: str, multiple: str) -> str:
    per_parent = f"SELECT count(*) AS n FROM {table} GROUP BY {fk}"
    return (
        _with(table, {"c": per_parent})
        + f"SELECT max(n) AS {largest}, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS {multiple} FROM c"
    )


def _spread(table: str, fk: str, suffix: str) -> str:
    per_parent = f"SELECT count(*) AS n FROM {table} GROUP BY {fk}"
    return (
        _with(table, {"c": per_parent})
        + f"SELECT min(n) AS min_{suffix}, {avg('sum(n)', 'count(*)')} AS avg_{suffix}, max(n) AS max_{suffix} FROM c"
    )


def _before(child: str, parent: str, key: str, name: str) -> str:
    return (
        _with(f"{child} {parent}")
        + f"SELECT count(*) AS {name} FROM {child} c, {parent} p "
        + f"WHERE c.{key} = p.{key} AND c.created_at < p.created_at"
    )


# One row with the counts and sums of path A.
SITE = f"""
    SELECT (SELECT count(*) FROM ws) AS visits,
           (SELECT count(*) FROM wo) AS bought,
           (SELECT sum(price_usd) FROM wo) AS gross,
           (SELECT sum(price_usd - cogs_usd) FROM wo) AS margin,
           (SELECT COALESCE(sum(refund_amount_usd), 0) FROM wr) AS refunded,
           (SELECT count(DISTINCT order_id) FROM wr) AS refunded_orders"""

HEADLINES = {
    "total_sessions": "visits",
    "total_orders": "bought",
    "session_to_order_conversion_rate_pct": pct("bought", "visits"),
    "gross_revenue": "gross",
    "total_refund_amount": "refunded",
    "net_revenue": "gross - refunded",
    "average_order_value": per("gross", "bought"),
    "revenue_per_session": per("gross", "visits"),
    "net_revenue_per_session": per("gross - refunded", "visits"),
    "gross_margin": "margin",
    "gross_margin_rate_pct": pct_usd("margin", "gross"),
    "refund_share_of_revenue_pct": pct_usd("refunded", "gross"),
    "refund_order_rate_pct": pct("refunded_orders", "bought"),
}
CHECKED = [
    "total_sessions",
    "total_orders",
    "session_to_order_conversion_rate_pct",
    "gross_revenue",
    "average_order_value",
    "revenue_per_session",
    "gross_margin",
    "gross_margin_rate_pct",
    "total_refund_amount",
    "net_revenue",
]


def _headlines(names: list[str], columns: str = "'{name}' AS metric_name, {value} AS metric_value") -> str:
    rows = [
        "SELECT " + columns.format(name=name, value=usd(HEADLINES[name])) + " FROM site" for name in names
    ]
    return _with("ws wo wr", {"site": SITE}) + " UNION ALL ".join(rows)


def _trend(columns: dict[str, str], grain: str = "day", spread: int = 1) -> str:
    """Path A per period of each table's own dates, for periods with sessions; events ``spread`` times as far apart."""
    bucket = f"CAST(date_trunc('{grain}', created_at) AS DATE) AS {grain}"
    ctes = {
        "s": f"SELECT {bucket}, count(*) AS visits FROM ws GROUP BY 1",
        "o": f"SELECT {bucket}, count(*) AS n, sum(price_usd) AS gross_n, "
        "sum(price_usd - cogs_usd) AS margin_n FROM wo GROUP BY 1",
        "r": f"SELECT {bucket}, sum(refund_amount_usd) AS refunded_n FROM wr GROUP BY 1",
        "d": f"SELECT s.{grain}, visits, COALESCE(n, 0) AS bought, COALESCE(gross_n, 0) AS gross, "
        "COALESCE(margin_n, 0) AS margin, COALESCE(refunded_n, 0) AS refunded "
        f"FROM s LEFT JOIN o ON o.{grain} = s.{grain} LEFT JOIN r ON r.{grain} = s.{grain}",
        "lagged": "SELECT *, lag(visits) OVER w AS visits0, lag(bought) OVER w AS bought0, "
        f"lag(gross) OVER w AS gross0 FROM d WINDOW w AS (ORDER BY {grain})",
    }
    chosen = ", ".join(f"{value} AS {name}" for name, value in ({grain: grain} | columns).items())
    day = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    later = f"ts + CAST({day} * {spread - 1} AS INT) * INTERVAL '1' DAY AS created_at"
    return _with("ws wo wr", ctes).replace("ts AS created_at", later) + f"SELECT {chosen} FROM lagged"


TREND = {
    "sessions": "visits",
    "orders": "bought",
    "conversion_rate_pct": pct("bought", "visits"),
    "gross_revenue": usd("gross"),
    "average_order_value": per("gross", "bought"),
    "revenue_per_session": per("gross", "visits"),
}
TREND_REFUNDS = {
    "refund_amount": usd("refunded"),
    "net_revenue": usd("gross - refunded"),
    "gross_margin": usd("margin"),
    "gross_margin_rate_pct": pct_usd("margin", "gross"),
}


def _change(suffix: str) -> dict[str, str]:
    return {
        f"sessions_{suffix}_change_pct": pct("visits - visits0", "visits0"),
        f"orders_{suffix}_change_pct": pct("bought - bought0", "bought0"),
        f"revenue_{suffix}_change_pct": pct_usd("gross - gross0", "gross0"),
    }


def _segments(keys: dict[str, str], source: str = "ws", least: int = 0) -> str:
    """Sessions left joined to their orders, counted distinct, per key."""
    select = "".join(f"{value} AS {name}, " for name, value in keys.items())
    group = ("GROUP BY " + ", ".join(keys.values())) if keys else ""
    having = f" HAVING count(DISTINCT x.website_session_id) >= {least}" if least else ""
    return (
        f"SELECT {select}count(DISTINCT x.website_session_id) AS visits, count(DISTINCT wo.order_id) AS bought, "
        f"COALESCE(sum(wo.price_usd), 0) AS gross "
        f"FROM {source} x LEFT JOIN wo ON wo.website_session_id = x.website_session_id {group}{having}"
    )


RATED = {
    "sessions": "g.visits",
    "orders": "g.bought",
    "conversion_rate_pct": pct("g.bought", "g.visits"),
    "gross_revenue": usd("g.gross"),
    "average_order_value": per("g.gross", "g.bought"),
    "revenue_per_session": per("g.gross", "g.visits"),
}
COMPARED = {
    "session_share_pct": pct("g.visits", "a.visits"),
    "overall_conversion_rate_pct": pct("a.bought", "a.visits"),
    "overall_revenue_per_session": per("a.gross", "a.visits"),
}


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{value} AS {name}" for name, value in columns.items())


def _performance(dim: str, label: str | None = None) -> str:
    value = f"COALESCE(x.{dim}, '{label}')" if label else f"x.{dim}"
    return _with("ws wo", {"g": _segments({dim: value})}) + f"SELECT {dim}, {_columns(RATED)} FROM g"


def _against_site(
    keys: dict[str, str], name: str, cases: str, drop: tuple[str, ...], source: str = "ws", least: int = 0
) -> str:
    """Segments beside the site average with a label; ``cases`` reads the rounded columns."""
    ctes = {
        "first_page": "SELECT f.website_session_id, pv.pageview_url AS landing_page FROM first_pv f "
        "JOIN pv ON pv.website_pageview_id = f.first_id",
        "g": _segments(keys, source, least),
        "a": _segments({}),
        "c": f"SELECT {', '.join('g.' + k for k in keys)}, {_columns(RATED)}, {_columns(COMPARED)}, "
        "a.visits AS all_visits FROM g, a",
    }
    gaps = (
        "CAST(conversion_rate_pct - overall_conversion_rate_pct AS DECIMAL(18,2)) AS conversion_rate_gap_pp, "
        "CAST(revenue_per_session - overall_revenue_per_session AS DECIMAL(18,2)) AS revenue_per_session_gap"
    )
    exclude = ", ".join(("all_visits", *drop))
    return (
        _with("ws wo", ctes)
        + f"SELECT * EXCLUDE ({exclude}) FROM (SELECT *, {gaps}, CASE {cases} END AS {name} FROM c) q"
    )


GOOD_CONVERSION = "conversion_rate_pct >= overall_conversion_rate_pct"
GOOD_REVENUE = "revenue_per_session >= overall_revenue_per_session"

# Items with their refunds, per product.
LINE_DAYS = """
    SELECT ln.product_id, CAST(date_diff('day', CAST(od.created_at AS DATE), CAST(rf.created_at AS DATE)) AS INT) AS days
    FROM rf JOIN ln ON ln.order_item_id = rf.order_item_id JOIN od ON od.order_id = ln.order_id"""

PRODUCT_SUMS = """
    SELECT it.product_id, count(it.order_item_id) AS sold, sum(it.price_usd) AS gross, sum(it.cogs_usd) AS cogs,
           count(rf.order_item_refund_id) AS returned, COALESCE(sum(rf.refund_amount_usd), 0) AS refunded
    FROM ln it LEFT JOIN rf ON rf.order_item_id = it.order_item_id GROUP BY 1"""
PRODUCT_COLUMNS = {
    "items_sold": "sold",
    "gross_revenue": usd("gross"),
    "gross_margin": usd("gross - cogs"),
    "gross_margin_rate_pct": pct_usd("gross - cogs", "gross"),
    "refunded_items": "returned",
    "refund_amount": usd("refunded"),
    "item_refund_rate_pct": pct("returned", "sold"),
    "net_revenue": usd("gross - refunded"),
}


def _product_refund_risk() -> str:
    ctes = {
        "sums": PRODUCT_SUMS,
        "rated": f"SELECT sums.product_id, product_name, {_columns(PRODUCT_COLUMNS)} "
        "FROM sums JOIN pr ON pr.product_id = sums.product_id",
        "a": f"SELECT {pct('sum(returned)', 'sum(sold)')} AS overall_item_refund_rate_pct FROM sums",
    }
    return _with("ln rf pr", ctes) + (
        "SELECT rated.*, overall_item_refund_rate_pct, "
        "RANK() OVER (ORDER BY net_revenue DESC NULLS FIRST) AS net_revenue_rank, "
        "RANK() OVER (ORDER BY item_refund_rate_pct DESC NULLS FIRST) AS refund_rate_rank, "
        "CASE WHEN refunded_items >= 10 AND item_refund_rate_pct > overall_item_refund_rate_pct "
        "THEN 'refund_risk' "
        "WHEN net_revenue = (SELECT max(net_revenue) FROM rated) THEN 'top_net_revenue_product' "
        "WHEN gross_margin_rate_pct >= 60 THEN 'strong_margin_product' ELSE 'standard_product' END "
        "AS product_business_status FROM rated, a"
    )


def _product_refund_summary() -> str:
    grouped = (
        "SELECT product_name, sum(sold) AS sold, sum(gross) AS gross, sum(returned) AS returned, "
        "sum(refunded) AS refunded FROM sums JOIN pr ON pr.product_id = sums.product_id GROUP BY 1"
    )
    columns = {k: v for k, v in PRODUCT_COLUMNS.items() if "margin" not in k}
    columns |= {"items_sold": big("sold"), "refunded_items": big("returned")}
    return (
        _with("ln rf pr", {"sums": PRODUCT_SUMS, "named": grouped})
        + f"SELECT product_name, {_columns(columns)} FROM named"
    )


def _funnel_flags() -> dict[str, str]:
    reached = ", ".join(
        f"max(CASE WHEN pageview_url = '{step.urls[0]}' THEN 1 ELSE 0 END) AS {step.key}"
        for step in EVENT_FUNNEL
        if step.urls
    )
    return {"flags": f"SELECT website_session_id, {reached} FROM pv GROUP BY 1"}


def _funnel_long() -> str:
    rows = [
        f"SELECT website_session_id, {step.order} AS funnel_step_order, '{step.key}' AS funnel_step FROM flags"
        + (f" WHERE {step.key} = 1" if step.urls else "")
        for step in EVENT_FUNNEL
    ]
    return " UNION ALL ".join(rows)


def _funnel_steps() -> str:
    ctes = _funnel_flags() | {
        "reached": _funnel_long(),
        "counted": "SELECT funnel_step_order, funnel_step, count(*) AS n FROM reached GROUP BY 1, 2",
        "walked": "SELECT *, first_value(n) OVER w AS n1, lag(n) OVER w AS n0 FROM counted "
        "WINDOW w AS (ORDER BY funnel_step_order)",
    }
    columns = {
        "funnel_step_order": "funnel_step_order",
        "funnel_step": "funnel_step",
        "sessions_reached": "n",
        "conversion_from_total_pct": pct("n", "n1"),
        "conversion_from_previous_step_pct": pct("n", "n0"),
        "dropoff_from_previous_step": "n0 - n",
        "dropoff_from_previous_step_pct": pct("n0 - n", "n0"),
    }
    return _with("pv", ctes) + f"SELECT {_columns(columns)} FROM walked"


def _month(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS DATE)"


def _sales(label: str) -> str:
    return (
        f"SELECT {_month('it.created_at')} AS month, {label}, count(it.order_item_id) AS items_sold, "
        f"{usd('sum(it.price_usd)')} AS gross_revenue FROM it "
        f"JOIN pr ON pr.product_id = it.product_id GROUP BY 1, 2"
    )


MIX = {
    "sales": _sales("product_type"),
    "mix": f"SELECT month, product_type, items_sold, {big('t')} AS total_items, {pct('items_sold', 't')} "
    "AS product_share_pct FROM (SELECT *, sum(items_sold) OVER (PARTITION BY month) AS t FROM sales) q",
}


def _pivot(source: str, value: str, kind: str) -> str:
    wide = ", ".join(
        f"CAST(COALESCE(sum(CASE WHEN product_type = '{t}' THEN {value} END), 0) AS {kind}) AS {t}"
        for t in PRODUCT_TYPES
    )
    listed = ", ".join(f"'{t}'" for t in PRODUCT_TYPES)
    rest = f"COALESCE(sum(CASE WHEN product_type IN ({listed}) THEN 0 ELSE {value} END), 0)"
    return _with("it pr", MIX) + f"SELECT month, {wide}, CAST({rest} AS {kind}) AS other FROM {source} GROUP BY month"


NAMED_SESSIONS = (
    "SELECT website_session_id, CAST(created_at AS DATE) AS session_date, user_id, "
    "is_repeat_session = 1 AS is_repeat_session, "
    "CASE WHEN is_repeat_session = 1 THEN 'Repeat' ELSE 'New' END AS session_type, "
    "COALESCE(utm_source, 'direct_or_none') AS utm_source, COALESCE(utm_campaign, 'no_campaign') AS utm_campaign, "
    "COALESCE(utm_content, 'no_content') AS utm_content, device_type FROM ws"
)

# Path A metrics per group: every fact carries the attributes of its session.
METRIC_SQL = {
    "total_sessions": "s_n",
    "new_sessions": "s_n - s_repeat",
    "repeat_sessions": "s_repeat",
    "repeat_session_share": fraction("s_repeat", "s_n"),
    "total_orders": "COALESCE(o_n, 0)",
    "conversion_rate": fraction("COALESCE(o_n, 0)", "s_n"),
    "session_conversion_rate": fraction("COALESCE(o_n, 0)", "s_n"),
    "gross_revenue": usd("o_usd"),
    "gross_revenue_order_date": usd("o_usd"),
    "average_order_value": fraction_usd("o_usd", "o_n", True),
    "revenue_per_session": fraction_usd("o_usd", "s_n", True),
    "net_revenue": usd("o_usd - COALESCE(r_usd, 0)"),
    "net_revenue_per_session": fraction_usd("o_usd - COALESCE(r_usd, 0)", "s_n", True),
    "gross_margin": usd("o_margin"),
    "gross_margin_rate": fraction_usd("o_margin", "o_usd"),
    "refund_amount": usd("r_usd"),
    "refunded_items": "COALESCE(r_n, 0)",
    "refunded_orders": "COALESCE(r_orders, 0)",
    "refund_share_of_revenue": fraction_usd("r_usd", "o_usd"),
    "refund_order_rate": fraction("COALESCE(r_orders, 0)", "o_n"),
    "items_sold": "COALESCE(o_n, 0)",
    "product_gross_revenue": usd("o_usd"),
    "product_net_revenue": usd("o_usd - COALESCE(r_usd, 0)"),
    "product_refund_amount": usd("r_usd"),
    "item_refund_rate": fraction("COALESCE(r_n, 0)", "o_n"),
    "product_mix": fraction("o_n", "o_n"),
    "channel_conversion_rate": fraction("COALESCE(o_n, 0)", "s_n"),
    "channel_revenue_per_session": fraction_usd("o_usd", "s_n", True),
    "orders_from_repeat_sessions": "COALESCE(o_repeat, 0)",
    "repeat_session_conversion_rate": fraction("COALESCE(o_repeat, 0)", "s_repeat"),
    "distinct_users": "s_users",
}


def _metrics(names: list[str], by: str | None = None, where: str = "TRUE") -> str:
    dim = by or "'all'"
    ctes = {
        "fs": NAMED_SESSIONS,
        "s": f"SELECT {dim} AS g, count(*) AS s_n, count(*) FILTER (WHERE is_repeat_session) AS s_repeat, "
        f"count(DISTINCT user_id) AS s_users FROM fs WHERE {where} GROUP BY 1",
        "o": f"SELECT {dim} AS g, count(*) AS o_n, sum(price_usd) AS o_usd, sum(price_usd - cogs_usd) AS o_margin, "
        "count(*) FILTER (WHERE is_repeat_session) AS o_repeat "
        f"FROM wo JOIN fs USING (website_session_id) WHERE {where} GROUP BY 1",
        "r": f"SELECT {dim} AS g, count(*) AS r_n, count(DISTINCT wr.order_id) AS r_orders, "
        "sum(refund_amount_usd) AS r_usd FROM wr JOIN wo ON wo.order_id = wr.order_id "
        f"JOIN fs ON fs.website_session_id = wo.website_session_id WHERE {where} GROUP BY 1",
    }
    columns = {by: "s.g"} if by else {}
    columns |= {name: METRIC_SQL[name] for name in names}
    return (
        _with("ws wo wr", ctes)
        + f"SELECT {_columns(columns)} FROM s LEFT JOIN o ON o.g = s.g LEFT JOIN r ON r.g = s.g"
    )


def _metrics_over(names: list[str], keys: list[str], sessions: str, ctes: dict[str, str] | None = None, orders: str = "wo") -> str:
    """As ``_metrics``, where ``sessions`` (x) may hold a session once for each of several groups."""
    by = ", ".join(keys)
    same = " AND ".join("{0}." + f"{key} IS NOT DISTINCT FROM s.{key}" for key in keys)
    parts = {
        "fs": NAMED_SESSIONS,
        **(ctes or {}),
        "x": sessions,
        "s": f"SELECT {by}, count(*) AS s_n, count(*) FILTER (WHERE is_repeat_session) AS s_repeat, "
        f"count(DISTINCT user_id) AS s_users FROM x GROUP BY {by}",
        "o": f"SELECT {by}, count(*) AS o_n, sum(price_usd) AS o_usd, sum(price_usd - cogs_usd) AS o_margin, "
        "count(*) FILTER (WHERE is_repeat_session) AS o_repeat "
        f"FROM {orders} wo JOIN x USING (website_session_id) GROUP BY {by}",
        "r": f"SELECT {by}, count(*) AS r_n, count(DISTINCT wr.order_id) AS r_orders, sum(refund_amount_usd) AS r_usd "
        f"FROM wr JOIN wo ON wo.order_id = wr.order_id JOIN x ON x.website_session_id = wo.website_session_id GROUP BY {by}",
    }
    columns = {key: f"s.{key}" for key in keys} | {name: METRIC_SQL[name] for name in names}
    return (
        _with("ws wo wr pv", parts)
        + f"SELECT {_columns(columns)} FROM s LEFT JOIN o ON {same.format('o')} LEFT JOIN r ON {same.format('r')}"
    )


def _flawed_lookups() -> str:
    """Sessions whose id 7 divides are missing unless 5 divides it, others that 5 divides are there twice."""
    times = "CASE WHEN website_session_id IS NULL THEN 0 ELSE (website_session_id % 7 <> 0)::INT + (website_session_id % 5 = 0)::INT END"
    counts = f"count(*) AS rows, {big('coalesce(sum(greatest(times - 1, 0)), 0)')} AS extra, count(*) FILTER (times = 0) AS unmatched"
    return _with(
        "wo wr",
        {
            "o": f"SELECT order_id, website_session_id, {times} AS times FROM wo",
            "r": "SELECT wr.order_id, coalesce(max(o.times), 0) AS copies, greatest(coalesce(max(o.times), 0), 1) AS times "
            "FROM wr LEFT JOIN o ON o.order_id = wr.order_id GROUP BY 1",
        },
    ) + (
        f"SELECT 'orders' AS fact, 'orders' AS child, 'sessions' AS parent, {counts} FROM (SELECT DISTINCT website_session_id, times FROM o) "
        f"UNION ALL SELECT 'refunds', 'orders', 'sessions', {counts} FROM o "
        f"UNION ALL SELECT 'refunds', 'refunds', 'orders', {counts} FROM r"
    )


def _spread_day(day: str) -> str:
    """The day that lies as many times further from the first."""
    return f"(DATE '2024-01-01' + CAST({MONTHS_SPREAD} * date_diff('day', DATE '2024-01-01', {day}) AS INTEGER))"


SESSIONS_BY_MONTH = f"SELECT *, strftime({_spread_day('session_date')}, '%Y-%m') AS year_month FROM fs"
LANDINGS = "SELECT website_session_id, arg_min(pageview_url, website_pageview_id) AS landing_page FROM pv p WHERE created_at = (SELECT min(created_at) FROM pv q WHERE q.website_session_id = p.website_session_id) GROUP BY 1"


def _second_quarter() -> str:
    """Each order in the quarter of its own day; refunds follow their order."""
    day = _spread_day("CAST(wo.created_at AS DATE)")
    return _with(
        "ws wo wr",
        {
            "fs": NAMED_SESSIONS,
            "o": f"SELECT wo.*, strftime({day}, '%B') AS month_name, utm_source FROM wo LEFT JOIN fs USING (website_session_id) WHERE quarter({day}) = 2",
            "r": "SELECT order_id, sum(refund_amount_usd) AS back FROM wr GROUP BY 1",
        },
    ) + (
        f"SELECT month_name, utm_source, count(*) AS total_orders, {usd('sum(price_usd)')} AS gross_revenue, "
        f"{usd('sum(back)')} AS refund_amount, count(back) AS refunded_orders "
        "FROM o LEFT JOIN r USING (order_id) GROUP BY 1, 2"
    )


CHANNEL = [
    "total_sessions",
    "total_orders",
    "channel_conversion_rate",
    "gross_revenue",
    "channel_revenue_per_session",
    "net_revenue",
    "refunded_orders",
    "distinct_users",
]
REPEAT = [
    "total_sessions",
    "new_sessions",
    "repeat_sessions",
    "repeat_session_share",
    "orders_from_repeat_sessions",
    "repeat_session_conversion_rate",
    "distinct_users",
]


def _product_mix_pct() -> str:
    named = (
        "SELECT product_name, sum(sold) AS sold, sum(gross) AS gross, sum(returned) AS returned, "
        "sum(refunded) AS refunded FROM sums JOIN pr ON pr.product_id = sums.product_id GROUP BY 1"
    )
    columns = {
        "product_name": "product_name",
        "items_sold": big("sold"),
        "product_mix": fraction("sold", "(SELECT sum(sold) FROM named)"),
        "product_net_revenue": usd("gross - refunded"),
        "item_refund_rate": fraction("returned", "sold"),
    }
    return _with("ln rf pr", {"sums": PRODUCT_SUMS, "named": named}) + f"SELECT {_columns(columns)} FROM named"


def _reconciliation() -> str:
    value = "'{name}' AS metric_name, {value} AS metric_value, {value} AS check_value, " + usd("0") + " AS difference"
    return _headlines(CHECKED, value)


def _header_lines() -> str:
    ctes = {
        "l": "SELECT order_id, count(*) AS lines, sum(price_usd) AS price, sum(cogs_usd) AS cogs FROM ln GROUP BY 1",
        "c": "SELECT od.order_id, COALESCE(lines, 0) AS lines, "
        f"{usd('price_usd')} AS header_price, {usd0('price')} AS lines_price, "
        f"{usd('cogs_usd')} AS header_cogs, {usd0('cogs')} AS lines_cogs "
        "FROM od LEFT JOIN l ON l.order_id = od.order_id",
    }
    return _with("od ln", ctes) + (
        f"SELECT *, {usd('header_price - lines_price')} AS price_difference, "
        f"{usd('header_cogs - lines_cogs')} AS cogs_difference FROM c "
        "WHERE header_price <> lines_price OR header_cogs <> lines_cogs"
    )


def _attach_rate() -> str:
    ctes = {
        "p": "SELECT order_id, product_id FROM it WHERE is_primary_item = 1",
        "n": "SELECT product_id, count(*) AS primary_orders FROM p GROUP BY 1",
        "x": "SELECT p.product_id AS primary_product_id, it.product_id AS add_on_product_id, "
        "count(DISTINCT it.order_id) AS attached_orders, count(*) AS add_on_items "
        "FROM p JOIN it ON it.order_id = p.order_id AND it.is_primary_item = 0 GROUP BY 1, 2",
    }
    return _with("it", ctes) + (
        "SELECT primary_product_id, add_on_product_id, primary_orders, attached_orders, add_on_items, "
        f"{pct('attached_orders', 'primary_orders')} AS attach_rate_pct "
        "FROM x JOIN n ON n.product_id = x.primary_product_id"
    )


def _first_visit_orders() -> str:
    pages = ", ".join(f"'{page}'" for page in EVENT_PAGES)
    ctes = {
        "visits": "SELECT website_session_id, pageview_url, min(created_at) AS seen, "
        "min_by(website_pageview_id, (created_at, website_pageview_id)) AS seen_id "
        f"FROM pv WHERE pageview_url IN ({pages}) GROUP BY 1, 2",
        "walks": "SELECT website_session_id, string_agg(pageview_url, ' > ' ORDER BY seen, seen_id) AS path "
        "FROM visits GROUP BY 1",
    }
    return _with("pv", ctes) + "SELECT path, count(*) AS sessions FROM walks GROUP BY 1"


def _session_paths() -> str:
    ctes = {
        "walks": "SELECT website_session_id, list(pageview_url ORDER BY created_at, website_pageview_id) AS pages "
        "FROM pv WHERE website_session_id IS NOT NULL GROUP BY 1",
        "paths": "SELECT pages, min(website_session_id) AS path_id, count(*) AS sessions FROM walks GROUP BY 1",
    }
    return _with("pv", ctes) + (
        "SELECT path_id, CAST(step AS BIGINT) AS step, pages[step] AS page, sessions "
        "FROM (SELECT *, unnest(generate_series(1, len(pages))) AS step FROM paths)"
    )


# --- Tables with flaws, so that the checks find some ---

FLAWED = {
    "f_ws": "SELECT CASE WHEN s.website_session_id % 13 <> 0 THEN s.website_session_id END AS website_session_id, "
    "arg_max(pv.created_at, pv.website_pageview_id) AS created_at FROM ws s "
    "JOIN pv ON pv.website_session_id = s.website_session_id "
    "WHERE s.website_session_id % 11 <> 0 GROUP BY s.website_session_id",
    "f_pr": "SELECT CASE WHEN product_id % 50 <> 0 THEN product_id END AS product_id FROM pr",
    "f_od": "SELECT CASE WHEN order_id % 97 <> 0 THEN order_id END AS order_id, created_at FROM od",
    "f_it": "SELECT CASE WHEN order_item_id % 101 <> 0 THEN order_item_id END AS order_item_id, order_id, "
    "product_id, created_at, price_usd FROM it",
    "f_rf": "SELECT order_item_refund_id, order_item_id, order_id + CASE WHEN order_item_id % 7 = 0 THEN 1 ELSE 0 END "
    "AS order_id, created_at, CAST(refund_amount_usd * (order_item_id % 3 + 1) * 0.50 AS DECIMAL(12,2)) "
    "AS refund_amount_usd FROM rf UNION ALL "
    "SELECT order_item_refund_id + 1, order_item_id, order_id, created_at, refund_amount_usd FROM rf "
    "WHERE order_item_id % 5 = 0",
}
FLAWED_TABLES = "ws wo pv pr od it rf"


def _flawed_orphans() -> str:
    relations = [
        ("orders_without_matching_session", "wo", "website_session_id", "f_ws", "website_session_id"),
        ("website_pageviews_without_matching_session", "pv", "website_session_id", "f_ws", "website_session_id"),
        ("order_items_without_matching_order", "f_it", "order_id", "f_od", "order_id"),
        ("order_items_without_matching_product", "f_it", "product_id", "f_pr", "product_id"),
        ("order_item_refunds_without_matching_order_item", "f_rf", "order_item_id", "f_it", "order_item_id"),
        ("order_item_refunds_without_matching_order", "f_rf", "order_id", "f_od", "order_id"),
    ]
    rows = [
        f"SELECT '{name}' AS check_name, count(*) AS orphan_count FROM {child} c "
        f"WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})"
        for name, child, fk, parent, pk in relations
    ]
    return _with(FLAWED_TABLES, FLAWED) + " UNION ALL ".join(rows)


def _flawed_nulls() -> str:
    keys = [
        ("products", "f_pr", "product_id"),
        ("website_sessions", "f_ws", "website_session_id"),
        ("orders", "f_od", "order_id"),
        ("order_items", "f_it", "order_item_id"),
    ]
    rows = [f"SELECT '{name}.{key}' AS field_name, count(*) - count({key}) AS null_count FROM {t}" for name, t, key in keys]
    return _with(FLAWED_TABLES, FLAWED) + " UNION ALL ".join(rows)


def _flawed_consistency() -> str:
    return _with(FLAWED_TABLES, FLAWED) + (
        "SELECT count(*) AS refunds, count(*) FILTER (WHERE i.order_item_id IS NULL) AS refunds_without_line, "
        "count(*) FILTER (WHERE i.order_item_id IS NOT NULL AND r.order_id IS DISTINCT FROM i.order_id) "
        "AS order_id_mismatches, count(*) FILTER (WHERE refund_amount_usd < price_usd) AS partial_refunds, "
        "count(*) FILTER (WHERE refund_amount_usd > price_usd) AS refunds_above_price "
        "FROM f_rf r LEFT JOIN f_it i ON i.order_item_id = r.order_item_id"
    )


def _flawed_most() -> str:
    return _with(FLAWED_TABLES, FLAWED | {"c": "SELECT count(*) AS n FROM f_rf GROUP BY order_item_id"}) + (
        "SELECT max(n) AS max_refunds_per_order_item, "
        "sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS order_items_with_multiple_refunds FROM c"
    )


def _flawed_before(child: str, name: str) -> str:
    return _with(FLAWED_TABLES, FLAWED) + (
        f"SELECT count(*) AS {name} FROM {child} c, f_ws p "
        "WHERE c.website_session_id = p.website_session_id AND c.created_at < p.created_at"
    )


def oracle_sql() -> dict[str, str]:
    least, most = FIRST_WEEKS
    users = (
        "SELECT user_id, CAST(date_trunc('week', created_at) AS DATE) AS week, "
        "CAST(date_trunc('week', min(created_at) OVER (PARTITION BY user_id)) AS DATE) AS first_week FROM ws"
    )
    both_rules = (
        "SELECT DISTINCT website_session_id, "
        "first_value(pageview_url) OVER (PARTITION BY website_session_id ORDER BY website_pageview_id) AS a, "
        "first_value(pageview_url) OVER (PARTITION BY website_session_id "
        "ORDER BY created_at, website_pageview_id) AS b FROM pv"
    )
    first_by_time = (
        "SELECT website_session_id, pageview_url AS landing_page, ROW_NUMBER() OVER "
        "(PARTITION BY website_session_id ORDER BY created_at, website_pageview_id) AS n FROM pv"
    )
    calendar = {
        "days": "SELECT CAST(created_at AS DATE) AS d FROM ws UNION ALL SELECT CAST(created_at AS DATE) FROM wo "
        "UNION ALL SELECT CAST(created_at AS DATE) FROM wr",
        "span": "SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), "
        "INTERVAL '1' DAY)) AS DATE) AS date FROM days",
    }
    month_baskets = (
        f"SELECT {_month('created_at')} AS month, order_id, count(*) AS n FROM it GROUP BY 1, 2"
    )
    return {
        # Exploration
        "row_counts": _per_table("'{name}' AS table_name, count(*) AS row_count"),
        "date_ranges": _per_table(
            "'{name}' AS table_name, min(created_at) AS min_date, max(created_at) AS max_date"
        ),
        "product_catalog": _with("pr") + "SELECT product_id, created_at, product_name FROM pr",
        "sessions_by_source": _sessions_by("utm_source", "direct_or_none"),
        "sessions_by_campaign": _sessions_by("utm_campaign", "no_campaign"),
        "sessions_by_content": _sessions_by("utm_content", "no_content"),
        "sessions_by_device": _sessions_by("device_type"),
        "referer_sessions": _with("ws")
        + "SELECT 'https://' || utm_source || '.example' AS http_referer, count(*) AS sessions FROM ws GROUP BY 1",
        "pageviews_by_url": _with("pv")
        + "SELECT pageview_url, count(*) AS pageviews, count(DISTINCT website_session_id) AS sessions_reached "
        "FROM pv GROUP BY 1",
        "landing_page_sessions": _with("first_pv")
        + "SELECT pageview_url AS landing_page, count(*) AS sessions FROM pv "
        "WHERE website_pageview_id IN (SELECT first_id FROM first_pv) GROUP BY 1",
        # Data quality
        "pk_uniqueness": _per_table(
            "'{name}' AS table_name, count(*) AS total_rows, count(DISTINCT {key}) AS distinct_ids, "
            "count(*) - count(DISTINCT {key}) AS duplicate_ids"
        ),
        "pk_nulls": _per_table("'{name}.{key}' AS field_name, count(*) - count({key}) AS null_count"),
        "fk_orphans": _orphans(),
        "orders_per_session": _most(
            "wo", "website_session_id", "max_orders_per_session", "sessions_with_multiple_orders"
        ),
        "pageviews_per_session": _spread("pv", "website_session_id", "pageviews_per_session"),
        "items_per_order": _spread("ln", "order_id", "items_per_order"),
        "refunds_per_item": _most(
            "rf", "order_item_id", "max_refunds_per_order_item", "order_items_with_multiple_refunds"
        ),
        "orders_before_session": _before("wo", "ws", "website_session_id", "orders_before_session_count"),
        "pageviews_before_session": _before("pv", "ws", "website_session_id", "pageviews_before_session_count"),
        "refunds_before_item": _before("rf", "it", "order_item_id", "refunds_before_order_item_count"),
        "refunds_before_order": _before("rf", "od", "order_id", "refunds_before_order_count"),
        # KPIs
        "core_kpis": _headlines(list(HEADLINES)),
        "monthly_kpis": _trend(TREND | TREND_REFUNDS, "month", MONTHS_SPREAD),
        "daily_kpis": _trend(TREND | TREND_REFUNDS),
        "source_performance": _performance("utm_source", "direct_or_none"),
        "campaign_performance": _performance("utm_campaign", "no_campaign"),
        "device_performance": _performance("device_type"),
        "product_performance": _with("ln rf pr", {"sums": PRODUCT_SUMS})
        + f"SELECT sums.product_id, product_name, {_columns(PRODUCT_COLUMNS)}, {usd('cogs')} AS total_cogs "
        "FROM sums JOIN pr ON pr.product_id = sums.product_id",
        # Business analysis
        "monthly_growth": _trend(TREND | _change("mom"), "month", MONTHS_SPREAD),
        "daily_growth": _trend(TREND | _change("dod")),
        "source_campaign_segments": _against_site(
            {
                "utm_source": "COALESCE(x.utm_source, 'direct_or_none')",
                "utm_campaign": "COALESCE(x.utm_campaign, 'no_campaign')",
            },
            "business_segment",
            f"WHEN {GOOD_CONVERSION} AND {GOOD_REVENUE} THEN 'high_quality_traffic' "
            f"WHEN sessions * 10 >= all_visits AND NOT {GOOD_REVENUE} THEN 'high_volume_lower_efficiency' "
            f"WHEN sessions * 10 < all_visits AND {GOOD_REVENUE} THEN 'smaller_but_high_value' "
            "ELSE 'average_or_low_priority'",
            (
                "overall_conversion_rate_pct",
                "overall_revenue_per_session",
                "conversion_rate_gap_pp",
                "revenue_per_session_gap",
            ),
            least=MIN_CAMPAIGN_SESSIONS,
        ),
        "device_opportunity": _against_site(
            {"device_type": "x.device_type"},
            "device_opportunity",
            f"WHEN sessions * 10 >= all_visits * 3 AND NOT {GOOD_CONVERSION} "
            "THEN 'high_volume_underperforming_device' "
            f"WHEN {GOOD_CONVERSION} AND {GOOD_REVENUE} THEN 'strong_device_segment' ELSE 'monitor'",
            ("average_order_value",),
        ),
        "product_refund_risk": _product_refund_risk(),
        "landing_page_performance": _against_site(
            {"landing_page": "x.landing_page"},
            "landing_page_status",
            f"WHEN sessions * 10 >= all_visits AND NOT {GOOD_CONVERSION} "
            "THEN 'high_traffic_underperforming_landing_page' "
            f"WHEN {GOOD_CONVERSION} AND {GOOD_REVENUE} THEN 'strong_landing_page' ELSE 'monitor'",
            ("average_order_value",),
            source="first_page",
            least=MIN_LANDING_SESSIONS,
        ),
        "funnel_steps": _funnel_steps(),
        # Notebook jobs
        "core_kpis_check": _headlines(CHECKED).replace(
            "'session_to_order_conversion_rate_pct'", "'conversion_rate_pct'"
        ),
        "monthly_trend": _trend(TREND, "month", MONTHS_SPREAD),
        "daily_trend": _trend(TREND),
        "monthly_items_per_order": _with("it", {"b": month_baskets})
        + f"SELECT month, {avg('sum(n)', 'count(*)')} AS avg_items_per_order FROM b GROUP BY 1",
        "monthly_product_sales": _with("it pr") + _sales("product_name"),
        "monthly_items_pivot": _pivot("sales", "items_sold", "BIGINT"),
        "monthly_product_mix": _with("it pr", MIX) + "SELECT * FROM mix",
        "monthly_mix_pivot": _pivot("mix", "product_share_pct", "DECIMAL(18,2)"),
        "product_refund_summary": _product_refund_summary(),
        # Marts
        "session_landing": _with("pv", {"f": first_by_time})
        + "SELECT website_session_id, landing_page FROM f WHERE n = 1",
        "session_funnel_flags": _with("pv", _funnel_flags()) + "SELECT * FROM flags",
        "session_funnel_long": _with("pv", _funnel_flags()) + _funnel_long(),
        "dim_landing_page": _with("pv", {"f": first_by_time})
        + "SELECT DISTINCT landing_page FROM f WHERE n = 1",
        "dim_date": _with("ws wo wr", calendar)
        + "SELECT date, CAST(year(date) AS INT) AS year, CAST(quarter(date) AS INT) AS quarter, "
        "CAST(month(date) AS INT) AS month, monthname(date) AS month_name, "
        "strftime(date, '%Y-%m') AS year_month FROM span",
        "dim_product": _with("pr")
        + "SELECT product_id, product_name, CAST(created_at AS DATE) AS launch_date FROM pr",
        "dim_channel": _with("ws", {"fs": NAMED_SESSIONS})
        + "SELECT DISTINCT utm_source, utm_campaign, utm_content FROM fs",
        "dim_user": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
        "fact_session": _with("ws") + NAMED_SESSIONS,
        "fact_order": _with("wo")
        + "SELECT order_id, CAST(created_at AS DATE) AS order_date, website_session_id, user_id, price_usd, "
        "cogs_usd FROM wo",
        "fact_order_item": _with("it")
        + "SELECT order_item_id, CAST(created_at AS DATE) AS item_date, order_id, product_id, "
        "is_primary_item = 1 AS is_primary_item, price_usd, cogs_usd FROM it",
        "fact_refund": _with("rf")
        + "SELECT order_item_refund_id, CAST(created_at AS DATE) AS refund_date, order_item_id, order_id, "
        "refund_amount_usd FROM rf",
        # Metric registry
        "metrics_overall": _metrics(list(METRIC_SQL)),
        "metrics_by_source": _metrics(list(METRIC_SQL), "utm_source"),
        "metrics_by_device": _metrics(CHANNEL, "device_type"),
        "new_vs_repeat": _metrics(REPEAT, "device_type"),
        "revenue_by_order_date": _with("od")
        + "SELECT CAST(created_at AS DATE) AS date, count(*) AS total_orders, "
        f"{usd('sum(price_usd)')} AS gross_revenue_order_date, "
        f"{fraction_usd('sum(price_usd)', 'count(*)', True)} AS average_order_value, "
        f"{fraction_usd('sum(price_usd - cogs_usd)', 'sum(price_usd)')} AS gross_margin_rate FROM od GROUP BY 1",
        "product_mix_pct": _product_mix_pct(),
        "refund_order_rate_by_source": _metrics(["refund_order_rate"], "utm_source"),
        "metrics_without_campaign": _metrics(
            CHANNEL, "device_type", "fs.website_session_id IN (SELECT website_session_id FROM ws WHERE utm_content IS NULL OR utm_content = 'ad_1')"
        ),
        "metrics_filtered": _metrics(
            CHANNEL,
            "utm_campaign",
            "device_type = 'desktop' AND utm_source IN ('gsearch', 'bsearch') "
            f"AND session_date BETWEEN DATE '{least}' AND DATE '{most}'",
        ),
        "metrics_by_month": _metrics_over(CHANNEL, ["year_month"], SESSIONS_BY_MONTH),
        "staged_metrics_by_month": _metrics_over(CHANNEL, ["year_month"], SESSIONS_BY_MONTH),
        "staged_metrics_filtered": _metrics(
            STAGED_METRICS,
            "utm_campaign",
            "device_type = 'desktop' AND utm_source IN ('gsearch', 'bsearch') "
            f"AND session_date BETWEEN DATE '{least}' AND DATE '{most}'",
        ),
        "metrics_in_second_quarter": _second_quarter(),
        "revenue_by_order_quarter": _with("od")
        + "SELECT CAST(year(created_at) AS INT) AS year, CAST(quarter(created_at) AS INT) AS quarter, count(*) AS total_orders, "
        f"{usd('sum(price_usd)')} AS gross_revenue_order_date, "
        f"{fraction_usd('sum(price_usd)', 'count(*)', True)} AS average_order_value, "
        f"{fraction_usd('sum(price_usd - cogs_usd)', 'sum(price_usd)')} AS gross_margin_rate FROM od GROUP BY 1, 2",
        "metrics_by_landing_page": _metrics_over(
            CHANNEL, ["landing_page"], "SELECT fs.*, landing_page FROM fs LEFT JOIN landings USING (website_session_id)", {"landings": LANDINGS}
        ),
        "metrics_by_funnel_step": _metrics_over(
            CHANNEL,
            ["funnel_step", "device_type"],
            "SELECT fs.*, funnel_step FROM fs LEFT JOIN reached USING (website_session_id)",
            _funnel_flags() | {"reached": _funnel_long()},
        ),
        "metrics_after_signup": _metrics(
            CHANNEL,
            "utm_source",
            "fs.website_session_id IN (SELECT website_session_id FROM pv WHERE pageview_url IN ('/signup', '/purchase'))",
        ),
        # Reconciliation and documented uses
        "kpi_reconciliation": _reconciliation(),
        "header_line_reconciliation": _header_lines(),
        "refund_consistency": _with("wo wr")
        + "SELECT count(*) AS refunds, count(*) FILTER (WHERE wo.order_id IS NULL) AS refunds_without_line, "
        "count(*) FILTER (WHERE wr.order_id <> wo.order_id) AS order_id_mismatches, "
        "count(*) FILTER (WHERE refund_amount_usd < price_usd) AS partial_refunds, "
        "count(*) FILTER (WHERE refund_amount_usd > price_usd) AS refunds_above_price "
        "FROM wr LEFT JOIN wo ON wo.order_id = wr.order_item_id",
        "landing_rule_agreement": _with("pv", {"x": both_rules})
        + "SELECT count(*) AS sessions, count(*) FILTER (WHERE a IS DISTINCT FROM b) "
        "AS sessions_with_different_landing FROM x",
        "time_to_refund": _with("rf od")
        + "SELECT CAST(date_diff('day', CAST(od.created_at AS DATE), CAST(rf.created_at AS DATE)) AS INT) "
        f"AS days_to_refund, count(*) AS refunds, {usd('sum(refund_amount_usd)')} AS refund_amount "
        "FROM rf JOIN od ON od.order_id = rf.order_id GROUP BY 1",
        "time_to_refund_quantiles": _with("ln od rf", {"told": LINE_DAYS})
        + "SELECT product_id, count(*) AS refunds, quantile_disc(days, 0.5) AS days_p50, "
        "quantile_disc(days, 0.9) AS days_p90 FROM told GROUP BY 1",
        "attach_rate": _attach_rate(),
        "user_cohorts": _with("ws", {"u": users})
        + "SELECT first_week, week, count(DISTINCT user_id) AS users FROM u GROUP BY 1, 2",
        "session_paths": _session_paths(),
        "first_visit_orders": _first_visit_orders(),
        # Sources and sinks
        "sessions_from_csv": _with("ws")
        + "SELECT website_session_id, CAST(date_trunc('second', created_at) AS TIMESTAMP) AS created_at, user_id, "
        "CAST(is_repeat_session AS INT) AS is_repeat_session, utm_source, utm_campaign, utm_content, device_type, "
        "'https://' || utm_source || '.example' AS http_referer FROM ws",
        "orders_from_flawed_csv": _with("od")
        + f"SELECT 'good' AS kind, count(*) AS lines, {usd('sum(price_usd)')} AS revenue FROM od WHERE order_id % 7 <> 0 "
        "UNION ALL SELECT 'price_usd', count(*), NULL FROM od WHERE order_id % 7 = 0 HAVING count(*) > 0",
        "staged_orders_by_month": _with("od")
        + f"SELECT strftime(created_at, '%Y-%m') AS created_month, count(*) AS orders, {usd('sum(price_usd)')} AS revenue "
        f"FROM od WHERE strftime(created_at, '%Y-%m') IS DISTINCT FROM '{REWRITTEN_MONTH}' OR order_id % 2 = 0 GROUP BY 1",
        "latest_sessions": _with("ws")
        + "SELECT website_session_id, created_at, user_id FROM ws ORDER BY created_at DESC, website_session_id DESC LIMIT 50",
        # Tables with flaws
        "pk_nulls_flawed": _flawed_nulls(),
        "fk_orphans_flawed": _flawed_orphans(),
        "refunds_per_item_flawed": _flawed_most(),
        "refund_consistency_flawed": _flawed_consistency(),
        "metrics_lookups_flawed": _flawed_lookups(),
        "orders_before_session_flawed": _flawed_before("wo", "orders_before_session_count"),
        "pageviews_before_session_flawed": _flawed_before("pv", "pageviews_before_session_count"),
    }
