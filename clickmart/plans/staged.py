"""Metrics from staged partial totals: base totals by day and attributes are stored once, requests add them up.

``stage_totals`` stores one row for each day and combination of attributes, in partitions by day; ``refresh_days``
replaces some days and leaves the others. ``compute_staged`` gives the rows that ``compute`` gives: metrics that add up are
read from the staged rows if these have all groups and filters of the request, all others from the facts.

Numbers of distinct values don't add up and always come from the facts. Attributes along one-to-many relations (funnel
steps) cannot be staged, as their groups overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmart.functions.totals import merge_totals
from clickmart.plans.metrics import (
    BASE,
    METRICS,
    base_names,
    bridge_of,
    calendar_columns,
    check_filters,
    compute,
    fact_groups,
    fact_totals,
    from_totals,
    matches,
    route,
    uses_dates,
)


@dataclass(frozen=True)
class StagedTotals:
    """Where the totals are and what they hold."""

    path: str
    attributes: tuple[str, ...]  # with the date and the columns of the calendar
    metrics: tuple[str, ...]  # base metrics
    date_role: str
    schema: str

    def rows(self, model: Mapping[str, DataFrame]) -> DataFrame:
        spark = next(iter(model.values())).sparkSession
        return spark.read.schema(self.schema).parquet(self.path)


def _marker(fact: str, role: str) -> str:
    """The column that is there in the groups the fact has rows of."""
    return f"_{fact}_by_{role}"


def _day_totals(
    model: Mapping[str, DataFrame], names: Iterable[str], by: tuple[str, ...], filters: Mapping[str, Any], date_role: str
) -> DataFrame:
    parts = []
    for (fact, role), group in fact_groups(names, True, date_role).items():
        part = fact_totals(model, group, by, filters, role)
        parts.append(part.withColumn(_marker(fact, role), F.lit(1).cast("bigint")))
    return merge_totals(parts, by)


def _store(rows: DataFrame, path: str, **options: str) -> None:
    rows.hint("rebalance", "date").write.mode("overwrite").options(**options).partitionBy("date").parquet(path)


def stage_totals(
    model: Mapping[str, DataFrame], path: str, attributes: Iterable[str] = (), date_role: str = "session"
) -> StagedTotals:
    """Store the totals by day and ``attributes``; what is at ``path`` is replaced.

    All base metrics are staged that add up, whose fact is there and reaches the date of ``date_role`` and every attribute.
    """
    attributes = tuple(attributes)
    if overlapping := [name for name in attributes if bridge_of(model, name)]:
        raise ValueError(f"{overlapping} cannot be staged: their groups overlap")
    by = ("date", *calendar_columns(model), *attributes)

    def adds_up(name: str, role: str) -> bool:
        fact = BASE[name].fact
        if BASE[name].distinct or fact not in model:
            return False
        columns = [*attributes, f"{role}_date", *([BASE[name].flag] if BASE[name].flag else [])]
        return all(route(model, fact, column) is not None for column in columns)

    names = [name for name in base_names(METRICS) if adds_up(name, BASE[name].date_role or date_role)]
    if not names:
        raise ValueError(f"no fact reaches all of {[*attributes, f'{date_role}_date']}")
    rows = _day_totals(model, names, by, {}, date_role)
    _store(rows, path)
    columns = [field for field in rows.schema if field.name != "date"] + [rows.schema["date"]]
    told = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in columns)
    return StagedTotals(path, by, tuple(names), date_role, told)


def refresh_days(model: Mapping[str, DataFrame], staged: StagedTotals, days: Iterable[date | None]) -> None:
    """Stage ``days`` (None: rows without the date) again and leave all others as they are.

    A day has changed if a row of any fact has, or a row that it hangs on: a session with another device changes the days
    of its orders in the metric that goes by their own date. A day that has lost all its rows keeps a single empty one,
    which no request reads.
    """
    days = list(dict.fromkeys(days))
    rows = _day_totals(model, staged.metrics, staged.attributes, {"date": days}, staged.date_role)
    asked = rows.sparkSession.createDataFrame([(day,) for day in days], "date date")
    both = rows.unionByName(asked, allowMissingColumns=True)
    _store(both, staged.path, partitionOverwriteMode="dynamic")


def covered(
    model: Mapping[str, DataFrame],
    staged: StagedTotals,
    metrics: Iterable[str],
    by: Iterable[str] = (),
    filters: Iterable[str] = (),
    date_role: str = "session",
) -> list[str]:
    """The base metrics of a request that the staged totals can answer: none if they lack one of its attributes."""
    if not {*by, *filters} <= set(staged.attributes):
        return []
    if uses_dates(model, by, filters) and date_role != staged.date_role:
        return []
    return [name for name in base_names(metrics) if name in staged.metrics]


def compute_staged(
    model: Mapping[str, DataFrame],
    staged: StagedTotals,
    metrics: Iterable[str] = METRICS,
    by: Iterable[str] = (),
    filters: Mapping[str, Any] | None = None,
    date_role: str = "session",
) -> DataFrame:
    """``compute`` with as much from the staged totals as they cover."""
    metrics, by, filters = tuple(metrics), tuple(by), dict(filters or {})
    ready = covered(model, staged, metrics, by, filters, date_role)
    if not ready:
        return compute(model, metrics, by, filters, date_role)
    check_filters(model, filters, date_role)
    rows = staged.rows(model)
    there = [F.col(_marker(fact, role)).isNotNull() for fact, role in fact_groups(ready, True, staged.date_role)]
    rows = rows.where(reduce(or_, there))
    for name, wanted in filters.items():
        rows = rows.where(matches(name, wanted))
    parts = [rows.select(*by, *ready)]
    rest = [name for name in base_names(metrics) if name not in ready]
    for (_, role), names in fact_groups(rest, uses_dates(model, by, filters), date_role).items():
        parts.append(fact_totals(model, names, by, filters, role))
    return from_totals(model, merge_totals(parts, by), metrics, by)
