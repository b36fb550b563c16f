"""Money, percentages and ratios. All divisions of the library happen here.

Values are exact decimals with an explicit precision and are rounded half away from zero. A zero or missing
denominator gives NULL. The money type leaves room for 10**20 dollars, so sums over very large facts do not overflow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(22,2)"
RATE = "decimal(18,2)"
FRACTION = "decimal(18,6)"


def money(amount: Column | str) -> Column:
    return F.col(amount).cast(MONEY) if isinstance(amount, str) else amount.cast(MONEY)


def money_or_zero(amount: Column | str) -> Column:
    return F.coalesce(money(amount), F.lit(Decimal("0.00")).cast(MONEY))


def count_or_zero(count: Column | str) -> Column:
    return F.coalesce(F.col(count) if isinstance(count, str) else count, F.lit(0)).cast("bigint")


def _divide(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def per(amount: Column, count: Column) -> Column:
    """``amount / count`` to two decimals, e.g. revenue per session."""
    return F.round(_divide(money(amount), count), 2).cast(RATE)


def pct(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole`` to two decimals."""
    return F.round(_divide(money(part) * 100, whole), 2).cast(RATE)


def fraction(part: Column, whole: Column) -> Column:
    """``part / whole`` to six decimals, for metrics that are fractions instead of percentages."""
    return F.round(_divide(money(part), whole), 6).cast(FRACTION)


def share_of(count: Column, share: float) -> Column:
    """``count`` times a share given as a decimal fraction, exactly."""
    return count * F.lit(Decimal(str(share)))
