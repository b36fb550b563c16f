import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from clickmart.functions.ratios import fraction, pct, per
from tests.conftest import rows


def test_ties_are_rounded_away_from_zero(spark):
    df = spark.createDataFrame([(1, 800), (-1, 800), (29, 20000), (3, 8)], "n long, d long")
    assert [r[0] for r in rows(df.select(pct(F.col("n"), F.col("d"))))] == [
        Decimal("0.13"),  # 0.125
        Decimal("-0.13"),
        Decimal("0.15"),  # 0.145, which is below the tie as a double
        Decimal("37.50"),
    ]


def test_money_ratio(spark):
    df = spark.createDataFrame([(Decimal("0.29"), 2), (Decimal("-0.29"), 2)], "m decimal(12,2), d long")
    assert [r[0] for r in rows(df.select(per(F.col("m"), F.col("d"))))] == [Decimal("0.15"), Decimal("-0.15")]


def test_zero_and_missing_denominators_give_null(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "n long, d long")
    for form in (pct, per, fraction):
        assert [r[0] for r in rows(df.select(form(F.col("n"), F.col("d"))))] == [None, None, None]


def test_random_pairs_agree_with_exact_arithmetic(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(-(10**6), 10**6), rng.choice([7, 8, 80, 800, 9999, 10**9])) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "n long, d long")
    found = rows(df.select("n", "d", pct(F.col("n"), F.col("d")), fraction(F.col("n"), F.col("d"))))
    for n, d, percent, share in found:
        exact = Decimal(n) / Decimal(d)
        assert percent == (exact * 100).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert share == exact.quantize(Decimal("0.000001"), ROUND_HALF_UP)


def test_totals_beyond_the_short_decimal_range(spark):
    """Revenue of 10**17 dollars, as 100 TB of order lines may hold, neither overflows nor loses cents."""
    df = spark.createDataFrame([(Decimal("123456789012345678.91"), 3 * 10**12)], "m decimal(22,2), d long")
    assert rows(df.select(per(F.col("m"), F.col("d")), pct(F.col("m"), F.col("m")))) == [
        (Decimal("41152.26"), Decimal("100.00"))
    ]
