from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tallyforge.functions import discounted_amount, hundredths


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def check_as_cast(spark, values, precision):
    """hundredths() must agree with Spark's own cast to decimal on every value."""
    rows = (
        doubles(spark, values)
        .select(
            "v",
            hundredths(F.col("v"), precision).alias("fast"),
            (F.col("v").cast(f"decimal({precision},2)") * 100).cast("bigint").alias("cast"),
        )
        .collect()
    )
    assert [r for r in rows if r.fast != r["cast"]] == []


def test_every_cent_up_to_a_million(spark):
    cents = spark.range(0, 100_000_000, 37)
    wrong = cents.filter(hundredths(F.col("id") / 100, 12) != F.col("id"))
    assert wrong.count() == 0


@pytest.mark.parametrize(
    "value",
    [0.0, -0.0, 0.005, 0.015, 1.005, 2.675, -1.005, 0.125, 0.00999999, 901.82, 104997.88,
     1e-9, 0.0049999999, 9999999999.99, -9999999999.99, 123456789.125, None],
)
def test_rounds_as_the_cast_does(spark, value):
    check_as_cast(spark, [value], 12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-9.9e9, 9.9e9), min_size=50, max_size=200))
def test_any_double_rounds_as_the_cast_does(spark, values):
    check_as_cast(spark, values, 12)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(10**12) + 1, 10**12 - 1), min_size=50, max_size=200))
def test_any_cents_are_kept(spark, cents):
    check_as_cast(spark, [c / 100 for c in cents], 12)


@pytest.mark.parametrize(
    "value", [1e10, -1e10, 9999999999.999, 9999999999.999998, -9999999999.999998]
)
def test_out_of_range_fails_as_the_cast_does(spark, value):
    df = doubles(spark, [value])
    with pytest.raises(ArithmeticException):
        df.select(F.col("v").cast("decimal(12,2)")).collect()
    with pytest.raises(ArithmeticException):
        df.select(hundredths(F.col("v"), 12)).collect()


@pytest.mark.parametrize("value", [99.999995, -99.999995, 99.995, 100.0])
def test_out_of_range_of_a_rate_fails_as_the_cast_does(spark, value):
    df = doubles(spark, [value])
    with pytest.raises(ArithmeticException):
        df.select(F.col("v").cast("decimal(4,2)")).collect()
    with pytest.raises(ArithmeticException):
        df.select(hundredths(F.col("v"), 4)).collect()


def test_parts_of_a_cent_round_half_up_by_their_text(spark):
    values = [1.005, -1.005, 2.675, 0.015, 1.0049999, 8.345]
    rows = doubles(spark, values).select(hundredths(F.col("v"), 12).alias("h")).collect()
    assert [r.h for r in rows] == [101, -101, 268, 2, 100, 835]


def test_no_number_gives_null_as_the_cast_does(spark):
    values = [float("inf"), float("-inf"), float("nan")]
    check_as_cast(spark, values, 12)
    rows = doubles(spark, values).select(hundredths(F.col("v"), 12)).collect()
    assert [r[0] for r in rows] == [None, None, None]


def test_discounted_amount(spark):
    df = spark.createDataFrame(
        [(901.82, 0.07), (104997.88, 0.0), (10.0, 1.0), (None, 0.1), (5.0, None)],
        "p double, d double",
    )
    got = [r[0] for r in df.select(discounted_amount(F.col("p"), F.col("d"))).collect()]
    by_hand = int(Decimal("901.82") * Decimal("0.93") * 10000)
    assert got == [by_hand, 1049978800, 0, None, None]
