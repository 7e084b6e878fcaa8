from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import add_up, sum_rows, total_amount

BIGINT_MAX = 2**63 - 1


def totals(df, key):
    return {r[key]: (r.total, r.n) for r in df.withColumn("total", total_amount(4)).collect()}


def test_sum_beyond_bigint_is_exact(spark):
    # Nine times the largest bigint: a plain sum of bigints overflows.
    df = spark.range(9).select(F.lit(1).alias("k"), F.lit(BIGINT_MAX).alias("amount"))
    summed = sum_rows(df, "k", F.col("amount"))
    assert totals(summed, "k") == {1: (Decimal(9 * BIGINT_MAX).scaleb(-4), 9)}


def test_negative_and_null_amounts(spark):
    df = spark.createDataFrame(
        [(1, -5), (1, 3), (1, None), (2, None), (3, -(2**40)), (3, -1)], "k int, amount bigint"
    )
    summed = sum_rows(df, "k", F.col("amount"))
    assert totals(summed, "k") == {
        1: (Decimal("-0.0002"), 3),
        2: (None, 1),
        3: (Decimal(-(2**40) - 1).scaleb(-4), 2),
    }


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("part", ["amount_high", "amount_low", "n"])
def test_a_sum_out_of_range_raises(spark, conf, ansi, part):
    conf(spark__sql__ansi__enabled=ansi)
    parts = {"amount_high": 1, "amount_low": 1, "n": 1} | {part: 2**62}
    df = spark.createDataFrame(
        [(1, *parts.values())] * 2, "k int, amount_high bigint, amount_low bigint, n bigint"
    )
    assert totals(add_up(df.limit(1), "k"), "k")[1][1] == parts["n"]
    with pytest.raises(Exception, match="out of the range of bigint"):
        add_up(df, "k").collect()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_adding_up_keeps_nulls(spark, conf, ansi):
    conf(spark__sql__ansi__enabled=ansi)
    df = spark.createDataFrame(
        [(1, None, None, 2), (1, None, None, 3), (2, None, None, 1), (2, 0, 5, 1)],
        "k int, amount_high bigint, amount_low bigint, n bigint",
    )
    assert totals(add_up(df, "k"), "k") == {1: (None, 5), 2: (Decimal("0.0005"), 2)}


amounts = st.lists(
    st.tuples(st.integers(0, 9), st.integers(-(2**62), 2**62)), min_size=1, max_size=60
)


@settings(max_examples=10, deadline=None)
@given(amounts)
def test_adding_up_in_steps_equals_one_sum(spark, rows):
    df = spark.createDataFrame(rows, "fine int, amount bigint")
    fine = sum_rows(df, "fine", F.col("amount"))
    coarse = add_up(fine.withColumn("coarse", F.col("fine") % 3), "coarse")

    expected = {}
    for key, amount in rows:
        total, n = expected.get(key % 3, (0, 0))
        expected[key % 3] = (total + amount, n + 1)
    assert totals(coarse, "coarse") == {
        key: (Decimal(total).scaleb(-4), n) for key, (total, n) in expected.items()
    }
