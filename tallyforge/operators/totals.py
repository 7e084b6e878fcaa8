"""Exact sums of whole-number amounts, added up in several steps.

A sum of bigints can overflow and a wide decimal sum is slow, so an amount is
split into a high and a low part that are summed apart as bigints. With amounts
under 2**40 both parts of a row are under 2**20, so up to 2**43 rows fit, however
they are grouped. A sum beyond that raises an error, in ANSI mode and without it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_BITS = 20
PARTS = ("amount_high", "amount_low", "n")


def _checked_sum(part: Column) -> Column:
    """Sum of a bigint that is null only over nulls, and never wraps around."""
    overflow = F.raise_error(F.lit("a sum of amounts is out of the range of bigint"))
    return F.when(F.count(part) > 0, F.coalesce(F.try_sum(part), overflow.cast("bigint")))


def sum_rows(df: DataFrame, key: str, amount: Column) -> DataFrame:
    """Per key, the sum of a bigint amount in parts and the count of rows."""
    return (
        df.select(key, amount.alias("amount"))
        .groupBy(key)
        .agg(
            _checked_sum(F.shiftright("amount", LOW_BITS)).alias("amount_high"),
            _checked_sum(F.col("amount").bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias(
                "amount_low"
            ),
            F.count("*").alias("n"),
        )
    )


def add_up(sums: DataFrame, key: str) -> DataFrame:
    """Sums under a coarser key from those of :func:`sum_rows`, still exact."""
    return sums.groupBy(key).agg(*(_checked_sum(F.col(part)).alias(part) for part in PARTS))


def total_amount(scale: int, precision: int = 28) -> Column:
    """The summed parts as decimal(precision, scale), for amounts in 10**-scale."""
    whole = F.col("amount_high").cast("decimal(20,0)") * (1 << LOW_BITS) + F.col("amount_low")
    return (whole * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")
