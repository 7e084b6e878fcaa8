"""Exact amounts from money and rates stored as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# decimal(p, 2) types the stored doubles stand for.
PRICE_PRECISION = 12
RATE_PRECISION = 4


def hundredths(value: Column, precision: int) -> Column:
    """``value`` as a whole number of hundredths, rounded as decimal(precision, 2).

    Spark casts a double to a decimal by way of its text, which costs far more
    than the rest of the row. A double that already lies at a whole number of
    hundredths cannot round to any other, so only the rest take the cast. NaN,
    infinity and values that round out of range are among the rest, so they give
    null or fail just as the cast does.

    Values that are no whole hundredths round half up by their decimal text, so
    1.005 gives 101, although the double lies a little under it. Engines that round
    the double itself give 100.
    """
    scaled = value * 100
    nearest = F.rint(scaled)
    is_whole = (F.abs(scaled - nearest) < 1e-3) & (F.abs(nearest) < 10.0**precision)
    rounded = value.cast(f"decimal({precision},2)") * 100
    return F.when(is_whole, nearest.cast("bigint")).otherwise(rounded.cast("bigint"))


def discounted_amount(price: Column, discount: Column) -> Column:
    """``price * (1 - discount)`` as a whole number of ten-thousandths."""
    return hundredths(price, PRICE_PRECISION) * (100 - hundredths(discount, RATE_PRECISION))
