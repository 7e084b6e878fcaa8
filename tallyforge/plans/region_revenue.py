"""Revenue by region for the orders of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import discounted_amount
from tallyforge.operators import add_up, sum_rows, total_amount
from tallyforge.sources import ParquetTables

# Amounts are products of two values in hundredths.
AMOUNT_SCALE = 4
COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_extendedprice", "l_discount"),
    "customer": ("c_custkey", "c_nationkey"),
    "nation": ("n_nationkey", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
}


def region_revenue(tables: ParquetTables, start: str, end: str) -> DataFrame:
    """``r_name, revenue, n`` over orders dated in [start, end).

    The sums are added up before each join, from order to customer to nation to
    region. Every shuffle therefore carries either sums combined map-side or a
    table's unique key, so a key that holds a large share of the rows meets no
    task with more than one row per map task for it. No join is hinted: Spark
    broadcasts a side only if its size is under autoBroadcastJoinThreshold.

    Orders of other periods are summed too before they drop out. Spark's runtime
    filter keeps most of them out of the shuffle where its settings let it; the
    README has the figures.
    """
    read = tables.read_all(COLUMNS)
    # The columns are timestamps without zone; a plain literal would cast them
    # and keep the filter out of the Parquet scan.
    ordered = F.col("o_orderdate")
    orders = (
        read["orders"]
        .filter(ordered >= F.lit(start).cast("timestamp_ntz"))
        .filter(ordered < F.lit(end).cast("timestamp_ntz"))
    )
    per_order = sum_rows(
        read["lineitem"],
        "l_orderkey",
        discounted_amount(F.col("l_extendedprice"), F.col("l_discount")),
    )
    per_customer = add_up(
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey"
    )
    per_nation = add_up(
        per_customer.join(read["customer"], F.col("o_custkey") == F.col("c_custkey")), "c_nationkey"
    )
    per_region = add_up(
        per_nation.join(read["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(
            read["region"], F.col("n_regionkey") == F.col("r_regionkey")
        ),
        "r_name",
    )
    return per_region.select("r_name", total_amount(AMOUNT_SCALE).alias("revenue"), "n")
