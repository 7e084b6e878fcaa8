import datetime as dt
import re
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import TESTDATA
from tallyforge.plans import region_revenue
from tallyforge.sources import ParquetTables

NAME = "region_revenue"
ROOT = f"{TESTDATA}/sf0.01"
YEAR = ("1996-01-01", "1997-01-01")
TABLES = ("region", "nation", "customer", "orders", "lineitem")


def by_name(rows):
    return sorted(map(tuple, rows), key=lambda row: (row[0] is None, row[0]))


def result(spark, root, period=YEAR):
    return by_name(region_revenue(ParquetTables(spark, str(root)), *period).collect())


def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def small(spark, tmp_path):
    """Tables small enough to add up by hand, with rows that must drop out."""
    rows = {
        "region": ([(0, "NORTH"), (1, "SOUTH"), (2, "EMPTY")], "r_regionkey int, r_name string"),
        "nation": (
            [(0, "A", 0), (1, "B", 0), (2, "C", 1)],
            "n_nationkey int, n_name string, n_regionkey int",
        ),
        # Customer 13 has no nation.
        "customer": ([(10, 0), (11, 1), (12, 2), (13, 99)], "c_custkey bigint, c_nationkey int"),
        # On the first day, in the year, on the day after, before it, of no customer.
        "orders": (
            [
                (100, 10, day("1996-01-01")),
                (101, 11, day("1996-07-04")),
                (102, 12, day("1996-12-31")),
                (103, 12, day("1997-01-01")),
                (104, 10, day("1995-12-31")),
                (105, 13, day("1996-05-05")),
                (106, 77, day("1996-05-05")),
                (107, None, day("1996-05-05")),
                (108, 10, None),
            ],
            "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
        ),
        # Order 999 does not exist; a null price counts as a row and adds nothing.
        "lineitem": (
            [(key, 100.01 + key, 0.07) for key in range(100, 109) for _ in range(3)]
            + [(999, 5.0, 0.0), (None, 5.0, 0.0), (101, None, 0.05), (101, -20.5, 0.1)],
            "l_orderkey bigint, l_extendedprice double, l_discount double",
        ),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return tmp_path, {name: data for name, (data, _) in rows.items()}


def test_against_brute_force(spark, small):
    root, rows = small
    expected = defaultdict(lambda: [Decimal(0), 0])
    for orderkey, price, discount in rows["lineitem"]:
        for key, custkey, date in rows["orders"]:
            if key != orderkey or date is None or not day(YEAR[0]) <= date < day(YEAR[1]):
                continue
            for c_key, c_nation in rows["customer"]:
                for n_key, _, n_region in rows["nation"]:
                    for r_key, r_name in rows["region"]:
                        if (c_key, n_key, r_key) == (custkey, c_nation, n_region):
                            if price is not None:
                                amount = Decimal(str(round(price, 2))) * (1 - Decimal(str(discount)))
                                expected[r_name][0] += amount
                            expected[r_name][1] += 1
    assert sorted(expected) == ["NORTH", "SOUTH"]
    assert result(spark, root) == sorted((k, v, n) for k, (v, n) in expected.items())


def test_oracle_agrees_on_small_tables(spark, duck, small):
    root, _ = small
    expected = duck(str(root), contract.oracle_sql()[NAME]).fetchall()
    assert result(spark, root) == sorted(expected)


@pytest.mark.parametrize("seed", range(4))
def test_random_tables_with_repeated_and_missing_keys(spark, duck, tmp_path, seed):
    """Summing before a join must multiply rows just as the join does."""
    rng = np.random.default_rng(seed)

    def keys(count, upto):
        """Keys that repeat, leave gaps and are null now and then."""
        drawn = pd.Series(rng.integers(0, upto, count), dtype="Int64")
        return drawn.mask(rng.random(count) < 0.05)

    days = rng.integers(0, 1000, 60).astype("timedelta64[D]")
    tables = {
        "region": {"r_regionkey": keys(4, 4), "r_name": ["N", "S", "S", None]},
        "nation": {"n_nationkey": keys(8, 6), "n_regionkey": keys(8, 5)},
        "customer": {"c_custkey": keys(30, 20), "c_nationkey": keys(30, 7)},
        "orders": {
            "o_orderkey": keys(60, 40),
            "o_custkey": keys(60, 25),
            "o_orderdate": (np.datetime64("1995-01-01", "us") + days),
        },
        "lineitem": {
            "l_orderkey": keys(400, 45),
            "l_extendedprice": rng.integers(-(10**6), 10**7, 400) / 100,
            "l_discount": rng.integers(0, 101, 400) / 100,
        },
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    expected = duck(str(tmp_path), contract.oracle_sql()[NAME]).fetchall()
    assert expected
    assert result(spark, tmp_path) == by_name(expected)


def test_empty_period(spark):
    assert result(spark, ROOT, ("2030-01-01", "2031-01-01")) == []


def test_years_add_up_to_the_whole(spark):
    parts = [result(spark, ROOT, (f"{y}-01-01", f"{y + 1}-01-01")) for y in range(1995, 2002)]
    whole = defaultdict(lambda: [Decimal(0), 0])
    for rows in parts:
        for name, revenue, n in rows:
            whole[name][0] += revenue
            whole[name][1] += n
    assert sum(n for _, n in whole.values()) == ParquetTables(spark, ROOT)["lineitem"].count()
    assert result(spark, ROOT, ("1995-01-01", "2002-01-01")) == sorted(
        (k, v, n) for k, (v, n) in whole.items()
    )


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_same_result_whatever_joins_spark_picks(spark, duck, conf, adaptive, threshold):
    conf(
        spark__sql__adaptive__enabled=adaptive,
        spark__sql__autoBroadcastJoinThreshold=threshold,
    )
    assert result(spark, ROOT) == sorted(duck(ROOT, contract.oracle_sql()[NAME]).fetchall())


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_same_result_in_any_time_zone_and_mode(spark, conf, zone, ansi):
    expected = result(spark, ROOT)
    conf(spark__sql__session__timeZone=zone, spark__sql__ansi__enabled=ansi)
    assert result(spark, ROOT) == expected


@pytest.fixture
def hot(spark, tmp_path):
    """The given tables, with a third of the lines on one order of the year and
    a third of the orders with one customer."""
    tables = ParquetTables(spark, ROOT)
    in_year = F.col("o_orderdate").between(day("1996-01-01"), day("1996-12-31"))
    key = tables["orders"].filter(in_year).agg(F.min("o_orderkey")).first()[0]
    changed = {
        "lineitem": tables["lineitem"].withColumn(
            "l_orderkey",
            F.when(F.col("l_partkey") % 3 == 0, F.lit(key)).otherwise(F.col("l_orderkey")),
        ),
        "orders": tables["orders"].withColumn(
            "o_custkey",
            F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey")),
        ),
    }
    for name in TABLES:
        df = changed.get(name, tables[name])
        df.repartition(8).write.parquet(str(tmp_path / f"{name}.parquet"))
    return tmp_path


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_hot_keys(spark, duck, conf, hot, adaptive):
    conf(spark__sql__adaptive__enabled=adaptive, spark__sql__autoBroadcastJoinThreshold="-1")
    rows = result(spark, hot)
    assert sum(n for _, _, n in rows) > 20_000
    assert rows == sorted(duck(str(hot), contract.oracle_sql()[NAME]).fetchall())


def test_scans_read_only_what_is_needed(spark, plan_of):
    plan = plan_of(contract.queries()[NAME](spark, ROOT), "formatted")
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    columns = {tuple(c.split(":")[0] for c in s.split(",")) for s in schemas}
    assert columns == {
        ("l_orderkey", "l_extendedprice", "l_discount"),
        ("o_orderkey", "o_custkey", "o_orderdate"),
        ("c_custkey", "c_nationkey"),
        ("n_nationkey", "n_regionkey"),
        ("r_regionkey", "r_name"),
    }
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in plan


def test_tables_of_any_size_are_combined_before_each_shuffle(spark, conf, plan_of):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    plan = plan_of(contract.queries()[NAME](spark, ROOT))
    assert "Broadcast" not in plan and "Cartesian" not in plan and "Python" not in plan

    below = dict(re.findall(r"Exchange hashpartitioning\((\w+)#.*\n(.*)", plan))
    for key in ("l_orderkey", "o_custkey", "c_nationkey", "r_name"):
        assert "HashAggregate" in below[key] and "partial_try_sum" in below[key], plan
    # The other sides are shuffled once, on their unique keys.
    assert plan.count("Exchange hashpartitioning(o_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(c_custkey") == 1
    # The sums per order reach the join with no shuffle of their own.
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1
