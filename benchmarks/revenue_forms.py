"""Compares forms of the revenue query on tables that Spark derives from given ones.

    python benchmarks/revenue_forms.py SOURCE_FOLDER SCRATCH_FOLDER [TIMES [CORES]]

SOURCE_FOLDER holds the tables, SCRATCH_FOLDER takes the derived ones and the event
logs. Orders and lines are multiplied by TIMES, and laid out scattered or clustered by
order; a third case puts a third of all lines on one order. Prints a row of Markdown
for each case and form: seconds of the best of three runs, MB shuffled, and rows read
by the largest and the median task after a shuffle.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tallyforge.functions import discounted_amount  # noqa: E402
from tallyforge.operators import add_up, sum_rows, total_amount  # noqa: E402
from tallyforge.plans import region_revenue  # noqa: E402
from tallyforge.session import local_session  # noqa: E402
from tallyforge.sources import ParquetTables  # noqa: E402

PERIODS = {"year": ("1996-01-01", "1997-01-01"), "day": ("1996-07-04", "1996-07-05")}
LAYOUTS = ("scattered", "clustered", "hot order")


def derive(spark, source: str, scratch: str, times: int) -> dict[str, str]:
    """Folders of the derived tables by layout."""
    copies = spark.range(times).withColumnRenamed("id", "copy")
    step = 10_000_000
    orders = spark.read.parquet(f"{source}/orders.parquet").crossJoin(copies)
    orders = orders.withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * step)
    lines = spark.read.parquet(f"{source}/lineitem.parquet").crossJoin(copies)
    lines = lines.withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy") * step)
    hot = F.when(F.rand(1) < 1 / 3, F.lit(1).cast("bigint")).otherwise(F.col("l_orderkey"))
    forms = {
        "scattered": lines.drop("copy").repartition(32),
        "clustered": lines.drop("copy").repartitionByRange(32, "l_orderkey").sortWithinPartitions("l_orderkey"),
        "hot order": lines.withColumn("l_orderkey", hot).drop("copy").repartition(32),
    }
    folders = {}
    for layout, table in forms.items():
        folders[layout] = folder = f"{scratch}/{layout.replace(' ', '_')}"
        table.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
        orders.drop("copy").write.mode("overwrite").parquet(f"{folder}/orders.parquet")
        for name in ("region", "nation", "customer"):
            spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").parquet(
                f"{folder}/{name}.parquet"
            )
    return folders


def join_first(tables: ParquetTables, start: str, end: str):
    """The same result with orders joined to lines before anything is summed."""
    ordered = F.col("o_orderdate")
    orders = tables.read("orders", "o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.filter(ordered >= F.lit(start).cast("timestamp_ntz"))
    orders = orders.filter(ordered < F.lit(end).cast("timestamp_ntz"))
    lines = tables.read("lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = discounted_amount(F.col("l_extendedprice"), F.col("l_discount"))
    sums = sum_rows(joined, "o_custkey", amount)
    customer = tables.read("customer", "c_custkey", "c_nationkey")
    nation = tables.read("nation", "n_nationkey", "n_regionkey")
    region = tables.read("region", "r_regionkey", "r_name")
    sums = add_up(sums.join(customer, F.col("o_custkey") == F.col("c_custkey")), "c_nationkey")
    sums = sums.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = add_up(sums.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "r_name")
    return sums.select("r_name", total_amount(4).alias("revenue"), "n")


FORMS = {
    "sums first": (region_revenue, "10GB"),
    "sums first, runtime filter": (region_revenue, "0"),
    "join first": (join_first, "0"),
}


def logged(folder: str, since: float, until: float) -> tuple[float, int, int]:
    """MB shuffled, and rows of the largest and the median reading task, from the log."""
    shuffled, rows = 0.0, []
    (log,) = os.listdir(folder)
    for line in open(f"{folder}/{log}", errors="replace"):
        if '"SparkListenerTaskEnd"' in line:
            e = json.loads(line)
            if since <= e["Task Info"]["Launch Time"] / 1000 <= until:
                m = e["Task Metrics"]
                shuffled += m["Shuffle Write Metrics"]["Shuffle Bytes Written"] / 1e6
                if n := m["Shuffle Read Metrics"]["Total Records Read"]:
                    rows.append(n)
    return shuffled, max(rows, default=0), int(statistics.median(rows or [0]))


def main(source: str, scratch: str, times: int = 10, cores: int = 8) -> None:
    events = f"{scratch}/events"
    os.makedirs(events)
    spark = local_session(
        cores,
        spark__sql__shuffle__partitions="32",
        spark__sql__autoBroadcastJoinThreshold="1m",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="4m",
        spark__ui__showConsoleProgress="false",
        spark__eventLog__enabled="true",
        spark__eventLog__dir=f"file://{events}",
        spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false",
        spark__eventLog__buffer__kb="1k",
    )
    spark.sparkContext.setLogLevel("ERROR")
    folders = derive(spark, source, scratch, times)
    limit = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    print("| Lines | Period | AQE | Form | Seconds | Shuffled MB | Rows of largest, median task |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for layout in LAYOUTS:
        for period, bounds in PERIODS.items():
            for adaptive in ("true", "false"):
                results = set()
                for form, (query, threshold) in FORMS.items():
                    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
                    spark.conf.set(limit, threshold)
                    runs = []
                    for _ in range(3):
                        since = time.time()
                        df = query(ParquetTables(spark, folders[layout]), *bounds)
                        rows = df.collect()
                        runs.append((time.time() - since, since, time.time()))
                    results.add(repr(sorted(map(tuple, rows), key=repr)))
                    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
                    took, since, until = min(runs)
                    mb, most, middle = logged(events, since, until)
                    print(f"| {layout} | {period} | {'on' if adaptive == 'true' else 'off'} | {form} | "
                          f"{took:.2f} | {mb:.1f} | {most}, {middle} |", flush=True)  # fmt: skip
                assert len(results) == 1, "the forms differ"
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3], *map(int, sys.argv[3:]))
