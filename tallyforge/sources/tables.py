"""Named Parquet tables in one folder."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Column types of the tables the queries read. Whole numbers are declared bigint, as
# which files of int can be read too; a file whose types cannot be read as these
# fails.
SCHEMAS = {
    "region": "r_regionkey bigint, r_name string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint",
    "customer": """
        c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string
    """,
    "orders": """
        o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string
    """,
    "lineitem": """
        l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz
    """,
}


class MissingColumns(ValueError):
    """A table lacks columns that a query needs."""


@dataclass(frozen=True)
class ParquetTables:
    """Reads ``<root>/<name>.parquet``, a file or a folder of files.

    Columns that are declared but not stored would be read as nulls, so the stored
    ones are looked up first, in the footer of one file. The files of a folder must
    have the same columns; one that lacks a column the others have gives nulls.
    """

    spark: SparkSession
    root: str

    def read(self, name: str, *columns: str) -> DataFrame:
        """The named columns of a table; raises if one is not stored."""
        return self.read_all({name: columns})[name]

    def read_all(self, wanted: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
        """The named columns of each table; raises if one is not stored.

        Each look at a footer is a small Spark job; those of all tables run at once.
        """
        paths = {name: f"{self.root.rstrip('/')}/{name}.parquet" for name in wanted}
        with ThreadPoolExecutor(len(wanted)) as pool:
            stored = pool.map(lambda path: self.spark.read.parquet(path).columns, paths.values())
            stored = dict(zip(paths, stored))
        for name, columns in wanted.items():
            missing = [c for c in columns if c not in stored[name]]
            if missing:
                raise MissingColumns(
                    f"table {name} at {paths[name]} has no column {', '.join(missing)}"
                )
        return {
            name: self.spark.read.schema(SCHEMAS[name]).parquet(paths[name]).select(*columns)
            for name, columns in wanted.items()
        }

    def __getitem__(self, name: str) -> DataFrame:
        """All declared columns of a table."""
        return self.read(name, *StructType.fromDDL(SCHEMAS[name]).names)
