import pytest

from conftest import TESTDATA
from tallyforge.plans import region_revenue
from tallyforge.sources import MissingColumns, ParquetTables
from tallyforge.sources.tables import SCHEMAS


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_columns_are_those_of_the_files(spark, name, sf):
    stored = spark.read.parquet(f"{TESTDATA}/{sf}/{name}.parquet")
    wider = [(column, "bigint" if kind == "int" else kind) for column, kind in stored.dtypes]
    assert ParquetTables(spark, f"{TESTDATA}/{sf}/")[name].dtypes == wider


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_types_keep_the_values(spark, name):
    root = f"{TESTDATA}/sf0.001"
    stored = spark.read.parquet(f"{root}/{name}.parquet")
    declared = ParquetTables(spark, root)[name]
    assert sorted(map(tuple, declared.collect())) == sorted(map(tuple, stored.collect()))


def test_unlike_types_fail(spark, tmp_path):
    path = tmp_path / "region.parquet"
    spark.createDataFrame([("0", "NORTH")], "r_regionkey string, r_name string").write.parquet(str(path))
    with pytest.raises(Exception, match="FAILED_READ_FILE|PARQUET"):
        ParquetTables(spark, str(tmp_path))["region"].collect()


def test_table_may_be_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"R{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "r_regionkey int, r_name string")
    df.repartition(4).write.parquet(str(tmp_path / "region.parquet"))
    assert sorted(map(tuple, ParquetTables(spark, str(tmp_path))["region"].collect())) == rows


@pytest.mark.parametrize("table, column", [("lineitem", "l_discount"), ("orders", "o_orderdate"),
                                           ("region", "r_name"), ("customer", "c_nationkey")])
def test_a_missing_column_raises(spark, tmp_path, table, column):
    for name in SCHEMAS:
        df = spark.read.parquet(f"{TESTDATA}/sf0.001/{name}.parquet")
        if name == table:
            df = df.withColumnRenamed(column, column + "_renamed")
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    tables = ParquetTables(spark, str(tmp_path))
    with pytest.raises(MissingColumns, match=f"{table} .*{column}"):
        region_revenue(tables, "1996-01-01", "1997-01-01")
    with pytest.raises(MissingColumns, match=f"{table} .*{column}"):
        tables[table]


def test_only_the_columns_asked_for_are_needed(spark, tmp_path):
    df = spark.createDataFrame([("NORTH",)], "r_name string")
    df.write.parquet(str(tmp_path / "region.parquet"))
    tables = ParquetTables(spark, str(tmp_path))
    assert [tuple(r) for r in tables.read("region", "r_name").collect()] == [("NORTH",)]
