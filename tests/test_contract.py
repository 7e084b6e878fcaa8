"""Every registered query against its SQL oracle, on the given tables."""

import pytest

import __spark_entry__ as contract
from conftest import TESTDATA

# Spark type names of the oracle's column types, where they differ.
SPARK_TYPE = {"VARCHAR": "string"}


# Queries of the training-data package have their own tests.
OWN = sorted(set(contract.queries()) - set(contract.LLM_QUERIES))


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["r_name", "revenue", "n"]
    assert df.count() == 5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, duck, name, sf):
    root = f"{TESTDATA}/{sf}"
    df = contract.queries()[name](spark, root)
    expected = duck(root, contract.oracle_sql()[name])

    expected_types = [SPARK_TYPE.get(str(t), str(t).lower()) for t in expected.types]
    assert df.dtypes == list(zip(expected.columns, expected_types))
    assert sorted(map(tuple, df.collect())) == sorted(expected.fetchall())
