"""Every registered query with an oracle SQL equals DuckDB on sf0.001 (rows + values)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    info = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir, verbose=True)
    if SQL.get(name) is None:
        assert info["rows"] > 0  # values: tests/test_metrics.py, test_retrieval.py, test_samplers.py, llm/
    else:
        assert info["ok"], info


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"dataset", "metric", "mean", "n"}
