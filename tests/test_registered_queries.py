import pytest

import __spark_entry__ as entry_module
from oracle_compare import compare, connect

QUERIES = entry_module.queries()
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_check_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        # A single day or month of the smallest data may hold no completed order.
        may_be_empty = name.startswith("r02_") or name == "r06_hourly_sales_on_day"
        assert compare(df, con, SQL[name]) >= (0 if may_be_empty else 1)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
