"""Every registered query against its SQL, on the smallest data."""

import oracle
import pytest

import __spark_entry__ as entry

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.limit(1).count() == 1
    else:
        assert oracle.compare(df, con, sql) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
