import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import __spark_entry__ as entry  # noqa: E402
from oracle import DATA, connection, rows_of, rows_of_sql  # noqa: E402

from skeinworks.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        columns = sorted(df.columns)
        assert rows_of(df, columns) == rows_of_sql(con, ORACLE_SQL[name], columns)
    else:
        assert df.count() >= 0


def test_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
