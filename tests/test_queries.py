"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from sonoweft.plans import catalog

from .oracle import rows, sql_rows, views

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def duck(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
