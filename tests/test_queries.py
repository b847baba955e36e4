"""Every registered query against its SQL, and without one for rows and schema."""

import pytest
from helpers import SMALL, table

from tarnwick.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert table(registry.queries()[name](spark, SMALL).toPandas()) == table(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    frame = registry.queries()[name](spark, SMALL)
    assert frame.columns and frame.count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
