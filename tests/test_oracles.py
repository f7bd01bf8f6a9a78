"""Every panel query with a SQL oracle gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from compare import same
from conftest import SF

from crossgrain.queries import QUERIES, oracle_sql

ORACLES = oracle_sql()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    same(QUERIES[name](spark, SF), columns, found.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
