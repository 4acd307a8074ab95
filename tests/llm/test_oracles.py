"""Registered queries that SQL can express, against DuckDB, on the smallest tables."""

import pytest

from plinth.llm import queries
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    result = duck.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())
