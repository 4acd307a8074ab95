"""Every registered query of the engine itself against its DuckDB counterpart, on the smallest tables."""

import pytest

from plinth import catalog
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in catalog.SQL:
        assert got
        return
    result = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, result.fetchall())


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).columns == ["query_id", "rank", "chunk_id", "score"]
