"""Every registered query: its SQL in DuckDB gives the same rows, or at least rows come out."""

import pytest
from oracle import compare, connection

from driftpool.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    result = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(result, SQL[name], con) is None
    else:
        assert result.count() > 0


def test_flagship_entry(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
