"""Every registered query against its SQL, and the rows-only ones for rows and a stable schema."""

import pytest
from compare import compare, connect

from dualcast.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, connection, name):
    problem = compare(spark, connection, name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and list(rows[0].asDict()) == df.columns
