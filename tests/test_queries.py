"""Every query against its SQL in DuckDB; those without SQL give rows of a stable schema."""

from __future__ import annotations

import pytest

from larkspur import plans

from .oracle import connection, differences


@pytest.fixture(scope="module")
def con(small_dir):
    return connection(small_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, small_dir, con, name):
    assert differences(plans.QUERIES[name](spark, small_dir), con, plans.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_gives_rows(spark, small_dir, name):
    df = plans.QUERIES[name](spark, small_dir)
    assert df.columns and len(df.collect()) > 0
