"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

from lorekeep import registry

SF_DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert not compare(df, con, SQL[name])


def test_comparison_notices_differences(spark, con):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    assert not compare(df, con, "SELECT 1::BIGINT AS n, 'a' AS s")
    assert compare(df, con, "SELECT 2::BIGINT AS n, 'a' AS s")
    assert compare(df, con, "SELECT 1::BIGINT AS n, 'a' AS t")
    assert compare(df, con, "SELECT 1::INTEGER AS n, 'a' AS s")
    assert compare(df, con, "SELECT 1::BIGINT AS n, 'a' AS s UNION ALL SELECT 1, 'a'")


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
