"""Every registered query with SQL against DuckDB on the smallest tables, and the plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import TABLES, compare  # noqa: E402

from __spark_entry__ import entry  # noqa: E402
from cartlens.registry import ORACLES, QUERIES  # noqa: E402
from cartlens.schema import CLICKSTREAM, FEATURES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SQL = ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    connected = duckdb.connect()
    for table in TABLES:
        connected.execute(f"CREATE VIEW {table} AS FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connected


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR).toPandas()
    assert compare(frame, connection.execute(SQL[name]).fetchdf()) is None


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["row_id", *FEATURES, "target"]
    assert frame.count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    plan = _plan(QUERIES["user_behavior"](spark, SF_DIR))
    assert "props" not in plan and "CartesianProduct" not in plan


def test_cart_filter_reaches_the_scan(spark):
    from cartlens.operators.behavior import cart_events
    from cartlens.operators.cleaning import drop_null_rows
    from cartlens.sources.clickstream import read_clickstream, star_clickstream
    from cartlens.session import scratch_path

    path = scratch_path(spark, "plan")
    star_clickstream(spark, SF_DIR).write.parquet(path)
    stored = read_clickstream(spark, path, CLICKSTREAM)
    plan = _plan(cart_events(stored).select("row_id"))
    assert "EqualTo(event_type,cart)" in plan
    cleaned = _plan(drop_null_rows(stored))
    assert "PushedFilters: [IsNotNull(" in cleaned
