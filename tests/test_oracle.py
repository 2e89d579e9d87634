"""Every registered query against its DuckDB statement on the smallest
benchmark tables (the driver's gate runs the same at sf0.01)."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, register_views  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    register_views(c, SF)
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_sql(spark, con, name):
    sql = E.oracle_sql().get(name)
    df = E.queries()[name](spark, SF)
    if sql is None:
        df.collect()
        return
    ok, srows, drows, detail = compare(df, con, sql)
    assert ok, f"{name}: {len(srows)} vs {len(drows)} rows\n{detail}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["session_id", "session_title", "timestamp", "match_type", "excerpt", "context",
                          "message_id", "part_id", "project_directory"]
