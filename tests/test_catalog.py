"""Registered queries next to their SQL; all of them with COHORTLAKE_ALL=1."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools import check

FOLDER = "/root/testdata/sf0.001"
FEW = ["filtered_group_basic_stats", "numeric_distribution", "group_quartiles", "link_multi", "session_ids", "chi_square", "pearson_matrix", "read_delimited", "stream_sessions", "multi_hot"]
NAMES = list(entry.oracle_sql()) if os.environ.get("COHORTLAKE_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert check.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
