"""Every registered query against its SQL on the smallest test data, types included."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

from compare import connect, differences  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from shelfwise.plans import catalog  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_analysis_has_sql():
    assert set(catalog.all_queries()) <= set(SQL)


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_same_result(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0
