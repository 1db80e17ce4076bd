"""The queries that SQL can express, on the smallest test data."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))

from compare import connect, differences  # noqa: E402

from shelfwise.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.all_sql()))
def test_same_result(spark, name):
    assert differences(queries.all_queries()[name](spark, SMALL), connect(SMALL), queries.all_sql()[name]) == []


@pytest.mark.parametrize("name", ["op5_mixing", "op8_pseudonyms", "op10_decontamination"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.all_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
