"""Tidy forms compute their columns once and drop every row with a null or NaN."""

import math

import pytest

from wardlens.operators.tidy import whole_rows
from wardlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tidy_labs", "tidy_flow_text", "tidy_meds", "rebase_hours"])
def test_null_test_holds_no_copies_of_the_expressions(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    tests = [p.split("\n")[0] for p in plan.split("atleastnnonnulls")[1:]]
    assert tests and not any("case when" in t or "cast(" in t for t in tests)


def test_rows_with_a_null_go(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "b", None), (4, "c", math.nan), (None, "d", 2.0)], "k int, s string, v double")
    assert [tuple(r) for r in whole_rows(df).collect()] == [(1, "a", 1.0)] and whole_rows(df).columns == ["k", "s", "v"]
