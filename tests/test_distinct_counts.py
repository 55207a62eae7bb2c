"""Distinct values per group are counted on rows dealt out for it, not in the tasks that have sorted them for a join."""

from wardlens.operators.summary import distinct_counts
from wardlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_are_dealt_out_before_distinct_rows_are_held(spark):
    plan = QUERIES["bin_nunique"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [i for i, line in enumerate(plan.split("\n")) if "REPARTITION_BY_NUM" in line]
    held = [i for i, line in enumerate(plan.split("\n")) if "HashAggregate(keys=[btime" in line and "encounter_id" in line.split("functions")[0]]
    joins = [i for i, line in enumerate(plan.split("\n")) if "Join" in line]
    # the plan is printed from the result down to the scans
    assert len(dealt) == 1 and held and max(held) < dealt[0] < min(joins)


def test_counts(spark):
    rows = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 1.0), ("a", None, 1.0), ("b", None, 1.0), (None, 3, 1.0), (None, 3, 1.0)]
    out = distinct_counts(spark.createDataFrame(rows, "g string, v int, more double"), ["g"], "v", "n_values")
    assert out.columns == ["g", "n_values"]
    assert {tuple(r) for r in out.collect()} == {("a", 2), ("b", 0), (None, 1)}
