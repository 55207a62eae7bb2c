"""Rows that several steps of a query read are computed once; no table is scanned again for what is known already."""

import pytest

from wardlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rebase_hours", "cut_hours", "cut_half_days", "blood_gas_bins", "spine_join"])
def test_shared_rows_are_read_back(spark, name):
    plan = optimized(spark, name)
    assert "Relation [" in plan and not any(c in plan for c in ("o_orderkey", "l_orderkey", "event_id"))


@pytest.mark.parametrize("name, scans", [("reexplore", 5), ("icu_start", 5)])
def test_cohort_is_not_scanned_again(spark, name, scans):
    # room charges, the cohort (its procedures, and encounters with procedures again), and re-operations or procedure days
    assert optimized(spark, name).count("Relation [") <= scans
