"""Hand fixtures per operator (clinical schema, a few rows each)."""

import pytest
from pyspark.sql import functions as F

from wardlens.operators import summary as SM
from wardlens.operators import tidy as TD
from wardlens.plans.cohort import align
from wardlens.plans.variables import aki_stage
from wardlens.sources.dataset import Dataset
from wardlens.sources.schemas import META

D = 86400


def _frames(spark, **rows):
    return {name: spark.createDataFrame(r, META[name].schema) for name, r in rows.items()}


def test_day_cleanup_keeps_only_digit_text(spark):
    ds = Dataset(spark, _frames(spark, procedures=[
        (1, 10, "cabg", "12"), (1, 10, "cabg", ">32850"), (1, 10, "cabg", "-3"),
        (1, 10, "cabg", "1.5"), (1, 10, "cabg", ""), (None, 10, "cabg", "4")]))
    out = ds.procedures.sel().collect()
    assert [(r.encounter_id, r.order_name, r.days_from_dob_procstart) for r in out] == [(1, "CABG", 12)]


def test_sel_combines_positional_and_keyword_filters(spark):
    ds = Dataset(spark, _frames(spark, procedures=[(1, 1, "a", "1"), (2, 1, "a", "1"), (2, 1, "b", "1")]))
    assert ds.procedures.sel(["A"], encounter_id=[2]).count() == 1


def test_search_and_unique(spark):
    ds = Dataset(spark, _frames(spark, labs=[(1, "Hemoglobin", "1", "U", "1", "00:00:00", "x"),
                                             (1, "PO2 arterial", "1", "U", "1", "00:00:00", "x"),
                                             (2, "PO2 ARTERIAL", "1", "U", "1", "00:00:00", "x")]))
    assert sorted(r[0] for r in ds.labs.search("PO2").collect()) == ["PO2 ARTERIAL"]
    counts = {r[0]: r[1] for r in ds.labs.unique().collect()}
    assert counts == {"PO2 ARTERIAL": 2, "HEMOGLOBIN": 1}


def test_tidy_labs_drops_rows_with_any_null_and_bad_text(spark):
    labs = spark.createDataFrame([(1, "CR", "1.5", "U", 2, "01:00:30", "x"), (1, "CR", "HEMOLYZED", "U", 2, "01:00:00", "x"),
                                  (1, "CR", "2.0", "U", 2, "bad", "x"), (1, "CR", "2.5", None, 2, "00:00:00", "x")],
                                 "encounter_id bigint, lab_component_name string, lab_result_value string, lab_result_unit string, "
                                 "lab_collection_days_since_birth int, lab_collection_time string, loinc_code string")
    out = TD.tidy_labs(labs).collect()
    assert [(r.encounter_id, r.time_s, r.name, r.value) for r in out] == [(1, 2 * D + 3630, "CR", 1.5)]


def test_align_fans_out_per_procedure_day(spark):
    obs = spark.createDataFrame([(1, 5 * D, "X", 1.0)], "encounter_id bigint, time_s bigint, name string, value double")
    offs = spark.createDataFrame([(1, 2), (1, 4)], "encounter_id bigint, offset int")
    assert sorted(r.time_s for r in align(obs, offs).collect()) == [1 * D, 3 * D]
    assert [r.time_s for r in align(obs, offs, anchor="first").collect()] == [3 * D]


@pytest.mark.parametrize("series,code", [
    ([(1 * D, 1.0)], -3),                                   # nothing at or before day 0
    ([(0, 1.0), (D // 2, 1.0)], -1),                        # nothing from day 1
    ([(0, 1.0), (D, 3.0)], 3),                              # 3x baseline
    ([(0, 1.0), (D, 2.0)], 2),                              # 2x
    ([(0, 1.0), (D, 1.5)], 1),                              # 1.5x
    ([(0, 1.0), (D, 1.35)], 1),                             # +0.3 within 2 days
    ([(0, 1.0), (3 * D, 1.35)], 0),                         # +0.35 after day 2
    ([(0, 1.0), (8 * D, 9.0)], 0),                          # only after day 7
])
def test_aki_codes(spark, series, code):
    df = spark.createDataFrame([(1, t, v) for t, v in series], "encounter_id bigint, time_s bigint, value double")
    r = aki_stage(df).collect()[0]
    assert r.value == code and r["desc"]


def test_rebin_and_cuts(spark):
    df = spark.createDataFrame([(1, -1), (1, 0), (1, 8 * 3600 - 1), (1, 8 * 3600)], "encounter_id bigint, time_s bigint")
    assert [r.btime for r in TD.rebin_time(df, "q8h").orderBy("time_s").collect()] == [-8, 0, 0, 8]
    with pytest.raises(ValueError):
        TD.rebin_time(df, "q5h")
    h = spark.createDataFrame([(0.0,), (7.0,), (7.5,), (-1.0,)], "rhour double")
    assert [r.bin for r in TD.cut_right_closed(h, "rhour", 8.0).collect()] == [8, 8, 16, None]


def test_half_even_hours(spark):
    df = spark.createDataFrame([(1, 1800), (1, 5400), (1, 9000)], "encounter_id bigint, time_s bigint")
    assert [r.hour for r in TD.round_hours(df).orderBy("time_s").collect()] == [0.0, 2.0, 2.0]


def test_pivot_and_melt_roundtrip(spark):
    df = spark.createDataFrame([(1, 0, "A", 1.0), (1, 0, "A", 3.0), (1, 0, "B", 5.0), (1, 1, "B", 7.0)],
                               "encounter_id bigint, time_s bigint, name string, value double")
    p = TD.pivot_tidy(df, ["A", "B", "C"])
    rows = {(r.time_s): (r.A, r.B, r.C) for r in p.collect()}
    assert rows == {0: (2.0, 5.0, None), 1: (None, 7.0, None)}
    m = TD.melt_tidy(p, t="time_s")
    assert m.count() == 6 and m.where(F.col("value").isNull()).count() == 3


def test_table_one_keeps_the_null_group(spark):
    t1 = spark.createDataFrame([(1, 5.0, "a", "x"), (2, 7.0, "b", None), (3, 9.0, "b", None)], "encounter_id int, v double, c string, g string")
    rows = SM.table_one(t1, ["v"], ["c"], group="g").collect()
    assert {(r["group"], r["variable"], r["level"], r["n"], r["pct"]) for r in rows} == {
        ("x", "v", None, 1, None), (None, "v", None, 2, None), ("x", "c", "a", 1, 100.0), (None, "c", "b", 2, 100.0)}
