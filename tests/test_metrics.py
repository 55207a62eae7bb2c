"""Shared fetch of several metrics, second fills, as-of joins over one frame, scratch tables."""

import os

import pytest
from pyspark.sql import functions as F

from wardlens import session
from wardlens.functions import codesets as CS
from wardlens.operators import timeseries as TS
from wardlens.plans import catalog
from wardlens.plans import metrics as MT
from wardlens.sources.dataset import Dataset, Table

SF = "/root/testdata/sf0.001"
ALL = (MT.OxygenConsumption, MT.OxygenDelivery, MT.CardiacPower, MT.VentricularStrokeWorkIndex, MT.Pulsatility, MT.BaseExcess)


def rows(df):
    df = df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_shared_fetch_gives_the_same_series(spark, monkeypatch):
    co, alone = catalog.cohort(spark, SF), catalog.cohort(spark, SF)
    for m in ALL:
        co.add_continuous_metric(m)
        alone.add_continuous_metric(m)
    read = []
    sel = Table.sel
    monkeypatch.setattr(Table, "sel", lambda self, *a, **k: read.append(self.name) or sel(self, *a, **k))
    got = MT.compute_metrics(co)
    assert sorted(read) == ["flowsheet", "labs"]
    want = MT.compute_metrics(alone, shared=False)
    assert list(got) == [m.classname for m in ALL] and read.count("flowsheet") == 6
    for name in got:
        assert rows(got[name]) == rows(want[name]), name


def test_a_shared_fetch_needs_one_cohort(spark):
    db = Dataset.from_driver_tables(spark, SF)
    with pytest.raises(ValueError):
        MT.share_fetch([MT.CardiacPower(db, [1]), MT.BaseExcess(db, [2])])


def test_scratch_tables_can_be_released(spark):
    session.release(spark)
    df = session.materialize(spark.range(5).toDF("id"))
    path = session.WRITTEN[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert session.release(spark) == 1 and not os.path.exists(path) and session.WRITTEN == []


@pytest.mark.parametrize("seg", [3.0, 50.0])
def test_refill_equals_a_second_interpolation(spark, seg):
    d = spark.range(120).select((F.col("id") % 3).alias("encounter_id"), F.col("id").cast("double").alias("time_s"),
                                F.when(F.col("id") % 7 == 1, F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 11 == 4, F.col("id") * 2.0).alias("y"))
    once = TS.interpolate(d, ["x"], seg_width=seg)
    twice = TS.refill(TS.interpolate(d, ["x"], seg_width=seg, keep_places=True), ["y"], forward=True)
    assert rows(twice) == rows(TS.interpolate(once, ["y"], seg_width=seg, forward=True))


def test_series_of_one_frame_equal_separate_frames(spark):
    c = spark.createDataFrame([(e, float(t * 7 % 40), n, float(t)) for e in (1, 2, 3) for t in range(20) for n in ("h", "p", "t") if (t + e + len(n)) % 3 or n != "p"],
                              "encounter_id long, time_s double, name string, value double")
    c = c.where("not (encounter_id = 3 and name = 'p')")
    tgt = c.where("name = 't'").select("encounter_id", "time_s", F.col("value").alias("own"))
    one = TS.asof_interpolate(tgt, (c, {"h": F.col("name") == "h", "p": F.col("name") == "p"}), seg_width=9.0)
    two = TS.asof_interpolate(tgt, {"h": c.where("name = 'h'"), "p": c.where("name = 'p'")}, seg_width=9.0)
    assert rows(one) == rows(two) and one.count() == 60
    assert plan(one).count("Exchange hashpartitioning") <= 8  # before stages are reused


def test_release_is_documented_for_cohorts(spark):
    co = Dataset.from_driver_tables(spark, SF).create_procedure_cohort(CS.CABG_NAMES)
    before = len(session.WRITTEN)
    n = co.add_continuous_metric(MT.OxygenContent).compute().count()
    assert n > 0 and len(session.WRITTEN) > before and session.release(spark) >= 1
