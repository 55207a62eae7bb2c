"""Segmented scans against brute force; small segments force many cross-segment carries."""

import numpy as np
import pandas as pd
import pytest

from wardlens.operators import timeseries as TS


def _pandas_interp(g: pd.Series, forward: bool) -> pd.Series:
    return g.interpolate(limit_direction="forward") if forward else g.interpolate(limit_area="inside")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("seg", [7.0, 1e9])
def test_positional_interpolation_matches_pandas_per_encounter(spark, forward, seg):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(6):
        ts = np.sort(rng.choice(200, size=rng.integers(1, 25), replace=False))
        for t in ts:
            rows.append((e, int(t), float(rng.normal()) if rng.random() < 0.5 else None))
    df = spark.createDataFrame(rows, "encounter_id bigint, time_s bigint, x double")
    got = TS.interpolate(df, ["x"], forward=forward, seg_width=seg).toPandas().sort_values(["encounter_id", "time_s"])
    exp = pd.DataFrame(rows, columns=["encounter_id", "time_s", "x"]).sort_values(["encounter_id", "time_s"])
    exp["x"] = exp.groupby("encounter_id")["x"].transform(lambda s: _pandas_interp(s.astype(float), forward))
    np.testing.assert_allclose(got["x"].to_numpy(dtype=float), exp["x"].to_numpy(dtype=float), equal_nan=True)


def test_interpolation_never_crosses_encounters(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (2, 2, None), (2, 3, 5.0)],
                               "encounter_id bigint, time_s bigint, x double")
    got = {(r.encounter_id, r.time_s): r.x for r in TS.interpolate(df, ["x"]).collect()}
    assert got[(1, 1)] is None and got[(2, 2)] is None


@pytest.mark.parametrize("seg", [5.0, 1e9])
def test_asof_matches_numpy_interp(spark, seg):
    rng = np.random.default_rng(7)
    ref, tgt = [], []
    for e in range(8):
        n = int(rng.integers(0, 5))
        for t in rng.choice(100, size=n, replace=False):
            ref.append((e, int(t), float(rng.normal())))
        for t in rng.integers(-10, 110, size=10):
            tgt.append((e, int(t), 1.0))
    r = spark.createDataFrame(ref, "encounter_id bigint, time_s bigint, value double")
    t = spark.createDataFrame(tgt, "encounter_id bigint, time_s bigint, value double")
    got = TS.asof_interpolate(t, r, seg_width=seg).toPandas()
    refp = pd.DataFrame(ref, columns=["encounter_id", "time_s", "value"])
    for row in got.itertuples():
        g = refp[refp.encounter_id == row.encounter_id].sort_values("time_s")
        if len(g) == 0:
            assert pd.isna(row.interp)
        else:
            exp = np.interp(row.time_s, g.time_s, g.value, left=g.value.min(), right=g.value.max())
            if len(g) == 1:
                exp = g.value.iloc[0]
            assert row.interp == pytest.approx(exp)


def test_asof_returns_reference_value_at_reference_time(spark):
    r = spark.createDataFrame([(1, 10, 2.0), (1, 20, 4.0)], "encounter_id bigint, time_s bigint, value double")
    t = spark.createDataFrame([(1, 10, 0.0), (1, 20, 0.0), (1, 15, 0.0)], "encounter_id bigint, time_s bigint, value double")
    got = {x.time_s: x.interp for x in TS.asof_interpolate(t, r, seg_width=12.0).collect()}
    assert got == {10: 2.0, 20: 4.0, 15: 3.0}


@pytest.mark.parametrize("seg", [3.0, 1e9])
def test_trapezoid_matches_numpy(spark, seg):
    rng = np.random.default_rng(11)
    rows = [(e, "d", float(x), float(rng.integers(0, 10))) for e in range(4) for x in rng.choice(40, size=int(rng.integers(1, 12)), replace=False)]
    df = spark.createDataFrame(rows, "encounter_id bigint, name string, hours double, value double")
    got = {r.encounter_id: r.auc for r in TS.trapezoid(df, seg_width=seg).collect()}
    p = pd.DataFrame(rows, columns=["encounter_id", "name", "hours", "value"])
    for e, g in p.groupby("encounter_id"):
        g = g.sort_values("hours")
        x, y = g.hours.to_numpy(), g.value.to_numpy()
        assert got[e] == pytest.approx(float(np.sum((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2.0)))


def test_peak_rows_keep_ties_and_rebase(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, 3.0), (1, 2, 1.0)], "encounter_id bigint, time_s bigint, value double")
    assert TS.peak_rows(df).count() == 2
    h = spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "encounter_id bigint, hour bigint")
    assert sorted((r.encounter_id, r.hour) for r in TS.rebase(h).collect()) == [(1, 0), (1, 2), (2, 0)]
