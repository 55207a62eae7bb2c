"""The entry point over files: header order, quotes, caches, hot names; and the plans of segmented scans."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wardlens.operators import timeseries as TS
from wardlens.sources.dataset import Dataset, Registry, Table, clean_days, read_table
from wardlens.sources.schemas import LAYOUTS, META

LABS = META["labs"]


def lab_csv(tmp_path, header, lines):
    path = tmp_path / LAYOUTS["swan"]["labs"]
    path.write_text("\n".join([",".join(header), *lines]) + "\n")
    return str(path)


def test_csv_columns_are_bound_by_name_and_quotes_hold(spark, tmp_path):
    names = [f.name for f in LABS.schema.fields]
    row = {n: "" for n in names} | {"encounter_id": "7", "lab_component_name": '"Say ""acute"", failure"', "lab_result_value": "12.5"}
    path = lab_csv(tmp_path, names[::-1], [",".join(row[n] for n in names[::-1])])
    got = read_table(spark, path, LABS).first()
    assert (got.encounter_id, got.lab_component_name, got.lab_result_value) == (7, 'Say "acute", failure', "12.5")
    short = lab_csv(tmp_path, names[1:], [",".join(row[n] for n in names[1:])])
    with pytest.raises(AnalysisException):
        read_table(spark, short, LABS)


def test_forms_of_a_table_give_equal_rows(spark, tmp_path):
    names = [f.name for f in LABS.schema.fields]
    path = lab_csv(tmp_path, names, [",".join("7" if n == "encounter_id" else "" for n in names)])
    csv = read_table(spark, path, LABS).collect()
    stem = os.path.splitext(path)[0]
    spark.read.option("header", True).csv(path).write.parquet(stem + ".parquet")
    assert read_table(spark, path, LABS).collect() == csv


def test_a_broken_cache_raises(spark, tmp_path):
    names = [f.name for f in LABS.schema.fields]
    path = lab_csv(tmp_path, names, [",".join("7" for _ in names)])
    os.makedirs(os.path.splitext(path)[0] + ".parquet")
    with pytest.raises(AnalysisException):
        read_table(spark, path, LABS)


def test_long_digit_days_are_dropped(spark):
    df = spark.createDataFrame([("12",), ("99999999999",), (">90",)], "lab_collection_days_since_birth string")
    assert [r[0] for r in clean_days(df).collect()] == [12]


def test_a_hot_name_is_written_by_several_tasks(spark, tmp_path):
    labs = Dataset.from_driver_tables(spark, "/root/testdata/sf0.001").labs
    labs.df = spark.range(60_000).select(F.col("id").alias("encounter_id"), F.lit("hot").alias("lab_component_name"), F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(4)
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = labs.partition(str(tmp_path / "part"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len([f for f in os.listdir(f"{out}/lab_component_name=HOT") if f.endswith(".parquet")]) > 1


def test_segment_windows_are_dealt_out_by_segment(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("encounter_id"), F.col("id").cast("double").alias("hours"), F.col("id").cast("double").alias("value"), F.lit("a").alias("name"))
    dealt = rows.repartition("encounter_id")
    for out in (TS.interpolate(dealt, ["value"], t="hours", seg_width=24.0), TS.trapezoid(dealt, keys=("encounter_id",))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_seg" in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_cast_write_and_contains(spark, tmp_path):
    names = [f.name for f in LABS.schema.fields]
    rows = [{"encounter_id": "7", "lab_component_name": "Est gfr", "lab_result_value": "59.5"},
            {"encounter_id": "8", "lab_component_name": "HGB", "lab_result_value": ">60"}]
    path = lab_csv(tmp_path, names, [",".join(r.get(n, "") for n in names) for r in rows])
    t = Table(LABS, read_table(spark, path, LABS))
    assert [r.lab_result_value for r in t.cast("lab_result_value", "double").orderBy("encounter_id").collect()] == [59.5, None]
    assert [r.encounter_id for r in t.sel(contains="GFR", clean=False).collect()] == [7]
    back = spark.read.parquet(t.write(str(tmp_path / "whole")))
    assert back.dtypes == t.df.dtypes and sorted(back.collect()) == sorted(t.df.collect())


def test_registry_reads_its_two_files(spark, tmp_path):
    (tmp_path / "primary.csv").write_text("id,age\n1,60\n2,70\n")
    (tmp_path / "second.csv").write_text("id,age\n2,71\n")
    r = Registry(spark, str(tmp_path), {"redo": "second.csv"})
    assert (r.primary().count(), r.redo().columns, r.redo().first().age) == (2, ["id", "age"], "71")


def test_oxygen_content_on_a_grid(spark):
    from wardlens.plans.metrics import o2_content_at, o2_content_on

    series = lambda rows: spark.createDataFrame(rows, "encounter_id long, time_s double, value double")
    sat, hgb, po2 = series([(1, 0.0, 90.0), (1, 100.0, 100.0)]), series([(1, 0.0, 10.0)]), series([(1, 50.0, 80.0)])
    got = o2_content_on(sat.withColumn("time_s", F.lit(50.0)).distinct(), sat, hgb, "CaO2", po2).distinct().collect()
    want = o2_content_at(series([(1, 50.0, 95.0)]), hgb, po2, "CaO2").first()
    assert [r.value for r in got] == [pytest.approx(want.value)]
    dry = o2_content_on(series([(1, 50.0, 0.0)]), sat, hgb, "CaO2").first()
    assert dry.value == pytest.approx(o2_content_at(series([(1, 50.0, 95.0)]), hgb, po2.limit(0), "CaO2").first().value)
