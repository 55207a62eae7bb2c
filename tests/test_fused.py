"""Fused variables: the same values as the single ones, one scan of each source table."""

import pytest
from pyspark.sql import functions as F

from wardlens.functions import codesets as CS
from wardlens.operators import summary as SM
from wardlens.plans import catalog, fused
from wardlens.plans import variables as V
from wardlens.sources.dataset import Dataset
from wardlens.sources.schemas import TABLE_NAMES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan csv")


@pytest.fixture(scope="module")
def root(spark):
    return catalog.root_of_csv(spark, SF, TABLE_NAMES)


def test_each_source_is_read_once(spark, root):
    co = Dataset.from_root(spark, root).create_procedure_cohort(CS.CABG_NAMES)
    assert scans(co.table1()) == 4  # procedures, encounters, flowsheet, diagnosis
    assert scans(SM.table_one(co.variables(["age", "gender", "bmi", "death", "icu_los"]), ["age", "bmi", "icu_los"], ["gender", "death"])) == 3
    assert scans(co.variables(["icu_los"])) == 2


@pytest.mark.parametrize("anchor", ["own", "events"])
def test_fused_values_equal_the_single_variables(spark, anchor):
    co = catalog.cohort(spark, SF)
    if anchor == "events":
        few = co.offset.where("encounter_id % 3 > 0")
        co = co.set_offset(few.union(few.withColumn("offset", F.col("offset") + 2)))
    got = co.variables(["post_op_delirium", *fused.ANALYSIS]).drop("surgeries")
    want = SM.spine_join([co.eid, co.age, co.gender, co.mortality, co.bmi, co.icu_los, co.mechanical_ventilation_duration, co.dm, co.chf, co.osa])
    out = V.post_op_delirium(co, "encounter")
    want = want.join(out, "encounter_id", "left").withColumn(
        "post_op_delirium", F.when(F.col("post_op_delirium"), "Delirium").when(~F.col("post_op_delirium"), "No Delirium"))
    cut = lambda df: rows(df.withColumn("bmi", F.round("bmi", 6)))
    assert cut(got) == cut(want) and got.count() > 20


def test_cohort_filters_hold(spark):
    db = Dataset.from_driver_tables(spark, SF)
    ids = db.procedures.sel(order_name=CS.CABG_NAMES).select("encounter_id").distinct().orderBy("encounter_id").limit(15)
    co = db.create_procedure_cohort(CS.CABG_NAMES, encounter_id=ids)
    assert rows(co.variables(["age"]).select("encounter_id")) == rows(co.eid)
    people = co.pid.orderBy("person_id").limit(4)
    co = db.create_procedure_cohort(CS.CABG_NAMES, person_id=people)
    assert rows(co.variables(["age"]).select("encounter_id")) == rows(co.eid)
    with pytest.raises(ValueError):
        co.variables(["height"])


def test_table_one_reads_nulls_as_missing(spark):
    t1 = spark.createDataFrame([(1, 1.0, "a", "x"), (2, None, "a", "x"), (3, 5.0, None, "x"), (4, None, None, None)], "encounter_id long, v double, c string, g string")
    got = {(r.group, r.variable, r.level): (r.n, r.missing, r.mean, r.pct) for r in SM.table_one(t1, ["v"], ["c"], group="g").collect()}
    assert got == {("x", "v", None): (2, 1, 3.0, None), ("x", "c", "a"): (2, 1, None, 100.0), (None, "v", None): (0, 1, None, None)}
    assert SM.table_one(t1.limit(0), ["v"], ["c"]).collect() == []
