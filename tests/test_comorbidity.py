"""Code tables: prefix and exact matches against plain tests, large user tables, one scan."""

import random

from wardlens.functions import codesets as CS
from wardlens.plans import catalog
from wardlens.plans import comorbidity as CM
from wardlens.sources.dataset import Dataset
from wardlens.sources.schemas import TABLE_NAMES

SF = "/root/testdata/sf0.001"


def test_matches_equal_plain_tests(spark):
    rng = random.Random(3)
    code = lambda: rng.choice("AEIZ") + str(rng.randrange(100)) + rng.choice(["", ".", ".1", ".11", ".110"])
    dx = [(rng.randrange(40), rng.choice([code(), code(), None, ""])) for _ in range(600)] + [(None, "E11.9")]
    sets = [(f"s{rng.randrange(30)}", code()[:rng.randrange(1, 7)], rng.choice(["exact", "prefix"])) for _ in range(1500)]
    got = CM.match_codes(spark.createDataFrame(dx, "person_id long, Code string"), spark.createDataFrame(sets, "set_name string, code string, match string"))
    want = {(p, n) for p, c in dx if c for n, s, m in sets if (c == s if m == "exact" else c.startswith(s))}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "StartsWith" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_no_sets_and_no_codes(spark):
    dx = spark.createDataFrame([(1, "A")], "person_id long, Code string")
    none = spark.createDataFrame([], "set_name string, code string, match string")
    assert CM.match_codes(dx, none).collect() == [] and CM.match_codes(dx.limit(0), none).collect() == []


def test_all_sets_equal_the_single_ones_in_one_scan(spark):
    db = Dataset.from_root(spark, catalog.root_of_csv(spark, SF, TABLE_NAMES))
    co = db.create_procedure_cohort(CS.CABG_NAMES)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # paths in full
    out = CM.comorbidity_all(co)
    assert out._jdf.queryExecution().executedPlan().toString().count("Table7_DX") == 1
    flags = {(r.encounter_id, r.set_name): r.flag for r in out.collect()}
    for name, single in (("liver_disease", co.comorbidity("liver_disease")), ("renal_failure", co.comorbidity("renal_failure")), ("cad", co.cad), ("stroke", co.stroke)):
        want = {}
        for r in single.collect():
            want[r.encounter_id] = max(want.get(r.encounter_id, 0), r[1])
        assert {e: f for (e, n), f in flags.items() if n == name} == want, name


def test_sets_of_names(spark):
    t = CS.code_sets(spark)
    assert t.where("kind = 'flowsheet'").select("set_name").distinct().count() == 11
    assert t.count() == sum(len(v) for _, _, v in CS.CODE_SETS.values())
