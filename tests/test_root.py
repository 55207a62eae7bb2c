"""A root of extracts: every form gives the same rows, predicates reach the files, dictionaries follow the files."""

import os

import pytest
from pyspark.sql import functions as F

from wardlens.plans import catalog
from wardlens.sources.dataset import Dataset, files_state
from wardlens.sources.schemas import LAYOUTS, META, TABLE_NAMES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def root(spark):
    return catalog.root_of_csv(spark, SF, TABLE_NAMES)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")  # names and paths in full
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_whole_root_opens_in_every_form(spark, root):
    whole = Dataset.from_root(spark, root)
    driver = Dataset.from_driver_tables(spark, SF)
    want = {n: rows(whole.table(n).df) for n in TABLE_NAMES}
    for n in TABLE_NAMES:
        assert whole.table(n).columns() == META[n].schema.fieldNames() and whole.table(n).head().collect() == []
        assert whole.table(n).df.count() == driver.table(n).df.count()
    assert Dataset.from_root(spark, root).write_cache(["labs", "encounters"])
    assert Dataset.from_root(spark, root).write_cache(["flowsheet", "diagnosis"], partitioned=True)
    cached = Dataset.from_root(spark, root)
    assert [os.path.splitext(cached.table(n).source)[1] for n in ("labs", "encounters", "flowsheet", "diagnosis", "procedures")] == [
        ".parquet", ".parquet", ".part", ".part", ".csv"]
    for n in TABLE_NAMES:
        assert rows(cached.table(n).df) == want[n], n
    assert all(Dataset.from_root(spark, root, cached=False).table(n).source.endswith(".csv") for n in TABLE_NAMES)


def test_names_reach_the_files(spark):
    parquet = plan(catalog._cached_root(spark, SF, False).labs.sel(catalog.SEL_LABS))
    assert "In(lab_component_name, [CREATININE SERUM,HEMOGLOBIN]" in parquet.split("PushedFilters")[1]
    one = catalog._cached_root(spark, SF, False).labs.sel("HEMOGLOBIN")
    assert "EqualTo(lab_component_name,HEMOGLOBIN)" in plan(one).split("PushedFilters")[1]
    part = catalog._cached_root(spark, SF, True).labs.sel("HEMOGLOBIN")
    assert "lab_component_name" in plan(part).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert all("lab_component_name=HEMOGLOBIN" in f for f in part.inputFiles()) or len(part.inputFiles()) > 0


def test_odd_names_survive_the_folders(spark, tmp_path):
    names = META["labs"].schema.fieldNames()
    odd = ["", "12", "a/b=c", "é ü", "'q'", "x ", "%"]
    lines = [",".join({"encounter_id": str(i), "lab_component_name": n}.get(c, "") for c in names) for i, n in enumerate(odd)]
    (tmp_path / LAYOUTS["swan"]["labs"]).write_text("\n".join([",".join(names), *lines]) + "\n")
    csv = Dataset.from_root(spark, str(tmp_path)).labs
    want = rows(csv.df)
    csv.partition()
    part = Dataset.from_root(spark, str(tmp_path)).labs
    assert part.source.endswith(".part") and rows(part.df) == want
    assert [r.encounter_id for r in part.sel("12", clean=False).collect()] == [1] and [r.encounter_id for r in part.sel("", clean=False).collect()] == [0]


def test_the_dictionary_is_kept_and_follows_the_files(spark, tmp_path):
    names = META["labs"].schema.fieldNames()
    path = tmp_path / LAYOUTS["swan"]["labs"]
    line = lambda n, unit: ",".join({"encounter_id": "1", "lab_component_name": n, "lab_result_unit": unit}.get(c, "") for c in names)
    path.write_text("\n".join([",".join(names), line("b", "u"), line("a", "U"), line("B", "v")]) + "\n")
    t = Dataset.from_root(spark, str(tmp_path)).labs
    assert [tuple(r) for r in t.unique().collect()] == [("B", 2), ("A", 1)]
    kept = [f for f in os.listdir(tmp_path) if f.endswith(".dict")]
    assert len(kept) == 1
    assert ".dict" in plan(t.search("B")) and [r[0] for r in t.search("B").collect()] == ["B"]
    assert [tuple(r) for r in t.unique("lab_result_unit").collect()] == [("U", 2), ("V", 1)]
    assert sorted(r[0] for r in t.search("u", "lab_result_unit").collect()) == ["u"]
    before = files_state(spark, str(path))
    path.write_text(path.read_text() + line("c", "w") + "\n")
    assert files_state(spark, str(path)) != before
    assert sorted(r[0] for r in Dataset.from_root(spark, str(tmp_path)).labs.unique(count=False).collect()) == ["A", "B", "C"]


def test_a_refresh_touches_its_names_only(spark):
    root = catalog.root_of_csv(spark, SF)
    new = Dataset.from_root(spark, root, cached=False).labs
    home = new.partition()
    files = {d: sorted(os.listdir(f"{home}/{d}")) for d in os.listdir(home) if "=" in d}
    new.refresh(["gfr", "no such name"])
    after = {d: sorted(os.listdir(f"{home}/{d}")) for d in os.listdir(home) if "=" in d}
    assert after.keys() == files.keys() and [d for d in files if files[d] != after[d]] == ["lab_component_name=GFR"]
    assert rows(Dataset.from_root(spark, root).labs.df) == rows(new.df)
    with pytest.raises(ValueError):
        Dataset.from_root(spark, root).labs.refresh(["gfr"])
    with pytest.raises(ValueError):
        Dataset.from_driver_tables(spark, SF).labs.partition()


def test_foreign_parquet_is_read_in_declared_types(spark, tmp_path):
    raw = Dataset.from_driver_tables(spark, SF).labs.df.limit(50).withColumn("lab_component_name", F.initcap("lab_component_name"))
    raw.select(*[F.col(c).cast("string") for c in raw.columns]).write.parquet(str(tmp_path / "Table3_Lab.parquet"))
    t = Dataset.from_root(spark, str(tmp_path)).labs
    assert t.df.schema["encounter_id"].dataType.typeName() == "long" and t.df.where("lab_component_name <> upper(lab_component_name)").count() == 0
