"""Deliveries in and out: streams of files with their own headers, exports with a manifest, loaders."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlens.plans import catalog
from wardlens.sources import sinks as SK
from wardlens.sources.dataset import load_table
from wardlens.sources.loader import load_row_group, register_loader, row_group_parts
from wardlens.streaming.flowsheet_etl import read_flowsheet_stream, run_flowsheet_stream

SF = "/root/testdata/sf0.001"
NAMES = SK.FLOWSHEET_ETL_SCHEMA.fieldNames()


def delivery(path, header, rows):
    cell = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"') else v
    path.write_text("\n".join([",".join(header), *[",".join(cell(r.get(c, "")) for c in header) for r in rows]]) + "\n")


def row(i, name, value="1"):
    return {"encounter_id": str(i), "flowsheet_days_since_birth": "5", "flowsheet_time": "01:02:03", "display_name": name, "flowsheet_value": value}


def rows(df):
    return sorted(map(repr, df.select(*NAMES).collect()))


def test_a_stream_binds_each_file_by_its_own_header(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    delivery(src / "a.csv", NAMES, [row(1, "Pulse", 'say "a", b'), row(2, "12")])
    delivery(src / "b.csv", [*NAMES[::-1], "extra"], [row(3, "pulse"), row(4, ""), {"display_name": "no id"}])
    (src / "empty.csv").write_text("")
    run_flowsheet_stream(spark, str(src), out, ckpt)
    got = read_flowsheet_stream(spark, out)
    assert sorted((r.encounter_id, r.display_name, r.flowsheet_value) for r in got.collect()) == [(1, "PULSE", 'say "a", b'), (2, "12", "1"), (3, "PULSE", "1"), (4, "", "1")]
    delivery(src / "c.csv", NAMES, [row(5, "cco")])
    run_flowsheet_stream(spark, str(src), out, ckpt)
    run_flowsheet_stream(spark, str(src), out, ckpt)  # nothing new
    assert sorted(r.encounter_id for r in read_flowsheet_stream(spark, out).collect()) == [1, 2, 3, 4, 5]
    one = SK.preprocess_flowsheet(spark, str(src / "b.csv"), str(tmp_path / "batch"))
    assert rows(spark.read.schema(got.schema).parquet(one).fillna("")) == rows(got.where("encounter_id in (3, 4)"))


def test_a_missing_column_raises(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    delivery(src / "a.csv", NAMES[:-1], [row(1, "pulse")])
    with pytest.raises(Exception, match="flowsheet_value"):
        run_flowsheet_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    with pytest.raises(Exception, match="flowsheet_value"):
        SK.preprocess_flowsheet(spark, str(src / "a.csv"), str(tmp_path / "batch"))


def test_a_folder_of_differing_headers_raises_in_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    delivery(src / "a.csv", NAMES, [row(1, "pulse")])
    delivery(src / "b.csv", NAMES[::-1], [row(2, "pulse")])
    with pytest.raises(Exception):
        SK.preprocess_flowsheet(spark, str(src), str(tmp_path / "out"))


def test_a_hot_name_of_a_batch_is_split(spark, tmp_path):
    src = tmp_path / "in"
    hot = spark.range(40_000).select(*[F.lit(v).alias(k) if k != "encounter_id" else F.col("id").cast("string").alias(k) for k, v in row(0, "hot").items()])
    SK.csv_writer(hot.withColumn("flowsheet_value", F.sha2("encounter_id", 256)).repartition(4)).csv(str(src))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = run_flowsheet_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len([f for f in os.listdir(f"{out}/batch_id=0/display_name=HOT") if f.endswith(".parquet")]) > 1


def test_the_manifest_counts_what_was_written(spark, tmp_path):
    co = catalog.cohort(spark, SF)
    paths = SK.dump_tables(co, str(tmp_path))
    m = {(r.table, r.name): r.rows for r in SK.read_manifest(spark, str(tmp_path)).collect()}
    assert {t for t, _ in m} == {"encounters", "labs", "procedures"} and len(paths) == 3
    labs = spark.read.option("header", True).csv(str(tmp_path / SK.LAYOUTS["swan"]["labs"]))
    assert {n: k for (t, n), k in m.items() if t == "labs"} == {n: labs.where(F.col("lab_component_name") == n).count() for n in ("CREATININE SERUM", "TROPONIN I")}
    assert m["encounters", ""] == co.encounter_info.count() and m["procedures", "HB BURN INTENSIVE ROOM CHG"] == 0
    few = SK.dump_tables(co, str(tmp_path / "one"), encounter_id=[r.encounter_id for r in co.eid.limit(3).collect()], tables=["labs"])
    assert [os.path.basename(p) for p in few] == [SK.LAYOUTS["swan"]["labs"]] and SK.read_manifest(spark, str(tmp_path / "one")).count() == 2


def test_a_loader_reads_its_parts_and_sees_predicates(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("\n".join(f"{i}:{k}" for k in range(4)))

    def load(part, wanted):
        lines = open(part[0]).read().split("\n")
        asked = ",".join(f"{k}={sorted(v)}" for k, v in sorted(wanted.items()))
        yield pa.RecordBatch.from_arrays([pa.array([int(x.split(":")[1]) for x in lines]), pa.array(lines), pa.array([asked] * len(lines))], names=["k", "line", "asked"])

    register_loader(spark, "lines_of_files", "line string, k bigint, asked string", load)
    df = load_table(spark, str(tmp_path), "", fmt="lines_of_files")
    assert df.columns == ["line", "k", "asked"] and df.count() == 12 and df.rdd.getNumPartitions() == 3
    got = df.where("k = 2").collect()
    assert sorted(r.line for r in got) == ["0:2", "1:2", "2:2"] and {r.asked for r in got} == {"k=[2]"}


def test_row_groups_are_skipped_by_statistics(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"a": list(range(100)), "b": ["x"] * 100}), path, row_group_size=10)
    assert list(row_group_parts(path, {"a": {15, 16}})) == [(path, 1)] and len(list(row_group_parts(path, {}))) == 10
    assert list(row_group_parts(path, {"b": {"y"}})) == [] and len(list(row_group_parts(path, {"c": {1}}))) == 10
    assert sum(b.num_rows for b in load_row_group((path, 3), {})) == 10
