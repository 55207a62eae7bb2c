"""Sinks: partitioned Parquet, the flowsheet ETL, cohort export with its manifest (SNK-01..05)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions import codesets as CS
from wardlens.sources.dataset import conform, header_of, read_csv_text, rebalanced
from wardlens.sources.schemas import LAYOUTS

# The flowsheet ETL schema (ids and day as numbers, the rest text).
FLOWSHEET_ETL_SCHEMA = T.StructType([
    T.StructField("encounter_id", T.LongType(), True),
    T.StructField("flowsheet_days_since_birth", T.IntegerType(), True),
    T.StructField("flowsheet_time", T.StringType(), True),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("flowsheet_value", T.StringType(), True),
])


def csv_writer(df: DataFrame):
    """CSV writer that keeps text exactly (Spark trims leading/trailing blanks by default)."""
    return (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False))


def clean_flowsheet(df: DataFrame) -> DataFrame:
    """SRC-07: drop rows without id or day, upper-case the name, blank text stays ``''``."""
    return (df.dropna(subset=["encounter_id", "flowsheet_days_since_birth"])
              .withColumn("display_name", F.upper(F.coalesce(F.col("display_name"), F.lit(""))))
              .withColumn("flowsheet_value", F.coalesce(F.col("flowsheet_value"), F.lit("")))
              .withColumn("flowsheet_time", F.coalesce(F.col("flowsheet_time"), F.lit(""))))


def preprocess_flowsheet(spark: SparkSession, data_source: str, output_path: str) -> str:
    """SNK-02: flowsheet CSV -> Parquet partitioned by display name (overwrite)."""
    write_flowsheet(read_csv_text(spark, data_source, header_of(spark, data_source)), output_path)
    return output_path


def write_flowsheet(raw: DataFrame, path: str) -> None:
    """Cleaned rows by display name; a name that holds too much is split over several tasks."""
    rows = clean_flowsheet(conform(raw, FLOWSHEET_ETL_SCHEMA))
    rebalanced(rows, "display_name").write.partitionBy("display_name").mode("overwrite").parquet(path)


def required_names(co, metrics=()) -> dict:
    """SNK-05: names per table the cohort and its metrics need (de-duplicated, in order)."""
    req = {"labs": ["CREATININE SERUM", "TROPONIN I"], "flowsheet": [],
           "procedures": CS.ICU_CODES + CS.ROOM_CODES + list(co.procedures)}
    for m in list(metrics) + list(getattr(getattr(co, "metrics", None), "metrics", [])):
        for k, v in m.REQUIRES.items():
            req.setdefault(k, []).extend(v)
    return {k: list(dict.fromkeys(v)) for k, v in req.items()}


MANIFEST = "manifest.csv"
MANIFEST_SCHEMA = "table string, name string, rows bigint"


def manifest(spark: SparkSession, rows: dict[str, dict[str, int]]) -> DataFrame:
    """SNK-05 as a table ``(table, name, rows)`` (size bounded by the code sets and metric specs)."""
    return spark.createDataFrame([(t, n, k) for t, names in rows.items() for n, k in names.items()], MANIFEST_SCHEMA).coalesce(1)


def read_manifest(spark: SparkSession, dir_path: str) -> DataFrame:
    df = spark.read.schema(MANIFEST_SCHEMA).option("header", True).option("escape", '"').csv(os.path.join(dir_path, MANIFEST))
    return df.fillna("", ["name"])


def _written(df: DataFrame, path: str, column: str, names: list[str]) -> dict[str, int]:
    """Write as CSV and return the rows per name, counted while they are written."""
    seen = Observation()
    counts = [F.count(F.when(F.col(column) == n, 1)).alias(f"n{i}") for i, n in enumerate(names)] or [F.count(F.lit(1)).alias("n0")]
    csv_writer(df.observe(seen, *counts)).mode("overwrite").csv(path)
    return {n: seen.get[f"n{i}"] for i, n in enumerate(names or [""])}


def dump_tables(co, dir_path: str, encounter_id=None, layout: str = "swan", tables: list[str] | None = None) -> list[str]:
    """SNK-03: write the cohort's slice of each required table (or of ``tables``) as CSV under the original names.

    Beside them goes the manifest: for each table and each name that the cohort and its metrics require, the rows written (0
    shows a name that the extract lacks); tables without a list of names have one line with a blank name. Each
    table is written once, and counted by the same job.
    """
    ids = co.eid if encounter_id is None else encounter_id
    files = LAYOUTS[layout]
    out = {"encounters": (co.encounter_info.join(ids if isinstance(ids, DataFrame) else
                                                 co.db.spark.createDataFrame([(int(i),) for i in ids], "encounter_id bigint"),
                                                 "encounter_id", "left_semi"), [])}
    for table, names in required_names(co).items():
        if names:
            t = co.db.table(table)
            out[table] = (t.sel(**{t.search_col: names, "encounter_id": ids}), names)
    chosen = [t for t in out if tables is None or t in tables]
    paths = {t: os.path.join(dir_path, files[t]) for t in chosen}
    rows = {t: _written(out[t][0], paths[t], co.db.table(t).search_col, out[t][1]) for t in chosen}
    csv_writer(manifest(co.db.spark, rows)).mode("overwrite").csv(os.path.join(dir_path, MANIFEST))
    return list(paths.values())
