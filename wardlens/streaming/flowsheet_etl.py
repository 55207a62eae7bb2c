"""Incremental flowsheet ETL: new CSV extracts in a folder -> partitioned Parquet.

The stream is the list of new files. Each micro-batch reads its files by the header that each of them has, so that
columns in another order are bound by name and a missing one raises, and writes them like the batch ETL into a folder
of its own; a batch that is run again after a failure replaces that folder, so no row is lost or doubled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardlens.sources.dataset import header_of, read_csv_text
from wardlens.sources.sinks import FLOWSHEET_ETL_SCHEMA, write_flowsheet

#: Files of a micro-batch: their paths come to the driver and each header is read on its own.
FILES_PER_BATCH = 100
BATCH = "batch_id"
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                      T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_by_header(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Rows of CSV files as text, each file bound by its own header; None if no file has one."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(header_of(spark, p)), []).append(p)
    names = FLOWSHEET_ETL_SCHEMA.fieldNames()
    frames = [read_csv_text(spark, g, list(h)).select(*names) for h, g in groups.items() if h]
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def start_flowsheet_stream(spark: SparkSession, source_dir: str, output_path: str, checkpoint: str,
                           available_now: bool = True, max_files_per_trigger: int = FILES_PER_BATCH) -> StreamingQuery:
    # Only paths are selected, so the files' contents are not read here.
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir).select("path")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = read_by_header(batch.sparkSession, sorted(r["path"] for r in batch.collect()))
        if rows is not None:
            write_flowsheet(rows, f"{output_path}/{BATCH}={batch_id}")

    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_flowsheet_stream(spark: SparkSession, output_path: str) -> DataFrame:
    """All rows that the stream has written; names and batches are folders, so predicates on names skip the others."""
    fields = [f for f in FLOWSHEET_ETL_SCHEMA.fields if f.name != "display_name"]
    schema = T.StructType([*fields, T.StructField(BATCH, T.LongType()), T.StructField("display_name", T.StringType())])
    return spark.read.schema(schema).parquet(output_path).drop(BATCH).fillna("", ["display_name"])


def run_flowsheet_stream(spark: SparkSession, source_dir: str, output_path: str, checkpoint: str) -> str:
    """Process everything available now and stop."""
    q = start_flowsheet_stream(spark, source_dir, output_path, checkpoint, available_now=True)
    q.awaitTermination()
    return output_path
