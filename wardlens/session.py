"""Spark session defaults and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes (a broadcast is only
# chosen after the build side was measured), splits skewed join partitions and coalesces
# small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "wardlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):  # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", "8g")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset (local tests) a scratch
    folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wardlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Intermediate tables that this process has written, in order, and that ``release`` has not removed.
WRITTEN: list[str] = []


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Remove the intermediate tables ``WRITTEN[first:last]``, by default all; results that still read them must have been used before."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in WRITTEN[first:last]]
    removed = sum(p.getFileSystem(hadoop).delete(p, True) for p in paths)
    del WRITTEN[first:last]
    return removed


def discard(spark: SparkSession, path: str) -> None:
    """Remove one intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    WRITTEN.remove(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut a long lineage by writing a Parquet table under the shared checkpoint folder.

    The input is computed once (a reliable RDD checkpoint computes it twice), the copy
    survives executor loss (unlike a local checkpoint, which lives on executor disks), and
    the re-read is a columnar scan with statistics for the optimizer.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"wardlens-mat-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    WRITTEN.append(path)
    return spark.read.parquet(path)
