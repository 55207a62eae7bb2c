"""Dataset catalog and table selection (SRC, FIL-01..05, PRJ-01..03, AGG-01/02, CO-01)."""

from __future__ import annotations

import os
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.scalar import is_all_digits
from wardlens.sources import adapter
from wardlens.sources.schemas import LAYOUTS, META, TABLE_NAMES, TableMeta, day_columns


def _semi(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Keep rows whose ``column`` occurs in ``keys`` (a one-column or keyed DataFrame).

    A plain left-semi join: the key set grows with the cohort, so no broadcast is forced;
    AQE broadcasts it only after measuring it under the threshold.
    """
    if column not in keys.columns:
        keys = keys.select(F.col(keys.columns[0]).alias(column))
    return df.join(keys.select(column).distinct(), column, "left_semi")


def filter_isin(df: DataFrame, **filters) -> DataFrame:
    """FIL-01: conjunction of column-in-values predicates; a DataFrame value is a semi join."""
    for col, values in filters.items():
        if values is None:
            continue
        if isinstance(values, DataFrame):
            df = _semi(df, col, values)
        else:
            if isinstance(values, str):
                values = [values]
            df = df.where(F.col(col).isin(list(values)))
    return df


def clean_days(df: DataFrame) -> DataFrame:
    """FIL-02: keep all-digit text in day columns, then type them as INT."""
    for c in day_columns(df.columns):
        # digits beyond INT become null and go too, instead of failing the job
        df = df.where(is_all_digits(F.col(c).cast("string"))).withColumn(c, F.col(c).cast("string").try_cast("int")).where(F.col(c).isNotNull())
    return df


def rebalanced(df: DataFrame, column: str) -> DataFrame:
    """Rows of a key together in few tasks, but a key that holds too much is split over several (AQE)."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE(`{column}`) */ * FROM {{df}}", df=df)


class Table:
    """One clinical extract: a lazy scan plus selection helpers.

    ``source`` is the path the rows come from and ``stem`` the extract's path without its ending, where
    caches of the table are written; both are unset for tables that are not files.
    """

    def __init__(self, meta: TableMeta, df: DataFrame, source: str | None = None, stem: str | None = None):
        self.meta = meta
        self.name = meta.name
        self.search_col = meta.search_col
        self.source, self.stem = source, stem
        # PRJ-01; a cache holds the names in upper case, so that predicates on them reach its files.
        self.df = df if is_clean(df) or not meta.sanitize else df.withColumn(meta.search_col, F.upper(F.col(meta.search_col)))

    def sel(self, values=None, clean=True, pivot=False, pivot_names=None, contains: str | None = None, **filters) -> DataFrame:
        """Select rows by the default column and/or keyword filters (FIL-04).

        ``contains`` keeps rows whose search column holds that text, in the same scan.

        ``values`` filters the search column; keyword filters are combined with it.
        ``None`` filters are ignored. Day columns are cleaned and typed (FIL-02),
        rows without an encounter id dropped (FIL-03).
        """
        if values is not None:
            filters = {**filters, self.search_col: values}
        df = self.df if contains is None else self.df.where(F.upper(F.col(self.search_col)).contains(contains))
        df = filter_isin(df, **{k: v for k, v in filters.items() if v is not None})
        if clean:
            df = clean_days(df)
        if "encounter_id" in df.columns:
            df = df.where(F.col("encounter_id").isNotNull())
        if pivot:
            df = pivot_flowsheet_days(df, pivot_names or filters.get("display_name"))
        return df

    def dictionary(self, column: str | None = None) -> DataFrame:
        """(column, count): the distinct values of a column, nulls left out.

        For a table of files the dictionary is kept beside them, under a name that holds the state of
        the files it was made from; when they change, the next call finds none for the new state and makes one.
        """
        column = column or self.search_col
        made = self.df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
        if not self.stem:
            return made
        spark = self.df.sparkSession
        path = f"{self.stem}.{column}.{files_state(spark, self.source)}.dict"
        kept = _exists_as(spark, path, "parquet")
        if kept is None:
            made.coalesce(DICTIONARY_FILES).write.mode("ignore").parquet(path)
            kept = spark.read.parquet(path)
        return kept

    def search(self, query: str, column: str | None = None) -> DataFrame:
        """FIL-05: distinct values of a column containing ``query`` (case-sensitive)."""
        column = column or self.search_col
        c = F.upper(F.col(column).cast("string")) if column == self.search_col else F.col(column)
        return self.dictionary(column).select(c.alias(column)).distinct().where(F.col(column).contains(query))

    def unique(self, column: str | None = None, count: bool = True) -> DataFrame:
        """AGG-01/02: distinct upper-cased values, optionally with counts (descending)."""
        column = column or self.search_col
        d = self.dictionary(column).withColumn(column, F.upper(F.col(column).cast("string")))
        if not count:
            return d.select(column).distinct()
        return d.groupBy(column).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.col(column))

    def columns(self) -> list[str]:
        return list(self.df.columns)

    def head(self) -> DataFrame:
        return self.df.limit(0)

    def cast(self, column: str, dtype: str) -> DataFrame:
        """PRJ-02: the rows with one column in another type; values that do not parse become null."""
        return self.df.withColumn(column, F.col(column).try_cast(dtype))

    def write(self, path: str | None = None, overwrite: bool = False) -> str:
        """SNK-04: the whole table as Parquet, in its declared types; by default where ``Dataset.from_root`` looks for it.

        The copy is marked as clean and sorted by name within each task, so that its row groups can be skipped by name.
        """
        path = path or self._home(".parquet")
        out = marked_clean(conform(self.df, self.meta.schema))
        out = out.sortWithinPartitions(self.search_col) if self.meta.sanitize else out
        out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        return path

    def partition(self, path: str | None = None, column: str | None = None, overwrite: bool = False) -> str:
        """SNK-01: Parquet copy partitioned on an upper-cased text key; by default where ``Dataset.from_root`` looks for it."""
        path, column = path or self._home(".part"), column or self.search_col
        (rebalanced(self._partitioned(self.df, column), column).write.partitionBy(column)
            .mode("overwrite" if overwrite else "errorifexists").parquet(path))
        return path

    def refresh(self, names: list[str], path: str | None = None, column: str | None = None) -> str:
        """Replace single partitions of the copy with this table's rows of these names; the others are not touched.

        A name without rows here keeps its partition: an extract that lacks a name says nothing about it.
        """
        path, column = path or self._home(".part"), column or self.search_col
        if path == self.source:
            raise ValueError("open the extract with cached=False to refresh its copy")
        rows = self._partitioned(self.df, column).where(F.col(column).isin([n.upper() for n in names]))
        (rebalanced(rows, column).write.partitionBy(column).mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").parquet(path))
        return path

    def _partitioned(self, df: DataFrame, column: str) -> DataFrame:
        df = df.withColumn(column, F.upper(F.col(column).cast("string")))
        declared = set(self.meta.schema.fieldNames()) == set(df.columns)
        return marked_clean(conform(df, self.meta.schema)) if declared and self.meta.sanitize and column == self.search_col else df

    def _home(self, ending: str) -> str:
        if not self.stem:
            raise ValueError(f"{self.name} is not a table of files: give a path")
        return self.stem + ending


def pivot_flowsheet_days(df: DataFrame, names) -> DataFrame:
    """AGG-04: mean numeric flowsheet value per (encounter, day) and display name; blank -> null."""
    names = list(names) if names is not None else None
    v = F.col("flowsheet_value").try_cast("double")
    return (df.withColumn("flowsheet_value", v)
              .groupBy("encounter_id", "flowsheet_days_since_birth")
              .pivot("display_name", names).agg(F.avg("flowsheet_value")))


class Dataset:
    """Seven named clinical tables (SRC-04)."""

    def __init__(self, spark: SparkSession, frames: dict):
        """``frames`` maps table name to a DataFrame or to a function building it (built on
        first use, so a query only analyses the tables it touches)."""
        self.spark = spark
        self._frames = {n: frames[n] for n in TABLE_NAMES if n in frames}
        self._tables: dict[str, Table] = {}
        self.tables = list(self._frames)

    def __getattr__(self, name):
        if name.startswith("_") or name not in self.__dict__.get("_frames", {}):
            raise AttributeError(name)
        return self.table(name)

    # --- constructors -------------------------------------------------------------
    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "Dataset":
        """Adapter views over the TPC-H-like test tables."""
        return cls(spark, {v: (lambda v=v: spark.sql(adapter.spark_view_sql(v, sf_dir))) for v in adapter.VIEWS})

    @classmethod
    def from_root(cls, spark: SparkSession, root: str, layout: str = "swan", cached: bool = True) -> "Dataset":
        """SRC-03/04: per table, a partitioned ``.part`` folder, else ``.parquet``, else the CSV.

        Tables are opened when they are first used; one whose file is missing raises then. ``cached=False`` reads the CSVs.
        """
        return cls(spark, {name: (lambda name=name, fn=fn: open_table(spark, os.path.join(root, fn), META[name], cached))
                           for name, fn in LAYOUTS[layout].items()})

    def table(self, name: str) -> Table:
        if name not in self._tables:
            f = self._frames[name]
            made = f() if callable(f) else f
            self._tables[name] = made if isinstance(made, Table) else Table(META[name], made)
        return self._tables[name]

    def write_cache(self, tables: list[str] | None = None, partitioned: bool = False, overwrite: bool = False) -> list[str]:
        """Write the Parquet (``.part`` if ``partitioned``) form of tables of a root, which ``from_root`` then reads in place of the CSV."""
        return [t.partition(overwrite=overwrite) if partitioned and t.meta.sanitize else t.write(overwrite=overwrite)
                for t in map(self.table, tables or self.tables)]

    # --- CO-01 ----------------------------------------------------------------------
    def sel(self, procedures, labs=None, flowsheet=None, encounter_id=None) -> DataFrame:
        """Procedure-anchored observation extract with relative ``day`` (CO-01)."""
        if labs is None and flowsheet is None:
            raise ValueError("give labs and/or flowsheet names")
        proc = (self.procedures.sel(order_name=list(procedures), encounter_id=encounter_id)
                .select("person_id", "encounter_id", F.col("order_name").alias("procedure"),
                        "days_from_dob_procstart"))
        out = []
        for table, names, day_col in (("labs", labs, "lab_collection_days_since_birth"),
                                      ("flowsheet", flowsheet, "flowsheet_days_since_birth")):
            if names is None:
                continue
            t = self.table(table)
            obs = t.sel(**{t.search_col: list(names)})
            j = obs.join(proc, "encounter_id", "inner").withColumn(
                "day", F.col(day_col) - F.col("days_from_dob_procstart"))
            j = j.withColumnsRenamed(t.meta.rename)
            out.append(j.select("person_id", "encounter_id", "procedure", "days_from_dob_procstart",
                                "days_from_dob", "day", "time", "name", "value"))
        return reduce(lambda a, b: a.unionByName(b), out)

    def create_procedure_cohort(self, procedures, **kwargs):
        from wardlens.plans.cohort import ProcedureCohort
        return ProcedureCohort(self, procedures, **kwargs)

    @contextmanager
    def cohort(self, procedures):
        from wardlens.plans.cohort import ProcedureCohort
        yield ProcedureCohort(self, procedures)


def _exists_as(spark: SparkSession, path: str, fmt: str):
    """The data at ``path``, or None where there is no such path; any other fault is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def conform(df: DataFrame, schema) -> DataFrame:
    """Declared columns by name, in declared types (what does not parse is null), blank text as ``''``.

    The same for every form of a table, so that rows do not depend on which one was read. A
    missing column raises.
    """
    return df.select(*[F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) if f.dataType.typeName() == "string"
                       else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


#: Column metadata of a cache whose search column is in upper case already; Parquet footers keep it.
CLEAN = "wardlens.clean"
#: Files of a value dictionary; distinct names are far fewer than rows.
DICTIONARY_FILES = 8


def marked_clean(df: DataFrame) -> DataFrame:
    """Every column says that the table's rows are as its caches hold them (partition columns are not in the footers)."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={CLEAN: True}) for c in df.columns])


def is_clean(df: DataFrame) -> bool:
    return any(f.metadata.get(CLEAN) for f in df.schema.fields)


def files_state(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of the files under ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    seen = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(seen), F.lit(0)).alias("sum")).first()
    return f"{r['n']}-{int(r['sum']) % 2**64:016x}"


def _read_clean(spark: SparkSession, path: str, found: DataFrame, meta: TableMeta) -> DataFrame:
    """A cache as it is: no expression stands between a predicate and the files.

    The declared schema keeps names of digits text where they are folders; a blank name's folder reads as null.
    """
    df = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True, {CLEAN: True}) for f in meta.schema.fields])).parquet(path)
    in_folders = not found.schema[meta.search_col].metadata.get(CLEAN)
    return df.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if in_folders and f.name == meta.search_col else F.col(f.name)
                       for f in meta.schema.fields])


def _scan(spark: SparkSession, csv_path: str, meta: TableMeta, cached: bool) -> tuple[DataFrame, str]:
    stem = os.path.splitext(csv_path)[0]
    for path in [stem + ".part", stem + ".parquet"] if cached else []:
        df = _exists_as(spark, path, "parquet")
        if df is not None:
            return _read_clean(spark, path, df, meta) if is_clean(df) else conform(df, meta.schema), path
    return read_csv(spark, csv_path, meta), csv_path


def read_table(spark: SparkSession, csv_path: str, meta: TableMeta) -> DataFrame:
    """SRC-01..03: choose the cached Parquet form when present, else scan the CSV.

    A cache that this library wrote is read as it is, any other Parquet like the CSV: in the
    declared types, blank text as ``''``, which is what the clinical code tests against.
    """
    return _scan(spark, csv_path, meta, True)[0]


def open_table(spark: SparkSession, csv_path: str, meta: TableMeta, cached: bool = True) -> Table:
    """``read_table`` as a Table that knows its files; with ``cached=False`` the CSV even where there is a cache."""
    df, source = _scan(spark, csv_path, meta, cached)
    return Table(meta, df, source, os.path.splitext(csv_path)[0])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV (of the first file, if it is a folder)."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_csv_text(spark: SparkSession, paths: str | list[str], header: list[str]) -> DataFrame:
    """All columns as text. Every file must have this very header: one in another order raises instead of giving wrong columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(paths)


def read_csv(spark: SparkSession, path: str, meta: TableMeta) -> DataFrame:
    """Columns are bound by header name; quotes inside quoted text are doubled."""
    return conform(read_csv_text(spark, path, header_of(spark, path)), meta.schema)


def load_table(spark: SparkSession, data_dir: str, file_name: str, fmt: str = "csv", **options) -> DataFrame:
    """SRC-06: load a named file from a folder; a missing path raises ``AnalysisException``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(os.path.join(data_dir, file_name))


class Registry:
    """SRC-05: the auxiliary two-file registry, flat CSV extracts of first and of repeated operations."""

    # Table names.
    NAMES = ("primary", "redo")

    def __init__(self, spark: SparkSession, data_dir: str, files: dict[str, str] | None = None):
        self.spark, self.data_dir = spark, data_dir
        self.files = {n: f"{n}.csv" for n in self.NAMES} | (files or {})

    def primary(self) -> DataFrame:
        return load_table(self.spark, self.data_dir, self.files["primary"])

    def redo(self) -> DataFrame:
        return load_table(self.spark, self.data_dir, self.files["redo"])
