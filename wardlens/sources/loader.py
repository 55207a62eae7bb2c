"""Pluggable loaders (SRC-06, UDF-05): a user's function that reads one file becomes a Spark data source.

Each file (or part of one) is a partition that an executor loads on its own as Arrow batches; equality and
list predicates on columns are handed to the loader, which may leave out parts or rows that cannot match. Spark applies
every predicate again, so a loader that ignores them is still right.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: A part of a file, as the loader's own ``parts`` made it.
Part = tuple


class _Part(InputPartition):
    def __init__(self, value: Part):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, parts, load):
        self.path, self.fields, self.parts, self.load = path, schema.fieldNames(), parts, load
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterable:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            yield f  # Spark checks the rows again

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.parts(self.path, self.wanted)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for batch in self.load(partition.value, self.wanted):
            yield batch.select(self.fields)


def register_loader(spark: SparkSession, name: str, schema: T.StructType | str, load: Callable[[Part, dict], Iterator[pa.RecordBatch]],
                    parts: Callable[[str, dict], Iterable[Part]] | None = None) -> None:
    """Make ``spark.read.format(name).load(path)`` (and ``load_table(..., fmt=name)``) read through ``load``.

    ``parts(path, wanted)`` lists the parts of the input on the driver, by default one ``(file,)`` for each file of a folder;
    ``load(part, wanted)`` runs on an executor and yields the part's Arrow batches with at least the schema's columns. ``wanted`` maps columns
    to the values that the query asks for, where it does. The files must be reachable from every executor.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    list_parts = parts or file_parts

    class Loader(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return fields

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(self.options["path"], schema, list_parts, load)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Loader)


def file_parts(path: str, wanted: dict) -> Iterator[Part]:
    """One part for each file: the path itself, or the files of a folder that are not hidden."""
    if os.path.isdir(path):
        yield from ((os.path.join(path, f),) for f in sorted(os.listdir(path)) if f[0] not in "._")
    else:
        yield (path,)


def row_group_parts(path: str, wanted: dict) -> Iterator[Part]:
    """Parts of Parquet files: (file, row group), without groups whose statistics exclude all wanted values of a column."""
    import pyarrow.parquet as pq

    for (file,) in file_parts(path, wanted):
        meta = pq.ParquetFile(file).metadata
        place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            bounds = {c: group.column(place[c]).statistics for c in wanted if c in place}
            if all(s is None or not s.has_min_max or any(s.min <= v <= s.max for v in wanted[c]) for c, s in bounds.items()):
                yield file, g


def load_row_group(part: Part, wanted: dict) -> Iterator[pa.RecordBatch]:
    """The batches of one row group."""
    import pyarrow.parquet as pq

    file, group = part
    yield from pq.ParquetFile(file).iter_batches(row_groups=[group])


def register_parquet_loader(spark: SparkSession, name: str, schema: T.StructType | str) -> None:
    """A loader of Parquet files by row group, as an example of one with its own parts and skipping."""
    register_loader(spark, name, schema, load_row_group, row_group_parts)
