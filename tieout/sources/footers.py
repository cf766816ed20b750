"""Columns of many Parquet tables, read from file footers by tasks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tieout.sources.types import leaf_columns

COLUMNS = "table_name string, version string, column_name string, data_type string, file_count long"
PER_TASK = 64


class Tables(InputPartition):
    """Some of the tables, as (name, version, path)."""

    def __init__(self, tables: list[list[str]]):
        self.tables = tables


class FooterReader(DataSourceReader):
    def __init__(self, tables: list[list[str]], nested: bool, per_task: int):
        self.tables, self.nested, self.per_task = tables, nested, per_task

    def partitions(self):
        return [Tables(self.tables[i : i + self.per_task]) for i in range(0, len(self.tables), self.per_task)]

    def read(self, partition):
        for name, version, path in partition.tables:
            counted: dict[tuple[str, str], int] = {}
            for schema in schemas(path):
                columns = leaf_columns(schema) if self.nested else [(f.name, f.dataType.simpleString()) for f in schema.fields]
                for column in columns:
                    counted[column] = counted.get(column, 0) + 1
            for (column, kind), files in counted.items():
                yield name, version, column, kind, files


class FooterSource(DataSource):
    """``spark.read.format("parquet_columns")``: options ``tables`` (JSON of [name, version, path]), ``nested``, ``per_task``."""

    @classmethod
    def name(cls):
        return "parquet_columns"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return FooterReader(json.loads(self.options["tables"]), self.options.get("nested", "true") == "true", int(self.options.get("per_task", PER_TASK)))


def schemas(path: str):
    """The schema of each Parquet file at ``path`` (a file, or a folder with files in it); only footers are read."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if "://" in path or path.startswith("file:"):
        store, path = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        store = fs.LocalFileSystem()
    info = store.get_file_info(path)
    if info.type == fs.FileType.Directory:
        found = [x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".parquet")]
    else:
        found = [path]
    for file in sorted(found):
        with store.open_input_file(file) as opened:
            yield spark_schema(pq.read_schema(opened))


def spark_schema(arrow) -> T.StructType:
    """The schema that Spark wrote into the file, or else the one that Spark would read."""
    written = (arrow.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    if written:
        return T.StructType.fromJson(json.loads(written))
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(arrow, prefer_timestamp_ntz=True)


def file_inventory(spark: SparkSession, tables: dict[str, str], version: str, nested: bool = True, per_task: int = PER_TASK) -> DataFrame:
    """Columns and types of Parquet tables (name to path): table_name, version, column_name, data_type, file_count.

    Slices of the paths go to tasks, which list the files and read their footers; the driver sees neither. With ``nested``
    a column that holds structs, arrays or maps has a row for each of its leaves (``leaf_columns``). A column whose type
    differs between files of a table has a row for each type, with the number of files. Paths have to be ones that Arrow's
    file systems open from every executor. A table without files: no rows. No tables: no rows.
    """
    if not tables:
        return spark.createDataFrame([], COLUMNS)
    spark.dataSource.register(FooterSource)
    wanted = json.dumps([[name, version, path] for name, path in tables.items()])
    return spark.read.format("parquet_columns").options(tables=wanted, nested=str(nested).lower(), per_task=per_task).load()
