"""Helpers that keep plans safe when a side, a group or a lineage grows."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
SLICE_ROWS = 1_000_000
_FOLDERS: set[str] = set()
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[str]] = []


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if a counted size says it fits; otherwise return it as it is.

    The size is counted with one aggregate over the side (never over the fact table). Without the
    mark Spark plans a shuffle join, whose skewed partitions adaptive execution splits.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df.schema))).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def _row_bytes(schema: T.StructType) -> Column:
    widths = []
    for field in schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 16)
        else:
            widths.append(F.lit(16))
    return reduce(lambda a, b: a + b, widths, F.lit(8)).cast("long")


def scratch_folder(spark) -> str:
    """Shared folder named by ``spark.checkpoint.dir``, which every executor has to reach.

    Only where there are no executors but this process (local mode) and no folder is named, one is made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tieout-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def path_of(spark, name: str):
    """Hadoop path of a name, and the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def application_folder(spark) -> str:
    """This application's part of the shared folder; Hadoop removes it when the application ends."""
    path = f"{scratch_folder(spark)}/tieout-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        hadoop, files = path_of(spark, path)
        files.mkdirs(hadoop)
        files.deleteOnExit(hadoop)
        _FOLDERS.add(path)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so later stages neither repeat it nor lose it.

    What the write itself has exchanged is removed from the executors' disks when it ends.
    """
    path = f"{application_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(FILE_CLEANUP, "false")
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FILE_CLEANUP, before)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark):
    """Tables pinned inside the ``with`` block are removed when it ends; results have to be written before.

    Blocks may be nested. Without a block, tables are removed when the application ends.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            hadoop, files = path_of(spark, path)
            files.delete(hadoop, True)


def settled(spark, make) -> DataFrame:
    """What ``make`` gives, pinned; all tables that were pinned on the way to it are removed."""
    with scratch(spark):
        out = pin(make())
        path = _SCOPES[-1].pop()  # only the result stays
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


def per_group(df: DataFrame, one_row: DataFrame, by: list[str], columns: list[str], checked: bool = False) -> DataFrame:
    """Attach the columns of a frame with one row per ``by`` group (one row in all when ``by`` is empty).

    With ``checked`` the frame is broadcast if counted small, so that a group with most of ``df`` is not one partition.
    """
    if by:
        one_row = small_side(one_row) if checked else one_row
        side = one_row.select(*[F.col(k).alias(f"_by_{k}") for k in by], *columns)
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])
        return df.join(side, match, "left").drop(*[f"_by_{k}" for k in by])
    value = one_row.select(F.struct(*columns).alias("v")).scalar()
    return df.withColumn("_one", value).select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in columns])


def running_total(df: DataFrame, by: list[str], order: list, value: str, out: str, slices: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order`` inside each ``by`` group, with no group held by one task.

    Rows are range-partitioned on group and order, so a large group spans many slices. Slice totals
    (at most ``slices`` rows per group) give every slice its starting value. ``order`` has to be a
    total order within the group, and ``value`` a decimal or integer so that the result is exact.
    """
    if slices is None:  # a slice is one window task, so their number follows the rows
        df = pin(df)
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(least, -(-df.count() // SLICE_ROWS))
    ranged = pin(df.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_slice").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_by_{k}") for k in by],
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    match = F.col("_slice") == F.col("_of")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(small_side(offsets), match)
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_slice", "_of", "_before", *[f"_by_{k}" for k in by])
    )
