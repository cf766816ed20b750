"""Writing reports and the audit trail."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tieout.scale import path_of

PARTS, MANIFEST, APPEND = "parts", "manifest", "append"
AUDIT = T.StructType(
    [
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("step_name", T.StringType()),
        T.StructField("method_used", T.StringType()),
        T.StructField("delta_before", T.DoubleType()),
        T.StructField("delta_after", T.DoubleType()),
        T.StructField("gap_closed", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("fuzzy_suggestions_applied", T.ArrayType(T.StringType())),
    ]
)


def write_report(sections: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder per section. CSV cannot hold lists and maps, so those become JSON text there."""
    for name, df in sections.items():
        if kind == "csv":
            nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
            df = df.withColumns({c: F.to_json(c) for c in nested})
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def append_audit(entries: DataFrame, folder: str, key: str | None = None) -> bool:
    """Adds entries to the trail at ``folder``, all or none; whether they were added.

    An append writes its rows to a part of its own and then names the part in the manifest, by a file that can be created
    only once. Readers see named parts only, so tasks that run twice, a call that breaks off and one that is repeated
    with the same ``key`` leave one whole append. Without a key every call is an append of its own.
    """
    spark = entries.sparkSession
    name = hashlib.sha256(key.encode()).hexdigest() if key is not None else uuid.uuid4().hex
    marker, files = path_of(spark, f"{folder}/{MANIFEST}/{name}")
    if files.exists(marker):
        return False
    rows = entries.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AUDIT.fields])
    rows.write.mode("overwrite").parquet(f"{folder}/{PARTS}/{APPEND}={name}")
    return _named(files, marker, name)


def _named(files, marker, name: str) -> bool:
    """Create the manifest's file for a part; false if another call did so first."""
    draft = marker.suffix(f"-{uuid.uuid4().hex}.draft")
    out = files.create(draft, False)
    out.write(bytearray(name.encode()))
    out.close()
    done = not files.exists(marker) and files.rename(draft, marker)
    if not done:
        files.delete(draft, False)
    return done


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of whole appends; a trail that does not exist has none."""
    parts, files = path_of(spark, f"{folder}/{PARTS}")
    manifest, _ = path_of(spark, f"{folder}/{MANIFEST}")
    if not files.exists(parts) or not files.exists(manifest):
        return spark.createDataFrame([], AUDIT)
    rows = spark.read.schema(T.StructType([*AUDIT.fields, T.StructField(APPEND, T.StringType())])).parquet(f"{folder}/{PARTS}")
    named = spark.read.option("pathGlobFilter", "*[!t]").text(f"{folder}/{MANIFEST}").select(F.col("value").alias("_named"))
    return rows.join(named, F.col(APPEND) == F.col("_named"), "left_semi").drop(APPEND)


def reset_audit(spark: SparkSession, folder: str) -> None:
    """Removes all entries; the manifest goes first, so that readers see all of them or none."""
    for name in (MANIFEST, PARTS):
        path, files = path_of(spark, f"{folder}/{name}")
        files.delete(path, True)
