"""Differences between two versions of a column inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _both_versions(inventory: DataFrame, old: str, new: str) -> DataFrame:
    """Types of both versions side by side, from one aggregation instead of a join."""
    return (
        inventory.filter(F.col("version").isin(old, new))
        .groupBy("table_name", "column_name")
        .agg(
            F.max(F.when(F.col("version") == old, F.col("data_type"))).alias("old_type"),
            F.max(F.when(F.col("version") == new, F.col("data_type"))).alias("new_type"),
        )
    )


def missing_columns(inventory: DataFrame, old: str, new: str) -> DataFrame:
    sides = _both_versions(inventory, old, new).filter(F.col("old_type").isNull() | F.col("new_type").isNull())
    where = F.when(F.col("old_type").isNull(), F.lit(old)).otherwise(F.lit(new))
    return sides.select("table_name", "column_name", where.alias("missing_in"))


def type_drift(inventory: DataFrame, old: str, new: str) -> DataFrame:
    return _both_versions(inventory, old, new).filter("old_type != new_type")


def schema_drift(inventory: DataFrame, old: str, new: str) -> DataFrame:
    """Per table: columns missing on either side, columns whose type changed, and whether anything drifted."""
    missing = F.col("old_type").isNull() | F.col("new_type").isNull()
    counts = _both_versions(inventory, old, new).groupBy("table_name").agg(
        F.count_if(missing).alias("missing_columns"),
        F.count_if(F.col("old_type") != F.col("new_type")).alias("changed_types"),
    )
    return counts.withColumn("has_schema_drift", (F.col("missing_columns") > 0) | (F.col("changed_types") > 0))
