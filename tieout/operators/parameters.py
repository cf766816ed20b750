"""Run parameters with nested values, compared leaf by leaf."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tieout.scale import pin


def leaf_text(value: Column) -> Column:
    """A leaf of a VARIANT as text: numbers without regard to how they are written (1, 1.0, 1e0), texts in quotes."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exact = number.isNotNull() & (number.cast("double") == F.try_variant_get(value, "$", "double"))
    numeric = F.when(exact, plain).otherwise(F.try_variant_get(value, "$", "double").cast("string"))
    return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), numeric).otherwise(F.to_json(value))


def parameter_leaves(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, parameter, value: one row per leaf of the JSON text in ``column``.

    Fields are joined by dots, elements numbered from zero in brackets; the order of fields does not matter. Objects and
    arrays are taken apart level by level, all rows at once, until none is left; empty ones are leaves. A null or a text
    that is no JSON has no leaves. A value that is no object or array has one leaf with an empty name.
    """
    spark = rows.sparkSession
    level = rows.select(*keys, F.lit("").alias("parameter"), F.try_parse_json(F.col(column)).alias("_value")).where("_value IS NOT NULL")
    found = []
    while True:
        kind = F.schema_of_variant("_value")
        whole = kind.rlike("^(OBJECT|ARRAY)<") & ~kind.isin("OBJECT<>", "ARRAY<VOID>") | (kind == "ARRAY<VOID>") & (F.to_json("_value") != "[]")
        level = pin(level.withColumn("_text", F.to_json("_value")).withColumn("_whole", whole).withColumn("_leaf", leaf_text(F.col("_value"))).drop("_value"))
        found.append(level.where("NOT _whole").select(*keys, "parameter", F.col("_leaf").alias("value")))
        inner = level.where("_whole")
        if inner.isEmpty():
            return reduce(DataFrame.union, found)
        parts = inner.withColumn("_value", F.parse_json("_text")).lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        name = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("parameter") != "", ".").otherwise(""), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = parts.select(*keys, F.concat("parameter", name).alias("parameter"), F.col("value").alias("_value"))


def nested_differences(pairs: DataFrame, keys: list[str], source: str = "source_parameters", target: str = "target_parameters") -> DataFrame:
    """keys, parameter, source_value, target_value for every leaf that differs or that only one side has.

    Both sides are brought together by one aggregation. A null value differs from a missing one.
    """
    ours = parameter_leaves(pairs, source, keys).withColumn("_ours", F.lit(True))
    theirs = parameter_leaves(pairs, target, keys).withColumn("_ours", F.lit(False))
    both = ours.union(theirs).groupBy(*keys, "parameter").agg(F.max(F.when(F.col("_ours"), F.col("value"))).alias("source_value"), F.max(F.when(~F.col("_ours"), F.col("value"))).alias("target_value"))
    return both.where(~F.col("source_value").eqNullSafe(F.col("target_value")))
