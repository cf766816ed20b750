"""Warnings about missing tables, columns and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T


WARNING = T.StructType(
    [T.StructField("check", T.StringType()), T.StructField("table_name", T.StringType()), T.StructField("message", T.StringType())]
)
REQUIRED = {"source": ["account_code"], "mapping": ["source_account_code"], "target": ["metric", "amount"]}


def table_warnings(source: DataFrame, mapping: DataFrame, target: DataFrame) -> DataFrame:
    """Empty tables, missing columns and amounts that are not numbers. No rows means all is well."""
    found = []
    for name, df in (("source", source), ("mapping", mapping), ("target", target)):
        if df.isEmpty():
            found.append(("empty", name, f"{name} has no rows"))
        found += [("missing_column", name, f"{name} has no column {c}") for c in REQUIRED[name] if c not in df.columns]
        if name != "mapping" and "amount" in df.columns and not isinstance(df.schema["amount"].dataType, T.NumericType):
            found.append(("not_numeric", name, f"{name} amount is not a number"))
    return source.sparkSession.createDataFrame(found, WARNING)


def repeated_mapping_keys(mapping: DataFrame) -> DataFrame:
    """Account codes mapped more than once; their amounts count once per row."""
    counts = mapping.filter(F.col("source_account_code").isNotNull()).groupBy("source_account_code")
    return counts.agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def silent_losses(raw: DataFrame, keys: list[str], amount: str = "amount", dates: list[str] = ()) -> DataFrame:
    """Null keys, unreadable amounts and unreadable dates, which loading turns into nulls and zeros."""
    checks = {f"null_{k}": F.col(k).isNull() for k in keys}
    text = F.col(amount).cast("string")
    checks[f"unreadable_{amount}"] = text.isNotNull() & text.try_cast("decimal(18,2)").isNull()
    for d in dates:
        day = F.col(d).cast("string")
        checks[f"unreadable_{d}"] = day.isNotNull() & day.try_cast("timestamp").isNull()
    counts = raw.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).alias("row_count")) for n in checks]
    return counts.select(F.inline(F.array(*rows)))


def quality_report(raw_source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts of silent losses and of mapping keys that occur more than once."""
    keys = [k for k in ("account_code", "entity_code") if k in raw_source.columns]
    dates = ["date"] if "date" in raw_source.columns else []
    repeated = repeated_mapping_keys(mapping).agg(F.count(F.lit(1)).alias("row_count"))
    parts = [silent_losses(raw_source, keys, dates=dates), repeated.select(F.lit("repeated_mapping_key").alias("check"), "row_count")]
    return reduce(DataFrame.unionByName, parts)
