"""Profiles that are kept per period as sketches and merged for any range of periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

LG_REGISTERS = 14
KLL_K = 400
#: Largest relative error of a merged count of distinct values, three standard errors of 1.04 / sqrt(2 ** 14).
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2)
#: Largest error of the rank of a quantile, for this size of sketch, with a confidence of 99 %.
RANK_ERROR = 0.0083
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def column_sketches(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """One row per group and column: row_count, null_count, distinct and quantile sketch.

    Sketches have a bounded size (about 16 KB and 4 KB), are built where rows are read and merge in any order, so a table
    of them grows with groups and columns only; new periods are added to it, and old ones are never read again. Nulls
    are counted and in no sketch. Quantiles are those of numbers; other columns have none (null). No rows: no rows.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def parts(name):
        kind, value = kinds[name], F.col(name)
        counted = value if isinstance(kind, _EXACT) else value.cast("string")
        numbers = F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_K)) if isinstance(kind, T.NumericType) else F.lit(None).cast("binary")
        return {"rows": F.count(F.lit(1)), "nulls": F.count_if(value.isNull()), "distinct": F.hll_sketch_agg(counted, F.lit(LG_REGISTERS)), "numbers": numbers}

    wide = df.groupBy(*by).agg(*[e.alias(f"{k}:{c}") for c in columns for k, e in parts(c).items() if k != "numbers" or isinstance(kinds[c], T.NumericType)])
    each = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"`rows:{c}`").alias("row_count"), F.col(f"`nulls:{c}`").alias("null_count"), F.col(f"`distinct:{c}`").alias("distinct_sketch"),
            (F.col(f"`numbers:{c}`") if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("binary")).alias("quantile_sketch"),
        )
        for c in columns
    ]
    return wide.select(*by, F.inline(F.array(*each)))


def merged_profile(sketches: DataFrame, by: list[str] = (), quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Counts, approximate distinct values and quantiles per group and column, merged from sketches of any grouping.

    ``distinct_count`` is within ``DISTINCT_ERROR`` of the exact one, with ``distinct_low`` and ``distinct_high`` as these
    limits; the rank of a quantile is within ``RANK_ERROR``. A column without a number has null quantiles.
    """
    merged = sketches.groupBy(*by, "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.kll_merge_agg_double("quantile_sketch").alias("_numbers"),
    )
    low, high = (F.floor(F.col("distinct_count") / (1 + DISTINCT_ERROR)), F.ceil(F.col("distinct_count") / (1 - DISTINCT_ERROR)))
    some = F.coalesce(F.kll_sketch_get_n_double("_numbers"), F.lit(0)) > 0
    values = {f"q{round(q * 100)}": F.when(some, F.kll_sketch_get_quantile_double("_numbers", F.lit(q))) for q in quantiles}
    return merged.withColumns({"distinct_low": low, "distinct_high": high} | values).drop("_numbers")


def exact_profile(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """The same counts exactly, for comparison: every column is exchanged by its values."""
    each = [df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"), F.count_distinct(c).alias("distinct_count")).withColumn("column_name", F.lit(c)) for c in columns]
    return reduce(DataFrame.unionByName, each)
