"""Value-by-value comparison of two sets of totals, and consistency between metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieout import defaults as D
from tieout.operators.metrics import compare_totals, metric_column


def value_checksum(name: Column, value: Column) -> Column:
    """MD5 of ``name:value`` at two decimals."""
    return F.md5(F.concat_ws(":", name, value.cast("decimal(28,2)").cast("string")))


def value_diff(
    ours: DataFrame,
    target: DataFrame,
    by: list[str] = (),
    tolerance: float = D.TOLERANCE,
    schema_match: bool | None = None,
) -> DataFrame:
    """Delta, percentage, pass/warn/fail and checksum equality per group and metric.

    Within ``tolerance`` passes, within five times that warns. Against a target of zero only an
    equal value passes, and the percentage is null.
    """
    both = compare_totals(ours, target, by)
    delta = (F.col("our_value") - F.col("target_value")).cast("decimal(28,2)")
    rate = F.when(
        F.col("target_value") != 0, delta.cast("double") / F.col("target_value").cast("double")
    ).otherwise(F.when(delta == 0, 0.0))
    status = F.when(F.abs(rate) <= tolerance, "pass").when(F.abs(rate) <= tolerance * 5, "warn").otherwise("fail")
    same = value_checksum(F.col("metric"), F.col("our_value")) == value_checksum(F.col("metric"), F.col("target_value"))
    return both.select(
        *by,
        "metric",
        F.col("our_value").alias("source_val"),
        F.col("target_value").alias("target_val"),
        delta.alias("delta"),
        F.round(rate * 100, 2).alias("delta_pct"),
        status.alias("status"),
        same.alias("checksum_match"),
        F.lit(schema_match).cast("boolean").alias("schema_match"),
    )


def inconsistent_metrics(
    gap_rows: DataFrame, by: list[str] = (), threshold: float = D.GAP_THRESHOLD, derived: dict | None = None
) -> DataFrame:
    """Derived metrics whose gap is not the sum of the gaps of their parts."""
    definitions = derived if derived is not None else D.DERIVED_METRICS
    names = sorted({n for name, parts in definitions.items() for n in (name, *parts)})
    wide = gap_rows.groupBy(*by).agg(*[metric_column(n, "gap").alias(f"_{i}") for i, n in enumerate(names)])
    gap = {n: F.col(f"_{i}") for i, n in enumerate(names)}
    zero = F.lit(0).cast("decimal(28,2)")
    checks = [
        F.struct(
            F.lit(name).alias("derived_metric"),
            gap[name].alias("actual_gap"),
            (F.coalesce(gap[a], zero) + F.coalesce(gap[b], zero)).cast("decimal(28,2)").alias("expected_gap"),
        )
        for name, (a, b) in definitions.items()
    ]
    rows = wide.select(*by, F.inline(F.array(*checks))).filter(F.col("actual_gap").isNotNull())
    rest = (F.col("actual_gap") - F.col("expected_gap")).cast("decimal(28,2)")
    return rows.withColumn("discrepancy", rest).filter(F.abs(rest) > F.lit(str(threshold)).cast("decimal(28,2)"))
