"""Manual adjustments among the transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout.operators.enrich import rows_in, without_accounts


def adjustment_rows(source: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    return without_accounts(source.filter(F.coalesce(F.col("adjustment_flag"), F.lit(False))), excluded)


def adjustment_summary(source: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Adjustments, amount and number of entities per group. The amount is also what a target lacks at most."""
    folded = adjustment_rows(source, excluded).groupBy(*by, "entity_code").agg(
        rows_in(source).alias("n"), F.sum("amount").alias("amount")
    )
    none, zero = F.lit(0).cast("long"), F.lit(0).cast("decimal(28,2)")
    amount = F.coalesce(F.sum("amount").cast("decimal(28,2)"), zero)
    return folded.groupBy(*by).agg(
        F.coalesce(F.sum("n"), none).alias("adjustment_count"),
        amount.alias("adjustment_amount"),
        F.count_distinct("entity_code").alias("entities_affected"),
        amount.alias("implied_target_adjustment"),
    )


def adjustments_by_type(source: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    rows = adjustment_rows(source, excluded).filter(F.col("adjustment_type").isNotNull())
    return rows.groupBy(*by, "adjustment_type").agg(
        rows_in(source).alias("adjustment_count"), F.sum("amount").alias("adjustment_amount")
    )


def adjusted_entities(source: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Entities with adjustments, one row each."""
    rows = adjustment_rows(source, excluded).filter(F.col("entity_code").isNotNull())
    return rows.groupBy(*by, "entity_code").agg(
        rows_in(source).alias("adjustment_count"), F.sum("amount").alias("adjustment_amount")
    )
