"""Checks on accounts the mapping lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout import defaults as D
from tieout.operators.enrich import rows_in, unmapped_rows, without_accounts


def unmapped_totals(
    source: DataFrame, mapping: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()
) -> DataFrame:
    """Rows, amounts and sum per account code the mapping lacks (and group); null codes form one row."""
    with_amount = F.sum("row_count") if "row_count" in source.columns else F.count("amount")
    totals = source.groupBy(*by, "account_code").agg(
        rows_in(source).alias("row_count"), with_amount.alias("transaction_count"), F.sum("amount").alias("total_amount")
    )
    return without_accounts(unmapped_rows(totals, mapping), excluded)


def unmapped_codes(totals: DataFrame) -> DataFrame:
    """Findings: transactions, sum and mean per unmapped account code. Rows without a code stay in the totals only."""
    mean = F.col("total_amount").cast("double") / F.col("transaction_count")
    return totals.filter(F.col("account_code").isNotNull()).withColumn("avg_amount", F.round(mean, 2)).drop("row_count")


def mapping_gap(totals: DataFrame, by: list[str] = ()) -> DataFrame:
    """Unmapped accounts, transactions and amount per group, with a checksum of the findings."""
    none = F.lit(0).cast("long")
    return totals.groupBy(*by).agg(
        F.count("account_code").alias("unmapped_account_count"),
        F.coalesce(F.sum(F.when(F.col("account_code").isNotNull(), F.col("row_count"))), none).alias("unmapped_transaction_count"),
        F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(28,2)")).alias("unmapped_amount"),
        findings_checksum().alias("checksum"),
    )


def finding_checksum():
    """MD5 of ``code:amount`` of one finding."""
    return F.md5(F.concat_ws(":", "account_code", F.col("total_amount").cast("decimal(28,2)").cast("string")))


def findings_checksum():
    """MD5 over all findings of a group, whatever their order or number.

    Both halves of every finding's MD5 are added up as whole numbers, which merges from partial sums; no
    list of findings is ever held in one place.
    """
    totals = []
    for first in (1, 17):
        half = F.conv(F.substring(finding_checksum(), first, 16), 16, 10).cast("decimal(28,0)")
        found = F.when(F.col("account_code").isNotNull(), half)
        totals.append(F.coalesce(F.sum(found), F.lit(0)).cast("string"))
    return F.md5(F.concat_ws(":", F.count("account_code").cast("string"), *totals))


def suggested_mapping(findings: DataFrame, default_category: str = D.DEFAULT_CATEGORY) -> DataFrame:
    """Mapping rows that would cover the unmapped codes; the category is a guess to be verified."""
    return findings.select(
        F.col("account_code").alias("source_account_code"),
        F.concat(F.lit("TGT_"), F.col("account_code")).alias("target_account_code"),
        F.lit(default_category).alias("metric_category"),
    ).distinct()


def data_confidence(df: DataFrame) -> DataFrame:
    """Adds ``data_confidence`` from ``unmapped_ratio``, ``has_schema_drift`` and ``has_fuzzy_match``.

    A null flag stands for a check that was not run; it takes nothing off.
    """
    score = (
        F.lit(1.0)
        - F.when(F.col("unmapped_ratio") > 0.05, 0.3).otherwise(0.0)
        - F.when(F.col("has_schema_drift"), 0.2).otherwise(0.0)
        - F.when(~F.col("has_fuzzy_match"), 0.1).otherwise(0.0)  # a null flag takes nothing off
    )
    return df.withColumn("data_confidence", F.round(F.greatest(score, F.lit(0.0)), 3))
