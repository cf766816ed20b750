"""Table profiles, mapping coverage and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.operators.enrich import mapping_keys, rows_in
from tieout.scale import per_group, small_side


def source_profile(source: DataFrame) -> DataFrame:
    """One row of counts, totals and date range.

    Rows are first folded per account and entity, so the distinct counts run over that small result
    and not over expanded copies of the transactions.
    """
    cols = set(source.columns)
    keys = [c for c in ("account_code", "entity_code") if c in cols]
    parts = {"rows": F.count(F.lit(1))}
    if "amount" in cols:
        parts["amount"] = F.sum("amount")
    if "date" in cols:
        parts |= {"first": F.min("date"), "last": F.max("date")}
    for name, column in (("ic", "is_intercompany"), ("adj", "adjustment_flag")):
        if column in cols:
            parts[name] = F.sum(F.coalesce(F.col(column), F.lit(False)).cast("long"))
    folded = source.groupBy(*keys).agg(*[e.alias(f"_{n}") for n, e in parts.items()])
    none = F.lit(0).cast("long")
    return folded.agg(
        F.coalesce(F.sum("_rows"), none).alias("row_count"),
        (F.sum("_amount") if "amount" in parts else F.lit(0).cast("decimal(28,2)")).alias("total_amount"),
        (F.count_distinct("account_code") if "account_code" in keys else none).alias("unique_accounts"),
        (F.count_distinct("entity_code") if "entity_code" in keys else none).alias("unique_entities"),
        (F.to_date(F.min("_first")).cast("string") if "first" in parts else F.lit(None).cast("string")).alias("date_min"),
        (F.to_date(F.max("_last")).cast("string") if "last" in parts else F.lit(None).cast("string")).alias("date_max"),
        (F.coalesce(F.sum("_ic"), none) if "ic" in parts else none).alias("intercompany_count"),
        (F.coalesce(F.sum("_adj"), none) if "adj" in parts else none).alias("adjustment_count"),
    )


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of nulls per column, for columns that have any; one pass over the table."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return (
        counts.select("_n", F.inline(pairs))
        .filter("nulls > 0")
        .select("column_name", F.round(F.col("nulls") / F.col("_n"), 3).alias("null_rate"))
    )


def value_counts(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Rows per value of several columns in one pass, most frequent first within each column when ``top`` is set."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("column_name", "value")
    counts = counts.agg(F.count(F.lit(1)).alias("row_count"))
    if top is None:
        return counts
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("row_count"), "value"))
    return counts.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place")


def top_by_rows(df: DataFrame, column: str, n: int = D.TOP_N) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), column)
        .limit(n)
    )


def top_by_amount(df: DataFrame, column: str, n: int = D.TOP_N) -> DataFrame:
    """Keys with the largest absolute sum; the amount is that absolute sum."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.abs(F.sum("amount")).alias("amount"))
        .orderBy(F.desc("amount"), column)
        .limit(n)
    )


def mapping_profile(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("source_account_code").alias("unique_source_accounts"),
        F.count_distinct("target_account_code").alias("unique_target_accounts"),
    )


def target_profile(target: DataFrame) -> DataFrame:
    """Rows and total per reported metric."""
    return target.groupBy("metric").agg(F.count(F.lit(1)).alias("row_count"), F.sum("amount").alias("total_amount"))


def hierarchy_profile(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("entity_code").alias("unique_entities"))


def account_presence(source: DataFrame, mapping: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows and amount per group and account code, with ``has_mapping_key``.

    Only one row per account code meets the mapping, so a frequent code costs nothing extra.
    """
    amount = F.sum("amount") if "amount" in source.columns else F.lit(0).cast("decimal(28,2)")
    totals = source.groupBy(*by, "account_code").agg(rows_in(source).alias("row_count"), amount.alias("amount"))
    keys = mapping_keys(mapping)
    joined = totals.join(small_side(keys), totals.account_code == keys.mapped_code, "left")
    return joined.withColumn("has_mapping_key", F.col("mapped_code").isNotNull()).drop("mapped_code")


def mapping_coverage(source: DataFrame, mapping: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of rows with a mapped account, and the rows and amount without one."""
    missing = ~F.col("has_mapping_key")
    none = F.lit(0).cast("long")
    counted = account_presence(source, mapping, by).groupBy(*by).agg(
        F.coalesce(F.sum("row_count"), none).alias("total_transactions"),
        F.coalesce(F.sum(F.when(missing, F.col("row_count"))), none).alias("unmapped_count"),
        F.coalesce(F.sum(F.when(missing, F.col("amount"))), F.lit(0).cast("decimal(28,2)")).alias("unmapped_amount"),
    )
    ratio = F.try_divide(F.col("unmapped_count"), F.col("total_transactions"))
    return counted.select(
        *by,
        "total_transactions",
        "unmapped_count",
        "unmapped_amount",
        F.coalesce(F.round((1 - ratio) * 100, 1), F.lit(100.0)).alias("coverage_pct"),
        F.coalesce(F.round(ratio, 4), F.lit(0.0)).alias("unmapped_ratio"),
    )


def top_unmapped(source: DataFrame, mapping: DataFrame, n: int = D.TOP_N) -> DataFrame:
    """Most frequent account codes that the mapping lacks."""
    return (
        account_presence(source, mapping)
        .filter(~F.col("has_mapping_key") & F.col("account_code").isNotNull())
        .select("account_code", "row_count")
        .orderBy(F.desc("row_count"), "account_code")
        .limit(n)
    )


def schema_hashes(inventory: DataFrame, by: list[str] = ("table_name", "version")) -> DataFrame:
    """Eight hex digits over the sorted columns and types of each table version."""
    columns = F.sort_array(F.collect_list(F.concat_ws(":", "column_name", "data_type")))
    return inventory.groupBy(*by).agg(F.substring(F.md5(F.array_join(columns, ",")), 1, 8).alias("schema_hash"))


def fingerprints(hashes: DataFrame, coverage: DataFrame, by: list[str] = ()) -> DataFrame:
    """Twelve hex digits over the source, mapping and target schema hashes and the coverage of each group."""
    joined = per_group(hashes, coverage, list(by), ["coverage_pct"])
    parts = ["src_hash", "map_hash", "tgt_hash", F.format_string("%.1f", "coverage_pct")]
    text = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])  # a missing hash keeps its place
    return joined.withColumn("fingerprint_hash", F.substring(F.md5(text), 1, 12))
