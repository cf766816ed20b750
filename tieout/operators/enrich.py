"""Joins of transactions with the account mapping and the entity hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieout.scale import small_side

PLACES = ["business_unit", "region", "segment"]


FOLD_KEYS = ["account_code", "entity_code", "counterparty_entity", "is_intercompany", "adjustment_flag", "adjustment_type", *PLACES]


def fold(source: DataFrame, by: list[str] = ()) -> DataFrame:
    """Transactions summed over everything the checks tell apart, with ``row_count``.

    All checks take such a frame in place of the transactions, so an investigation reads those once.
    """
    keys = list(dict.fromkeys([*by, *[c for c in FOLD_KEYS if c in source.columns]]))
    return source.groupBy(*keys).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("row_count"))


def rows_in(df: DataFrame) -> Column:
    """Number of transactions behind a frame, whether folded or not."""
    return F.sum("row_count") if "row_count" in df.columns else F.count(F.lit(1))


def mapping_rules(mapping: DataFrame) -> DataFrame:
    """The mapping columns used for joins; repeated keys stay, as they multiply amounts in reports too."""
    return mapping.select(
        F.col("source_account_code").cast("string").alias("source_account_code"),
        "target_account_code",
        "metric_category",
    )


def mapping_keys(mapping: DataFrame) -> DataFrame:
    """Distinct account codes present in the mapping, whether or not they have a target."""
    return mapping.select(F.col("source_account_code").cast("string").alias("mapped_code")).dropna().distinct()


def map_accounts(source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join on the account code; ``is_mapped`` tells whether a target code was found."""
    rules = mapping_rules(mapping)
    kept = source.drop("source_account_code", "target_account_code", "metric_category", "is_mapped")
    joined = kept.join(small_side(rules), kept.account_code.cast("string") == rules.source_account_code, "left")
    return joined.withColumn("is_mapped", F.col("target_account_code").isNotNull())


def entity_places(hierarchy: DataFrame) -> DataFrame:
    """One row per entity; where an entity occurs twice the smallest set of places is taken."""
    places = [c for c in PLACES if c in hierarchy.columns]
    if not places:
        return hierarchy.select("entity_code").distinct()
    picked = hierarchy.groupBy("entity_code").agg(F.min(F.struct(*places)).alias("place"))
    return picked.select("entity_code", "place.*")


def place_entities(df: DataFrame, hierarchy: DataFrame | None) -> DataFrame:
    """Left join with the hierarchy; only columns the hierarchy has replace those of the transactions."""
    if hierarchy is None or "entity_code" not in hierarchy.columns:
        return df
    places = entity_places(hierarchy)
    kept = df.drop(*[c for c in PLACES if c in places.columns])
    side = small_side(places.withColumnRenamed("entity_code", "_entity"))
    return kept.join(side, kept.entity_code == F.col("_entity"), "left").drop("_entity")


def enrich(source: DataFrame, mapping: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    return place_entities(map_accounts(source, mapping), hierarchy)


def not_intercompany(df: DataFrame) -> DataFrame:
    if "is_intercompany" not in df.columns:
        return df
    return df.filter(~F.coalesce(F.col("is_intercompany"), F.lit(False)))


def reportable(enriched: DataFrame) -> DataFrame:
    """Rows that count towards metrics: mapped and not intercompany."""
    return not_intercompany(enriched).filter("is_mapped")


def without_accounts(df: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """Rows whose account is not among the excluded ones."""
    if excluded is None:
        return df
    codes = excluded.select(F.col("account_code").alias("_excluded")).distinct()
    return df.join(small_side(codes), df.account_code == F.col("_excluded"), "left_anti")


def unmapped_rows(source: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose account code is missing from the mapping; null codes count as missing."""
    keys = mapping_keys(mapping)
    return source.join(small_side(keys), source.account_code == keys.mapped_code, "left_anti")


def mapped_rows(source: DataFrame, mapping: DataFrame) -> DataFrame:
    keys = mapping_keys(mapping)
    return source.join(small_side(keys), source.account_code == keys.mapped_code, "left_semi")
