"""Regional roll-ups compared with the detail rows of the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout import defaults as D
from tieout.functions import percent
from tieout.operators.enrich import map_accounts, mapping_rules, not_intercompany, place_entities
from tieout.operators.metrics import detail_rows
from tieout.scale import per_group, pin, small_side


def revenue_by_region(source: DataFrame, mapping: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Revenue per region of accounts that have a mapping key; transactions are summed before any join."""
    place = "entity_code" if hierarchy is not None else "region"
    totals = not_intercompany(source).groupBy("account_code", place).agg(F.sum("amount").alias("amount"))
    rules = mapping_rules(mapping)
    joined = totals.join(small_side(rules), totals.account_code == rules.source_account_code)
    revenue = place_entities(joined.filter(F.col("metric_category").rlike(D.REVENUE_PATTERN)), hierarchy)
    return revenue.groupBy("region").agg(F.sum("amount").alias("our_value"))


def revenue_metric(detail: DataFrame) -> DataFrame:
    """The metric compared by region: the first revenue-like name, else the first name."""
    like = F.min(F.when(F.col("metric").rlike(D.REVENUE_PATTERN), F.col("metric")))
    return detail.agg(F.coalesce(like, F.min("metric")).alias("_revenue_metric"))


def region_comparison(
    source: DataFrame, mapping: DataFrame, target: DataFrame, hierarchy: DataFrame | None = None
) -> DataFrame:
    """Reported and own revenue for every region in the target's detail rows."""
    totals = detail_rows(target).groupBy("metric", F.col("group_by").alias("group"))
    totals = pin(totals.agg(F.sum("amount").cast("decimal(28,2)").alias("target_value")))  # a row per metric and group
    marked = per_group(totals, revenue_metric(totals), [], ["_revenue_metric"])
    theirs = marked.filter(F.col("metric") == F.col("_revenue_metric")).drop("_revenue_metric")
    ours = revenue_by_region(source, mapping, hierarchy)
    value = F.coalesce(F.col("our_value"), F.lit(0)).cast("decimal(28,2)")
    gap = (value - F.col("target_value")).cast("decimal(28,2)")
    return theirs.join(ours, F.col("group") == F.col("region"), "left").select(
        "metric", "group", value.alias("our_value"), "target_value", gap.alias("gap"),
        percent(gap, F.col("target_value"), 1).alias("gap_pct"),
    )


def region_mismatches(
    source: DataFrame,
    mapping: DataFrame,
    target: DataFrame,
    hierarchy: DataFrame | None = None,
    threshold: float = D.GAP_THRESHOLD,
) -> DataFrame:
    rows = region_comparison(source, mapping, target, hierarchy)
    return rows.filter(F.abs(F.col("gap")) > F.lit(str(threshold)).cast("decimal(28,2)"))
