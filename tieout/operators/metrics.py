"""Metric totals, target totals and the gaps between them, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.functions import contains_text, gap_status, is_headline, money, percent
from tieout.operators.enrich import map_accounts, not_intercompany, place_entities
from tieout.scale import per_group, small_side


def base_totals(source: DataFrame, keys: list[str]) -> DataFrame:
    """Amounts summed per account and key before any join, so that no raw row is ever shuffled.

    Partial sums are built where the rows are read; a code that holds a third of all rows reaches
    the shuffle as one row per task.
    """
    keys = list(dict.fromkeys([*keys, "account_code"]))
    return not_intercompany(source).groupBy(*keys).agg(F.sum("amount").alias("amount"))


def category_totals(
    source: DataFrame, mapping: DataFrame, hierarchy: DataFrame | None = None, by: list[str] = ()
) -> DataFrame:
    """Total per group and metric category over mapped, non-intercompany rows."""
    by = list(by)
    placed = hierarchy is not None and bool({"business_unit", "region", "segment"} & set(by))
    natural = [c for c in by if not (placed and c in hierarchy.columns and c != "entity_code")]
    totals = base_totals(source, natural + (["entity_code"] if placed else []))
    mapped = map_accounts(totals, mapping).filter("is_mapped")
    if placed:
        mapped = place_entities(mapped, hierarchy)
    return (
        mapped.filter(F.col("metric_category").isNotNull())
        .groupBy(*by, F.col("metric_category").alias("metric"))
        .agg(F.sum("amount").alias("our_value"))
    )


def derived_weights(derived: dict) -> dict[str, dict[str, int]]:
    """For each derived metric, how often each plain category enters it."""
    weights: dict[str, dict[str, int]] = {}
    for name, parts in derived.items():
        entry: dict[str, int] = {}
        for part in parts:
            for plain, times in weights.get(part, {part: 1}).items():
                entry[plain] = entry.get(plain, 0) + times
        weights[name] = entry
    return weights


def with_derived(totals: DataFrame, by: list[str] = (), derived: dict | None = None) -> DataFrame:
    """Category totals plus the derived metrics, in one aggregation over the category totals.

    Each category row is repeated once per derived metric, weighted by how often it enters it (zero
    when it does not), so a derived metric exists in every group that has any category.
    """
    weights = derived_weights(derived if derived is not None else D.DERIVED_METRICS)
    value, metric = F.col("our_value"), F.col("metric")
    plain = F.when(~metric.isin(*weights), F.struct(metric.alias("metric"), value.alias("our_value")))
    shares = [plain]
    for name, parts in weights.items():
        times = F.coalesce(*[F.when(metric == p, F.lit(n)) for p, n in parts.items()], F.lit(0))
        shares.append(F.struct(F.lit(name).alias("metric"), (value * times).cast("decimal(28,2)").alias("our_value")))
    rows = totals.withColumn("our_value", value.cast("decimal(28,2)")).select(
        *by, F.inline(F.filter(F.array(*shares), lambda s: s.isNotNull()))
    )
    return rows.groupBy(*by, "metric").agg(F.sum("our_value").alias("our_value"))


def our_metrics(
    source: DataFrame,
    mapping: DataFrame,
    hierarchy: DataFrame | None = None,
    by: list[str] = (),
    derived: dict | None = None,
) -> DataFrame:
    return with_derived(category_totals(source, mapping, hierarchy, by), by, derived)


def entity_breakdown(source: DataFrame, mapping: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """Totals per entity, business unit, region and category; rows with a null key are left out."""
    keys = ["entity_code", "business_unit", "region"]
    if hierarchy is None:
        keys = [k for k in keys if k in source.columns]
    totals = category_totals(source, mapping, hierarchy, keys).withColumnRenamed("metric", "metric_category")
    return totals.dropna(subset=[*keys, "metric_category"]).withColumnRenamed("our_value", "our_amount")


def headline_rows(target: DataFrame, by: list[str] = ()) -> DataFrame:
    """Headline rows of each group; a group that has none keeps all its rows."""
    if "group_by" not in target.columns:
        return target
    headline = is_headline(F.col("group_by"))
    if not by:
        found = target.filter(headline)
        return target if found.isEmpty() else found
    known = target.groupBy(*by).agg(F.max(headline).alias("_any"))
    return per_group(target, small_side(known), list(by), ["_any"]).filter(headline | ~F.col("_any")).drop("_any")


def detail_rows(target: DataFrame) -> DataFrame:
    if "row_type" in target.columns:
        return target.filter(F.col("row_type") == "detail")
    return target.filter(~is_headline(F.col("group_by")))


def target_metrics(target: DataFrame, by: list[str] = ()) -> DataFrame:
    """Reported total per group and metric, from headline rows where a group has any.

    The choice is made on sums per metric, so the target is read once and only metric rows are compared.
    """
    by = list(by)
    if "group_by" not in target.columns:
        return target.groupBy(*by, "metric").agg(F.sum("amount").alias("target_value"))
    headline = is_headline(F.col("group_by"))
    sums = target.groupBy(*by, "metric").agg(
        F.sum(F.when(headline, F.col("amount"))).alias("_head"),
        F.max(headline).alias("_has_head"),
        F.sum("amount").alias("_all"),
    )
    group_has = F.max("_has_head").over(Window.partitionBy(*(by or [F.lit(1)])))
    return (
        sums.withColumn("_group_has", group_has)
        .filter(F.col("_has_head") | ~F.col("_group_has"))
        .select(*by, "metric", F.when(F.col("_group_has"), F.col("_head")).otherwise(F.col("_all")).alias("target_value"))
    )


def compare_totals(ours: DataFrame, target: DataFrame, by: list[str] = ()) -> DataFrame:
    """Both sides per group and metric; a missing side is zero.

    An outer join by union and aggregation: null groups match, and only one shuffle of totals is needed.
    """
    keys, zero = [*by, "metric"], F.lit(0).cast("decimal(28,2)")
    left = ours.select(*keys, F.col("our_value").cast("decimal(28,2)").alias("our_value"), zero.alias("target_value"))
    right = target.select(*keys, zero.alias("our_value"), F.col("target_value").cast("decimal(28,2)").alias("target_value"))
    total = lambda c: F.coalesce(F.sum(c).cast("decimal(28,2)"), zero).alias(c)
    return left.unionByName(right).groupBy(*keys).agg(total("our_value"), total("target_value"))


def gaps(
    ours: DataFrame, target: DataFrame, by: list[str] = (), threshold: float = D.GAP_THRESHOLD
) -> DataFrame:
    """Gap, percentage and flag per group and metric. Amounts stay exact decimals."""
    gap = (F.col("our_value") - F.col("target_value")).cast("decimal(28,2)")
    return compare_totals(ours, target, by).select(
        *by,
        "metric",
        "our_value",
        "target_value",
        gap.alias("gap"),
        percent(gap, F.col("target_value")).alias("gap_pct"),
        (F.abs(gap) > F.lit(str(threshold)).cast("decimal(28,2)")).alias("has_gap"),
    )


def gap_summary(
    source: DataFrame,
    mapping: DataFrame,
    target: DataFrame,
    hierarchy: DataFrame | None = None,
    by: list[str] = (),
    threshold: float = D.GAP_THRESHOLD,
    derived: dict | None = None,
) -> DataFrame:
    ours = our_metrics(source, mapping, hierarchy, by, derived)
    return gaps(ours, target_metrics(target, by), by, threshold)


def gap_statuses(gap_rows: DataFrame) -> DataFrame:
    return gap_rows.withColumn("status", gap_status(F.col("gap"), F.col("has_gap")))


def primary_metric(gap_rows: DataFrame, by: list[str] = (), revenue: list[str] = ()) -> DataFrame:
    """One metric per group to look into first: a revenue gap, else the largest gap, else none."""
    is_revenue = contains_text(F.col("metric"), list(revenue) or D.REVENUE_CATEGORIES)
    rank = F.when(F.col("has_gap") & is_revenue, 0).when(F.col("has_gap"), 1).otherwise(2)
    size = F.when(rank == 1, -F.abs(F.col("gap"))).otherwise(F.lit(0).cast("decimal(28,2)"))
    zero = F.lit(0).cast("decimal(28,2)")
    picked = F.min(
        F.struct(rank.alias("rank"), size.alias("size"), "metric", F.when(rank < 2, F.col("gap")).otherwise(zero).alias("gap"))
    )
    return gap_rows.groupBy(*by).agg(picked.alias("p")).select(
        *by, F.col("p.metric").alias("primary_metric"), F.col("p.gap").alias("primary_gap")
    )


def as_report(df: DataFrame, *amounts: str) -> DataFrame:
    """Named decimal columns turned into two-decimal doubles for output."""
    return df.withColumns({c: money(F.col(c)) for c in amounts})


def metric_column(name: str, value: str) -> Column:
    """Value of one metric within a group, null when the group lacks it."""
    return F.max(F.when(F.col("metric") == name, F.col(value)))
