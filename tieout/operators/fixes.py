"""Proposed fixes applied to copies of the tables, and their effect on the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout import defaults as D
from tieout.operators.enrich import PLACES, fold, mapping_keys
from tieout.operators.intercompany import intercompany_summary
from tieout.operators.metrics import gaps, our_metrics, target_metrics
from tieout.scale import pin, small_side

FIXES = {
    "add_mapping": "map the accounts that have no rule",
    "fix_hierarchy": "place entities anew",
    "add_elimination": "eliminate open pairs",
    "add_adjustment": "book an adjustment",
}


def add_mapping(mapping: DataFrame, entries: DataFrame) -> DataFrame:
    """Mapping plus the entries whose account code it lacks."""
    known = mapping_keys(mapping)
    code = entries.source_account_code.cast("string")
    fresh = entries.join(small_side(known), code == known.mapped_code, "left_anti")
    return mapping.unionByName(fresh, allowMissingColumns=True)


def mapping_from_suggestions(suggestions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Chosen fuzzy suggestions as mapping rows that take over the target code of the suggested account."""
    targets = mapping.groupBy(F.col("source_account_code").cast("string").alias("_known")).agg(
        F.min(F.struct("target_account_code", "metric_category")).alias("rule")
    )
    joined = suggestions.join(small_side(targets), suggestions.suggested_code == F.col("_known"))
    return joined.select(
        F.col("source_code").alias("source_account_code"),
        F.col("rule.target_account_code").alias("target_account_code"),
        F.col("suggested_category").alias("metric_category"),
    )


def fix_hierarchy(hierarchy: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace fields of entities; of several updates to one field the last (by ``seq``) counts."""
    fields = [c for c in PLACES if c in hierarchy.columns]
    last = updates.groupBy(F.col("entity_code").alias("_entity")).agg(
        *[
            F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}")
            for f in fields
        ]
    )
    joined = hierarchy.join(small_side(last), F.col("entity_code") == F.col("_entity"), "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in hierarchy.columns]
    )


def add_eliminations(source: DataFrame, entries: DataFrame) -> DataFrame:
    marked = entries.withColumns(
        {"is_intercompany": F.lit(True), "adjustment_flag": F.lit(True), "adjustment_type": F.lit("IC_Elimination")}
    )
    return source.unionByName(marked, allowMissingColumns=True)


def add_adjustments(source: DataFrame, entries: DataFrame) -> DataFrame:
    marked = entries.withColumns(
        {
            "is_intercompany": F.lit(False),
            "adjustment_flag": F.lit(True),
            "adjustment_type": F.col("adjustment_type") if "adjustment_type" in entries.columns else F.lit("Manual"),
        }
    )
    return source.unionByName(marked, allowMissingColumns=True)


def compare_gaps(before: DataFrame, after: DataFrame, by: list[str] = ()) -> DataFrame:
    """Gaps before and after a fix in one row per group and metric."""
    keys, zero = [*by, "metric"], F.lit(0).cast("decimal(28,2)")

    def side(df, our, gap, target):
        values = {"before_our_value": zero, "after_our_value": zero, "target_value": zero, "gap_before": zero, "gap_after": zero}
        values |= {our: F.col("our_value"), gap: F.col("gap")} | ({"target_value": F.col("target_value")} if target else {})
        return df.select(*keys, *[v.cast("decimal(28,2)").alias(n) for n, v in values.items()])

    both = side(before, "before_our_value", "gap_before", True).unionByName(side(after, "after_our_value", "gap_after", False))
    totals = [c for c in both.columns if c not in keys]
    return _with_closed(both.groupBy(*keys).agg(*[F.sum(c).cast("decimal(28,2)").alias(c) for c in totals]))


def _with_closed(rows: DataFrame) -> DataFrame:
    closed = (F.col("gap_before") - F.col("gap_after")).cast("decimal(28,2)")
    rate = F.abs(closed.cast("double") / F.col("gap_before").cast("double") * 100)
    return rows.withColumn("gap_closed", closed).withColumn(
        "gap_closed_pct", F.when(F.col("gap_before") != 0, F.round(rate, 1)).otherwise(0.0)
    )


def _change(fix: str, entries: DataFrame, source: DataFrame, mapping: DataFrame, hierarchy: DataFrame | None) -> list[tuple[int, DataFrame, DataFrame, DataFrame | None]]:
    """What a fix adds to the totals (1) and takes off them (-1): transactions, mapping and hierarchy of the changed part only."""
    if fix == "add_mapping":
        known = mapping_keys(mapping)
        code = entries.source_account_code.cast("string")
        fresh = pin(entries.join(small_side(known), code == known.mapped_code, "left_anti").select("source_account_code", "target_account_code", "metric_category"))
        codes = fresh.select(F.col("source_account_code").cast("string").alias("_code")).distinct()
        return [(1, source.join(codes, F.col("account_code").cast("string") == F.col("_code"), "left_semi"), fresh, hierarchy)]
    if fix == "fix_hierarchy":
        fixed = fix_hierarchy(hierarchy, entries)
        fields = [c for c in PLACES if c in hierarchy.columns]
        named = entries.select(F.col("entity_code").alias("_entity")).distinct()
        part = lambda h: h.join(named, F.col("entity_code") == F.col("_entity"), "left_semi").select("entity_code", *fields)
        rows = source.join(named, F.col("entity_code") == F.col("_entity"), "left_semi")
        return [(1, rows, mapping, part(fixed)), (-1, rows, mapping, part(hierarchy))]
    add = add_eliminations if fix == "add_elimination" else add_adjustments
    return [(1, add(source.where(F.lit(False)), entries), mapping, hierarchy)]


def preview_fix(
    fix: str,
    entries: DataFrame,
    source: DataFrame,
    mapping: DataFrame,
    target: DataFrame,
    hierarchy: DataFrame | None = None,
    by: list[str] = (),
) -> DataFrame:
    """Metrics and gaps before and after a fix. The tables themselves stay as they are.

    Metrics are sums, so what a fix changes is worked out for the accounts, entities or entries that it names, from the
    fold of the transactions, and added to the totals; no other transaction is computed again.
    """
    if fix not in FIXES:
        raise ValueError(f"unknown fix {fix!r}, expected one of {sorted(FIXES)}")
    by = list(by)
    source = pin(fold(source, [k for k in by if k in source.columns]))  # the others are fields of the hierarchy
    zero = F.lit(0).cast("decimal(28,2)")
    before = gaps(our_metrics(source, mapping, hierarchy, by), target_metrics(target, by), by)
    before = before.select(*by, "metric", *[F.coalesce(F.col(c).cast("decimal(28,2)"), zero).alias(c) for c in ("our_value", "target_value")], zero.alias("change"))
    for sign, rows, rules, places in _change(fix, entries, source, mapping, hierarchy):
        moved = our_metrics(rows, rules, places, by)
        change = (F.coalesce(F.col("our_value").cast("decimal(28,2)"), zero) * sign).cast("decimal(28,2)")
        before = before.unionByName(moved.select(*by, "metric", zero.alias("our_value"), zero.alias("target_value"), change.alias("change")))
    totals = before.groupBy(*by, "metric").agg(*[F.sum(c).cast("decimal(28,2)").alias(c) for c in ("our_value", "target_value", "change")])
    after = (F.col("our_value") + F.col("change")).cast("decimal(28,2)")
    gap = (F.col("our_value") - F.col("target_value")).cast("decimal(28,2)")
    rows = totals.select(
        *by, "metric", F.col("our_value").alias("before_our_value"), after.alias("after_our_value"), "target_value", gap.alias("gap_before"),
        (gap + F.col("change")).cast("decimal(28,2)").alias("gap_after"),
    )
    return _with_closed(rows)


def elimination_effect(source: DataFrame, entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Open intercompany balances before and after elimination entries, which metrics never show."""
    keys = list(by)
    pick = lambda df, name: intercompany_summary(df, by=keys).select(*keys, "uneliminated_pair_count", "uneliminated_amount", F.lit(name).alias("state"))
    return pick(source, "before").unionByName(pick(add_eliminations(source, entries), "after"))


def audit_row(preview: DataFrame, fix: str, applied: list[str] = ()) -> DataFrame:
    """Audit entry for a previewed fix: the first headline metric it touches, with its gap before and after."""
    order = F.when(F.col("metric") == "Revenue", 0).when(F.col("metric") == "Operating Profit", 1)
    order = order.when(F.col("metric") == "Gross Margin", 2).otherwise(3)
    picked = preview.agg(
        F.min_by(F.struct(F.abs("gap_before").alias("before"), F.abs("gap_after").alias("after")), F.struct(order, F.col("metric"))).alias("m")
    ).filter(F.col("m").isNotNull())
    return picked.select(
        F.current_timestamp().alias("recorded_at"),
        F.lit(f"Fix: {fix}").alias("step_name"),
        F.lit(FIXES.get(fix, fix)).alias("method_used"),
        F.col("m.before").cast("double").alias("delta_before"),
        F.col("m.after").cast("double").alias("delta_after"),
        (F.col("m.before") - F.col("m.after")).cast("double").alias("gap_closed"),
        F.lit(D.FIX_CONFIDENCE.get(fix, D.OTHER_FIX_CONFIDENCE)).alias("confidence"),
        F.array(*[F.lit(a) for a in applied]).cast("array<string>").alias("fuzzy_suggestions_applied"),
    )
