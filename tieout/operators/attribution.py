"""Ordered attribution of every gap to its causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.functions import confidence_label

# Evidence columns and the value each has when a gap row lacks it.
EVIDENCE = {
    "has_unmapped": False,
    "unmapped_amount": 0.0,
    "has_open_pairs": False,
    "uneliminated_amount": 0.0,
    "has_run_findings": False,
    "run_confidence": 0.0,
    "timestamp_gap_flag": False,
    "has_parameter_diffs": False,
    "watermark_gap_flag": False,
    "has_schema_drift": False,
    "unmapped_ratio": 0.0,
    "data_confidence": 0.5,
    "has_region_mismatch": False,
    "anomalous_count": 0,
}
AUTO_FIXES = ["add_mapping", "add_elimination", "fix_orchestration", "fix_hierarchy"]


def with_evidence(gap_rows: DataFrame) -> DataFrame:
    """Fill in evidence columns that are missing or null."""
    def value(name, default):
        plain = F.lit(default)
        if name not in gap_rows.columns:
            return plain
        return F.coalesce(F.col(name).cast("double") if isinstance(default, float) else F.col(name), plain)

    return gap_rows.withColumns({n: value(n, d) for n, d in EVIDENCE.items()})


COMPONENT = (
    "struct<seq:int,category:string,amount:double,pct_of_gap:double,confidence:double,fix_type:string,check_type:string>"
)


def attribute(gap_rows: DataFrame) -> DataFrame:
    """Adds ``components`` to every gap row: what each cause takes of the gap that is left, in fixed order.

    A cause asks for an amount, or for a share of what is left, and gets at most what is left. Every
    gap is one row with its evidence and the causes are folded inside the row, so this needs no shuffle
    and grows with the number of gaps.
    """
    df = with_evidence(gap_rows)
    none = F.lit(None).cast("string")
    late = ((F.col("run_confidence") > 0.3) & F.col("timestamp_gap_flag")) | F.col("has_parameter_diffs") | F.col("watermark_gap_flag")
    causes = F.array(
        _cause(1, "Mapping Gap", F.col("unmapped_amount"), False, F.col("has_unmapped"), F.lit(D.CONFIDENCE["mapping_gap"]), "add_mapping", "type1_code", always=True),
        _cause(2, "Intercompany Elimination", F.col("uneliminated_amount"), False, F.col("has_open_pairs"), F.lit(D.CONFIDENCE["intercompany"]), "add_elimination", "type1_code"),
        _cause(3, "Orchestration Timing", F.least(F.col("run_confidence") * 0.5, F.lit(0.30)), True, F.col("has_run_findings") & late, F.round("run_confidence", 3), "fix_orchestration", "type3_orchestration"),
        _cause(4, "Schema / Mapping Drift", F.least(F.col("unmapped_ratio"), F.lit(0.20)), True, F.col("has_schema_drift") & (F.col("unmapped_ratio") > 0.01), F.round("data_confidence", 3), "add_mapping", "type2_data"),
        _cause(5, "Manual Adjustment", F.lit(1.0), True, F.lit(True), F.lit(D.CONFIDENCE["manual_adjustment"]), "add_adjustment", "type1_code"),
    )
    gap = F.round(F.col("gap").cast("double"), 2)
    start = F.struct(
        gap.alias("gap"),
        F.when(gap < 0, -1.0).otherwise(1.0).alias("sign"),
        gap.alias("left"),
        F.lit(0.0).alias("explained"),
        F.array().cast(f"array<{COMPONENT}>").alias("found"),
    )

    def take(acc, cause):
        asked = acc.sign * F.abs(F.when(cause.is_share, F.abs(acc.left) * cause.size).otherwise(cause.size))
        amount = F.when(F.abs(asked) > F.abs(acc.left), acc.left).otherwise(asked)
        counts = cause.allowed & (cause.always | ((F.abs(acc.left) > 1.0) & (F.abs(amount) > 1.0)))
        rounded = F.round(amount, 2)
        part = _component(acc.gap, cause.seq, cause.category, amount, cause.confidence, cause.fix_type, cause.check_type)
        return F.struct(
            acc.gap.alias("gap"),
            acc.sign.alias("sign"),
            F.when(counts, acc.left - amount).otherwise(acc.left).alias("left"),
            F.when(counts & (F.abs(rounded) > 0.01), acc.explained + rounded).otherwise(acc.explained).alias("explained"),
            F.when(counts, F.concat(acc.found, F.array(part))).otherwise(acc.found).alias("found"),
        )

    def finish(acc):
        zero, rest = F.lit(0.0), acc.gap - acc.explained
        notes = [
            F.when(F.col("has_region_mismatch"), _component(acc.gap, F.lit(6), F.lit("Hierarchy Mismatch"), zero, F.lit(D.CONFIDENCE["hierarchy"]), F.lit("fix_hierarchy"), F.lit("type2_data"))),
            F.when(F.col("anomalous_count") > 0, _component(acc.gap, F.lit(7), F.lit("Anomalous Accounts"), zero, F.lit(0.5), none, F.lit("type1_code"))),
            F.when(F.abs(rest) > 0.01, _component(acc.gap, F.lit(8), F.lit("Unexplained Residual"), rest, zero, none, none)),
        ]
        return F.concat(acc.found, F.filter(F.array(*notes), lambda n: n.isNotNull()))

    return df.withColumn("components", F.aggregate(causes, start, take, finish))


def _cause(
    seq: int, name: str, size: Column, is_share: bool, allowed: Column, confidence: Column, fix: str, check: str, always: bool = False
) -> Column:
    """A cause and what it asks for. Unless ``always``, it counts only above one unit of an open gap."""
    return F.struct(
        F.lit(seq).alias("seq"), F.lit(name).alias("category"), size.alias("size"), F.lit(is_share).alias("is_share"),
        allowed.alias("allowed"), F.lit(always).alias("always"), confidence.alias("confidence"),
        F.lit(fix).alias("fix_type"), F.lit(check).alias("check_type"),
    )


def _component(gap: Column, seq: Column, name: Column, amount: Column, confidence: Column, fix: Column, check: Column) -> Column:
    share = F.when(gap != 0, F.round(amount / gap * 100, 1)).otherwise(0.0)
    return F.struct(
        seq.alias("seq"), name.alias("category"), F.round(amount, 2).alias("amount"), share.alias("pct_of_gap"),
        confidence.alias("confidence"), fix.alias("fix_type"), check.alias("check_type"),
    )


def component_rows(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per gap and component, with a High/Medium/Low label of its confidence."""
    # The outer form keeps Spark from computing the components a second time for a filter on their number.
    rows = attributed.select(*keys, F.inline_outer("components")).filter(F.col("seq").isNotNull())
    return rows.withColumn("confidence_label", confidence_label(F.col("confidence")))


def attribution_summary(attributed: DataFrame, keys: list[str]) -> DataFrame:
    """Explained share, amount-weighted confidence and automatically fixable share of every gap."""
    def total(keep, value):
        chosen = F.filter("components", lambda c: (F.abs(c.amount) > 0.01) & keep(c))
        return F.aggregate(chosen, F.lit(0.0), lambda acc, c: acc + value(c))

    gap = F.round(F.col("gap").cast("double"), 2)
    size = F.abs(gap)
    rest = F.abs(gap - total(lambda c: c.category != "Unexplained Residual", lambda c: c.amount))
    sure = lambda c: c.confidence > 0
    weight = total(sure, lambda c: F.abs(c.amount))
    weighted = total(sure, lambda c: c.confidence * F.abs(c.amount))
    fixable = total(lambda c: F.coalesce(c.fix_type.isin(*AUTO_FIXES), F.lit(False)), lambda c: F.abs(c.amount))
    explained = F.when(size != 0, F.round((1 - rest / size) * 100, 1)).otherwise(100.0)
    return attributed.select(
        *keys,
        gap.alias("total_gap"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), explained)).alias("explained_pct"),
        F.when(weight > 0, F.round(weighted / weight * 100, 1)).otherwise(0.0).alias("overall_confidence"),
        F.when(size != 0, F.round(fixable / size * 100, 1)).otherwise(0.0).alias("auto_fixable_pct"),
    )


def waterfall(findings: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Running total and direction over the few findings of each gap."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return findings.withColumn("running_total", F.round(F.sum("amount").over(so_far), 2)).withColumn(
        "direction", F.when(F.col("amount") < 0, "negative").otherwise("positive")
    )


def cause_shares(findings: DataFrame, by: list[str]) -> DataFrame:
    """Share of each cause in the absolute amount of its gap; causes without an amount are left out."""
    sums = findings.groupBy(*by, "category").agg(F.sum(F.abs("amount")).alias("amount")).filter("amount > 0")
    whole = F.sum("amount").over(Window.partitionBy(*(by or [F.lit(1)])))
    return sums.withColumn("share", F.round(F.col("amount") / whole, 4))


def drill_down(findings: DataFrame, by: list[str], order: list, n: int = D.TOP_N) -> DataFrame:
    """The first ``n`` findings of each component; ranks are cut in every task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return findings.withColumn("place", place).filter(F.col("place") <= n)
