"""The whole investigation as one set of tables: gaps, evidence, attribution and causal path.

What several tables need (the folded transactions, the gaps, the evidence) is written out before it returns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tieout import defaults as D
from tieout.operators import attribution, causal, contribution, intercompany, mapping_checks, metrics, profile, rollup, runs
from tieout.operators.adjustments import adjusted_entities, adjustment_summary
from tieout.operators.enrich import fold
from tieout.operators.fuzzy import fuzzy_matches
from tieout.operators.outliers import account_amounts, outlier_accounts, outlier_scores
from tieout.scale import per_group, pin


@dataclass(frozen=True)
class Findings:
    gaps: DataFrame
    primary: DataFrame
    contributions: DataFrame
    evidence: DataFrame
    attributed: DataFrame
    components: DataFrame
    summary: DataFrame
    traced: DataFrame
    gate: DataFrame
    details: DataFrame


def run_evidence(checks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Run checks folded per group: which flags occur and the mean confidence."""
    return checks.groupBy(*by).agg(
        F.max(F.col("timestamp_gap_flag") | (F.col("parameter_diff_count") > 0) | F.col("watermark_gap_flag")).alias("has_run_findings"),
        F.round(F.avg(F.col("run_confidence").cast("decimal(10,3)")).cast("double"), 3).alias("run_confidence"),
        F.max("timestamp_gap_flag").alias("timestamp_gap_flag"),
        F.max(F.col("parameter_diff_count") > 0).alias("has_parameter_diffs"),
        F.max("watermark_gap_flag").alias("watermark_gap_flag"),
    )


def component_findings(
    source: DataFrame, mapping: DataFrame, by: list[str] = (), excluded: DataFrame | None = None, run_checks: DataFrame | None = None, n: int = D.TOP_N
) -> DataFrame:
    """What stands behind each component of a gap: group, seq and category of the component, place, finding, amount.

    Unmapped codes, open pairs, feeds with differences (without an amount) and entities with adjustments; the ``n``
    largest of each component, by size and then by name. Run checks count where they name groups, or if there is one
    group in all. All are sums per group before they are ranked.
    """
    by = list(by)
    zero = F.lit(None).cast("decimal(28,2)")

    def part(seq, category, rows, finding, amount):
        return rows.select(*by, F.lit(seq).alias("seq"), F.lit(category).alias("category"), finding.alias("finding"), amount.cast("decimal(28,2)").alias("amount"))

    codes = mapping_checks.unmapped_codes(mapping_checks.unmapped_totals(source, mapping, excluded, by))
    pairs = intercompany.intercompany_findings(source, excluded, by)
    parts = [
        part(1, "Mapping Gap", codes, F.col("account_code"), F.col("total_amount")),
        part(2, "Intercompany Elimination", pairs, F.concat_ws(" / ", "entity", "counterparty"), F.col("net_uneliminated")),
        part(5, "Manual Adjustment", adjusted_entities(source, excluded, [k for k in by if k != "entity_code"]), F.col("entity_code"), F.col("adjustment_amount")),
    ]
    if run_checks is not None and scope_of(run_checks, by) == by:
        differing = run_checks.where(F.col("timestamp_gap_flag") | (F.col("parameter_diff_count") > 0) | F.col("watermark_gap_flag"))
        parts.append(part(3, "Orchestration Timing", differing, F.col("pipeline_id"), zero))
    rows = reduce(DataFrame.unionByName, parts)
    return attribution.drill_down(rows, [*by, "seq"], [F.desc_nulls_last(F.abs("amount")), F.asc("finding")], n)


def scope_of(findings: DataFrame, by: list[str]) -> list[str]:
    """Columns of ``by`` that findings have: the groups that they are about."""
    return [k for k in by if k in findings.columns]


def _folded(rows: DataFrame, by: list[str], findings: DataFrame | None, name: str, value: Column, missing: Column, none: Column | None = None) -> DataFrame:
    """``rows`` with ``value`` over the findings of their group; ``missing`` where there is no check, ``none`` where it found none."""
    if findings is None:
        return rows.withColumn(name, missing)
    scope = scope_of(findings, by)
    rows = per_group(rows, findings.groupBy(*scope).agg(value.alias(name)), scope, [name])
    return rows.withColumn(name, F.coalesce(F.col(name), missing if none is None else none))


@dataclass(frozen=True)
class Scopes:
    """Which groups findings are about; every table is optional.

    ``feeds``: pipeline_id and group columns, for run checks. ``tables``: table_name and group columns, for drift.
    ``periods``: period, period_start and period_end; run checks are then made for each period that runs overlap, if the
    groups have a period. ``regions``: region and group columns, for mismatches. A feed or table may serve several groups.
    """

    feeds: DataFrame | None = None
    tables: DataFrame | None = None
    periods: DataFrame | None = None
    regions: DataFrame | None = None

    def run_checks(self, run_log: DataFrame, by: list[str]) -> DataFrame:
        keys = ["pipeline_id"]
        if self.periods is not None and "period" in by:
            run_log, keys = runs.in_periods(run_log, self.periods), [*keys, "period"]
        checks = runs.run_checks(runs.paired_runs(run_log, keys), keys)
        return _attached(checks, self.feeds, "pipeline_id", by)

    def drift(self, drift: DataFrame, by: list[str]) -> DataFrame:
        return _attached(drift, self.tables, "table_name", by)

    def mismatches(self, mismatches: DataFrame, by: list[str]) -> DataFrame:
        found = mismatches.select(F.col("group").alias("region"))
        return found if self.regions is None else _attached(found, self.regions, "region", by)

    @staticmethod
    def accounts(found: DataFrame, column: str, source: DataFrame, by: list[str]) -> DataFrame:
        """Findings on account codes, once for every group that has the account."""
        have = source.select(*by, F.col("account_code").alias("_account")).distinct()
        return found.join(have, F.col(column) == F.col("_account")).drop("_account")


def _attached(findings: DataFrame, relation: DataFrame | None, key: str, by: list[str]) -> DataFrame:
    if relation is None:
        return findings
    own = [k for k in by if k in relation.columns and k not in findings.columns and k != key]
    side = relation.select(F.col(key).alias("_key"), *own).distinct()
    return findings.join(side, F.col(key) == F.col("_key")).drop("_key")


def gap_evidence(
    gap_rows: DataFrame,
    source: DataFrame,
    mapping: DataFrame,
    by: list[str] = (),
    excluded: DataFrame | None = None,
    run_checks: DataFrame | None = None,
    drift: DataFrame | None = None,
    fuzzy: DataFrame | None = None,
    mismatches: DataFrame | None = None,
    outliers: DataFrame | None = None,
) -> DataFrame:
    """One row per group with its gap and everything the attribution looks at.

    Every check is aggregated to the groups before it is joined, so the joins are between small tables. Run checks,
    drift, near matches, mismatches and outliers that carry columns of ``by`` (see ``Scopes``) count for the groups they
    name, and a group that none of them names has no such evidence; without these columns they count for all groups.
    """
    by = list(by)
    unmapped = mapping_checks.unmapped_totals(source, mapping, excluded, by)
    found = mapping_checks.mapping_gap(unmapped, by)
    rows = per_group(gap_rows, found, by, ["unmapped_account_count", "unmapped_transaction_count", "unmapped_amount"])
    rows = rows.withColumn("has_unmapped", F.coalesce(F.col("unmapped_account_count") > 0, F.lit(False)))
    rows = per_group(rows, profile.mapping_coverage(source, mapping, by), by, ["unmapped_ratio"])
    pairs = intercompany.intercompany_summary(source, excluded, by)
    rows = per_group(rows, pairs, by, ["uneliminated_pair_count", "uneliminated_amount"])
    rows = rows.withColumn("has_open_pairs", F.coalesce(F.col("uneliminated_pair_count") > 0, F.lit(False)))
    rows = per_group(rows, adjustment_summary(source, excluded, by), by, ["adjustment_amount"])
    if run_checks is not None:
        flags = ["has_run_findings", "run_confidence", "timestamp_gap_flag", "has_parameter_diffs", "watermark_gap_flag"]
        scope = scope_of(run_checks, by)
        rows = per_group(rows, run_evidence(run_checks, scope), scope, flags)
        rows = rows.withColumn("run_confidence", F.coalesce("run_confidence", F.lit(0.5))) if scope else rows
    else:
        rows = rows.withColumn("run_confidence", F.lit(0.5))
    some = F.count(F.lit(1)) > 0
    rows = _folded(rows, by, drift, "has_schema_drift", F.max("has_schema_drift"), F.lit(False))
    rows = _folded(rows, by, fuzzy, "has_fuzzy_match", some, F.lit(None).cast("boolean"), F.lit(False))
    rows = _folded(rows, by, mismatches, "has_region_mismatch", some, F.lit(False))
    rows = _folded(rows, by, outliers, "anomalous_count", F.count(F.lit(1)).cast("int"), F.lit(0))
    rows = rows.withColumn("unmapped_ratio", F.coalesce("unmapped_ratio", F.lit(0.0)))
    return attribution.with_evidence(mapping_checks.data_confidence(rows))


def scoped(scopes: Scopes, source: DataFrame, by: list[str], checks, drift, fuzzy, apart, outliers) -> tuple:
    """The findings with the groups that they are about, in the order of ``gap_evidence``."""
    return (
        checks,
        None if drift is None else scopes.drift(drift, by),
        None if fuzzy is None else scopes.accounts(fuzzy, "source_code", source, by),
        None if apart is None else scopes.mismatches(apart, by),
        None if outliers is None else scopes.accounts(outliers.select(F.col("account_code").alias("outlier_code")), "outlier_code", source, by),
    )


def investigate(
    source: DataFrame,
    mapping: DataFrame,
    target: DataFrame,
    hierarchy: DataFrame | None = None,
    by: list[str] = (),
    run_log: DataFrame | None = None,
    drift: DataFrame | None = None,
    fuzzy: DataFrame | None = None,
    outliers: DataFrame | None = None,
    scopes: Scopes | None = None,
    search: bool = False,
) -> Findings:
    """Gaps, then the primary gap of every group with its evidence, components, causal path and confidence.

    The transactions are read once: everything works on their fold, which is written to the shared folder. With ``search``
    near matches of unmapped codes and outlier accounts are looked for here if they are not given. With ``scopes`` the
    evidence of runs, drift, near matches, mismatches and outliers is that of each group; without, one value for all.
    """
    by = list(by)
    source = pin(fold(source, by))
    if search:
        fuzzy = pin(fuzzy_matches(source, mapping)) if fuzzy is None else fuzzy
        outliers = pin(outlier_accounts(outlier_scores(account_amounts(source)))) if outliers is None else outliers
    gap_rows = pin(metrics.gap_summary(source, mapping, target, hierarchy, by))
    primary = metrics.primary_metric(gap_rows, by)
    gap = primary.select(*by, F.col("primary_metric").alias("metric"), F.col("primary_gap").alias("gap"))
    checks = None if run_log is None else (scopes or Scopes()).run_checks(run_log, by)
    apart = rollup.region_mismatches(source, mapping, target, hierarchy) if "group_by" in target.columns else None
    found = (checks, drift, fuzzy, apart, outliers)  # in the order of ``gap_evidence``
    if scopes is not None and by:
        found = scoped(scopes, source, by, *found)
    evidence = pin(gap_evidence(gap, source, mapping, by, outliers, *found))
    scores = contribution.contribution_scores(contribution.account_deltas(source, by), gap, by, outliers)
    explained = contribution.contribution_summary(scores, gap, by)
    keys = [*by, "metric"]
    attributed = attribution.attribute(evidence)
    traced = causal.trace(causal.stage_deltas(evidence))
    gate = causal.confidence_gate(per_group(evidence, explained, by, ["explained_share"]))
    return Findings(
        gaps=gap_rows,
        primary=primary,
        contributions=scores,
        evidence=evidence,
        attributed=attributed,
        components=attribution.component_rows(attributed, keys),
        summary=attribution.attribution_summary(attributed, keys),
        traced=traced,
        gate=gate.select(*keys, "explained_share", "data_confidence", "run_confidence", "overall_confidence", "needs_review"),
        details=component_findings(source, mapping, by, outliers, found[0]),
    )
