"""Tracing a gap back along the chain of processing stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieout import defaults as D

# Stages of the chain from input to result.
STAGES = ["source_data", "mapping_join", "ic_elimination", "orchestration_timing", "schema_version", "manual_adj"]


def stage_deltas(gap_rows: DataFrame) -> DataFrame:
    """Adds ``nodes``: for each stage, counted back from the result, its delta and share of the gap.

    Uses the evidence columns of the attribution. Timing counts a tenth of the gap when a run-time
    or watermark gap was found; schema drift counts the unmapped share of it.
    """
    gap = F.abs(F.col("gap").cast("double"))
    late = F.when(F.col("timestamp_gap_flag"), gap * 0.10).otherwise(0.0)
    fills = F.col("has_run_findings") & (((late == 0.0) & F.col("timestamp_gap_flag")) | F.col("watermark_gap_flag"))
    drift = gap * F.col("unmapped_ratio")
    manual = F.abs(F.coalesce(F.col("adjustment_amount"), F.lit(0)).cast("double"))
    value = {
        "source_data": F.lit(0.0),
        "mapping_join": F.abs(F.col("unmapped_amount").cast("double")),
        "ic_elimination": F.abs(F.col("uneliminated_amount").cast("double")),
        "orchestration_timing": F.when(fills, gap * 0.10).otherwise(late),
        "schema_version": drift,
        "manual_adj": manual,
    }
    nodes = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(stage).alias("node"),
            F.round(value[stage], 2).alias("delta"),
            F.when(gap > 0, F.abs(value[stage]) / gap).otherwise(0.0).alias("share"),
        )
        for i, stage in enumerate(reversed(STAGES), 1)
    ]
    return gap_rows.withColumn("nodes", F.array(*nodes))


def trace(gap_rows: DataFrame, threshold: float = D.CAUSAL_SHARE) -> DataFrame:
    """Walk back from the result and stop at the first stage with at least ``threshold`` of the gap.

    Without such a stage the largest one is the root cause. A gap of zero has none. All stages of a
    gap are in its row, so nothing is shuffled.
    """
    nodes = F.col("nodes")
    by_share = lambda n: F.struct(F.round(n.share, 4).alias("share"), (-n.ordinal).alias("later"), n.node.alias("node"))
    largest = F.array_max(F.transform(nodes, by_share))
    has_gap = F.col("gap") != 0
    strong = F.filter(nodes, lambda n: n.share >= threshold)
    df = gap_rows.withColumn("_stop", F.try_element_at(strong, F.lit(1)).ordinal)
    found = F.col("_stop").isNotNull()
    hit = F.try_element_at(nodes, F.col("_stop"))
    path = F.when(has_gap, F.filter(nodes, lambda n: F.col("_stop").isNull() | (n.ordinal <= F.col("_stop")))).otherwise(
        F.filter(nodes, lambda n: F.lit(False))
    )
    share = F.when(found, F.round(hit.share, 4)).otherwise(largest.share)
    return df.withColumns(
        {
            "root_cause": F.when(~has_gap, "none").when(found, hit.node).otherwise(largest.node),
            "root_share": F.when(has_gap, share).otherwise(0.0),
            "path": path,
        }
    ).drop("_stop", "nodes")


def path_rows(traced: DataFrame, keys: list[str]) -> DataFrame:
    rows = traced.select(*keys, F.inline("path"))
    return rows.withColumn("contribution_pct", F.round("share", 4)).drop("share")


def confidence_gate(df: DataFrame, trigger: float = D.GATE_TRIGGER) -> DataFrame:
    """Adds the weighted confidence of code, data and run checks, and whether it is too low."""
    overall = F.col("explained_share") * 0.55 + F.col("data_confidence") * 0.25 + F.col("run_confidence") * 0.20
    score = F.round(F.least(overall, F.lit(1.0)), 4)
    return df.withColumn("overall_confidence", score).withColumn("needs_review", score < trigger)
