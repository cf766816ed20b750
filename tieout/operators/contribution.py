"""Which accounts make up a gap, largest first, until most of it is explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.operators.enrich import without_accounts
from tieout.scale import per_group, pin, running_total, small_side


def account_deltas(source: DataFrame, by: list[str] = ()) -> DataFrame:
    """Whole amount per account and group."""
    rows = source.filter(F.col("account_code").isNotNull())
    return rows.groupBy(*by, "account_code").agg(F.sum("amount").alias("delta"))


def contribution_scores(
    deltas: DataFrame,
    gap_rows: DataFrame,
    by: list[str] = (),
    excluded: DataFrame | None = None,
    priorities: DataFrame | None = None,
    stop: float = D.STOP_SHARE,
) -> DataFrame:
    """Accounts up to and including the one whose running share of the gap reaches ``stop``.

    ``gap_rows`` has one ``gap`` per group. ``priorities`` (account_code, rank) puts accounts first.
    The running sum is exact and split over tasks, whatever the number of accounts in a group. Amounts are first added
    up by rank and power of two, a few dozen rows per group, which shows the size at which the share is reached; accounts
    below it are in no result and are not sorted.
    """
    by = list(by)
    scored = per_group(without_accounts(deltas, excluded), gap_rows, by, ["gap"], checked=True)
    scored = scored.filter(F.abs(F.col("gap")) >= D.NOISE_FLOOR).withColumn("abs_delta", F.abs(F.col("delta")))
    order = [F.col("abs_delta").desc(), F.col("account_code").asc()]
    if priorities is not None:
        first = priorities.groupBy(F.col("account_code").alias("_first")).agg(F.min("rank").alias("_rank"))
        scored = scored.join(first, F.col("account_code") == F.col("_first"), "left").drop("_first")
        scored = scored.withColumn("_rank", F.coalesce(F.col("_rank").cast("long"), F.lit(2**62)))
        order = [F.col("_rank").asc(), *order]
    scored = _deciding(pin(scored.filter(F.col("delta").isNotNull())), by, stop)
    summed = running_total(scored, by, order, "abs_delta", "cumulative").drop("_rank")
    size = F.abs(F.col("gap")).cast("double")
    share = F.col("delta").cast("double") / F.col("gap").cast("double")
    return (
        summed.filter((F.col("cumulative") - F.col("abs_delta")).cast("double") / size < stop)
        .withColumn("contribution_pct", F.round(share * 100, 2))
        .withColumn("cumulative_share", F.col("cumulative").cast("double") / size)
        .drop("abs_delta", "cumulative")
    )


def _deciding(scored: DataFrame, by: list[str], stop: float) -> DataFrame:
    """Rows of every group down to the rank and power of two in which ``stop`` is reached."""
    power = F.when(F.col("abs_delta") > 0, F.floor(F.log2(F.col("abs_delta").cast("double")))).otherwise(-99).cast("int")
    rank = F.col("_rank") if "_rank" in scored.columns else F.lit(0).cast("long")
    scored = scored.withColumns({"_power": power, "_first": rank})
    totals = scored.groupBy(*by, "_first", "_power").agg(F.sum("abs_delta").alias("_total"), F.max(F.abs("gap")).alias("_size"))
    before = Window.partitionBy(*by).orderBy(F.asc("_first"), F.desc("_power")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("double") / F.col("_size").cast("double")
    wanted = totals.withColumn("_reached", reached).filter(F.col("_reached") < stop)
    side = small_side(wanted.select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col("_first").alias("_f"), F.col("_power").alias("_p")))
    match = (F.col("_first") == F.col("_f")) & (F.col("_power") == F.col("_p"))
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return scored.join(side, match, "left_semi").drop("_power", "_first")


def contribution_summary(scores: DataFrame, gap_rows: DataFrame, by: list[str] = (), stop: float = D.STOP_SHARE) -> DataFrame:
    """Explained share of the gap (0 to 1) per group, and whether the scoring could stop early."""
    by = list(by)
    reached = scores.groupBy(*by).agg(F.max("cumulative_share").alias("_reached"))
    joined = per_group(gap_rows.select(*by, "gap"), reached, by, ["_reached"])
    noise = F.abs(F.col("gap")) < D.NOISE_FLOOR
    got = F.coalesce(F.col("_reached"), F.lit(0.0))
    return joined.select(
        *by,
        "gap",
        F.when(noise, 1.0).otherwise(F.round(F.least(got, F.lit(1.0)), 4)).alias("explained_share"),
        (noise | (got >= stop)).alias("stopped_early"),
    )
