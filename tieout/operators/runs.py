"""Run history of source and target feeds: latest runs, and differences between the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.operators.overlap import overlapping
from tieout.scale import small_side

RUN_FIELDS = ["task_name", "start_time", "end_time", "status", "parameters", "high_watermark"]


def latest_runs(run_log: DataFrame, keys: list[str] = ("pipeline_id", "side")) -> DataFrame:
    """Newest successful run per feed and side, or the newest run where none succeeded.

    ``max_by`` keeps one run per task and key before the shuffle, so a feed with a long history is
    never sorted in one place. Equal end times are settled by task name.
    """
    succeeded = F.coalesce(F.lower("status").isin(*D.SUCCESS_STATUSES), F.lit(False))
    finished = F.coalesce("end_time", "start_time")
    order = F.struct(succeeded.alias("ok"), finished.alias("at"), F.col("task_name"), F.col("status"))
    runs = run_log.groupBy(*keys).agg(
        F.max_by(F.struct(*RUN_FIELDS), order).alias("run"), F.count(F.lit(1)).alias("task_count")
    )
    return runs.select(
        *keys,
        F.col("run.task_name").alias("task_name"),
        F.coalesce("run.end_time", "run.start_time").alias("last_run_ts"),
        F.coalesce(F.col("run.status"), F.lit("unknown")).alias("last_run_status"),
        F.col("run.parameters").alias("parameters"),
        F.col("run.high_watermark").alias("high_watermark"),
        "task_count",
    )


def recent_tasks(run_log: DataFrame, keys: list[str] = ("pipeline_id", "side"), n: int = D.TOP_N) -> DataFrame:
    """The newest ``n`` tasks per feed and side; ranks are cut in every task before the shuffle."""
    finished = F.coalesce("end_time", "start_time")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(finished.desc(), F.col("task_name").desc()))
    return run_log.select(*keys, "task_name", place.alias("place")).filter(F.col("place") <= n)


def paired_runs(run_log: DataFrame, key: str | list[str] = "pipeline_id") -> DataFrame:
    """Latest run of both sides of every feed in one row; a side may be missing.

    ``key`` may have further columns, as the period of ``in_periods``; then there is one row for each of them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    latest = latest_runs(run_log, [*keys, "side"])
    side = lambda name: F.max_by(F.when(F.col("side") == name, F.struct("last_run_ts", "parameters", "high_watermark")), F.col("side") == name)
    return latest.groupBy(*keys).agg(side("source").alias("source_run"), side("target").alias("target_run"))


def parameter_differences(pairs: DataFrame, key: str = "pipeline_id") -> DataFrame:
    """Parameters whose values differ, or that only one side has. Both maps are in one row, so nothing is joined."""
    ours, theirs = F.col("source_run.parameters"), F.col("target_run.parameters")
    empty = F.lit([]).cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys(ours), empty), F.coalesce(F.map_keys(theirs), empty)))
    rows = pairs.select(key, "source_run", "target_run", F.explode(names).alias("parameter"))
    return rows.select(
        key,
        "parameter",
        F.col("source_run.parameters")[F.col("parameter")].alias("source_value"),
        F.col("target_run.parameters")[F.col("parameter")].alias("target_value"),
    ).filter(~F.col("source_value").eqNullSafe(F.col("target_value")))


def parameter_difference_count(ours, theirs):
    """Number of differing parameters, counted inside the row."""
    empty = F.lit([]).cast("array<string>")
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys(ours), empty), F.coalesce(F.map_keys(theirs), empty)))
    differing = F.filter(names, lambda n: ~F.coalesce(ours[n].eqNullSafe(theirs[n]), F.lit(False)))
    return F.size(differing).cast("long")


def run_checks(pairs: DataFrame, key: str | list[str] = "pipeline_id", seconds: int = D.RUN_GAP_SECONDS) -> DataFrame:
    """Time, parameter and watermark differences per feed (and further keys) with the confidence of the check."""
    keys = [key] if isinstance(key, str) else list(key)
    ours, theirs = F.col("source_run"), F.col("target_run")
    apart = F.abs(F.unix_timestamp(ours.last_run_ts) - F.unix_timestamp(theirs.last_run_ts))
    water = F.round(
        ours.high_watermark.cast("string").try_cast("double") - theirs.high_watermark.cast("string").try_cast("double"), 4
    )
    facts = pairs.select(
        *keys,
        ours.last_run_ts.alias("source_ts"),
        theirs.last_run_ts.alias("target_ts"),
        apart.alias("timestamp_diff_seconds"),
        F.coalesce(apart > seconds, F.lit(False)).alias("timestamp_gap_flag"),
        parameter_difference_count(ours.parameters, theirs.parameters).alias("parameter_diff_count"),
        water.alias("watermark_gap"),
        F.coalesce(water != 0, F.lit(False)).alias("watermark_gap_flag"),
    )
    return facts.withColumn("run_confidence", run_confidence())


def run_confidence():
    """0.5, plus 0.2 when both times are known, plus 0.3 when clean or 0.2 when something was found."""
    timed = F.col("source_ts").isNotNull() & F.col("target_ts").isNotNull()
    clean = ~F.col("timestamp_gap_flag") & (F.col("parameter_diff_count") == 0) & ~F.col("watermark_gap_flag")
    score = F.lit(0.5) + F.when(timed, 0.2).otherwise(0.0) + F.when(clean, 0.3).otherwise(0.2)
    return F.round(F.least(score, F.lit(1.0)), 3)


def in_periods(run_log: DataFrame, periods: DataFrame) -> DataFrame:
    """Every run with each period (period, period_start, period_end; the end belongs to the next one) that it overlaps.

    A run lasts from its start to its end; with one of the two times only it is a moment, and without any it is in no
    period. A run over several periods is in each of them.
    """
    begun, ended = F.coalesce("start_time", "end_time"), F.coalesce("end_time", "start_time")
    runs = run_log.withColumns({"_begun": F.least(begun, ended), "_ended": F.greatest(begun, ended)})
    return overlapping(runs, periods, ("_begun", "_ended"), ("period_start", "period_end")).drop("_begun", "_ended", "period_start", "period_end")


def with_run_times(steps: DataFrame, run_log: DataFrame, keys: list[str] = ("step_name",)) -> DataFrame:
    """Start, end and status of the newest run whose task has the step's name."""
    others = [k for k in keys if k != "step_name"]
    runs = run_log.groupBy(*others, "task_name").agg(
        F.max_by(F.struct("start_time", "end_time", "status"), F.struct("end_time", "start_time", "status")).alias("run")
    )
    side = runs.select(
        *[F.col(k).alias(f"_{k}") for k in others], F.col("task_name").alias("_task"),
        F.col("run.start_time").alias("start_time"), F.col("run.end_time").alias("end_time"),
        F.coalesce(F.col("run.status"), F.lit("unknown")).alias("status"),
    )
    match = F.col("step_name") == F.col("_task")
    for k in others:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return steps.join(small_side(side), match, "left").drop("_task", *[f"_{k}" for k in others])
