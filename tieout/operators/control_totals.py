"""Control totals after each transformation step, compared with expected totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from tieout import defaults as D
from tieout.scale import pin

Step = tuple[str, Callable[[DataFrame], DataFrame]]
TOTALS = T.StructType(
    [
        T.StructField("step", T.IntegerType(), False),
        T.StructField("step_name", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("total", T.DecimalType(28, 2)),
    ]
)


def _measures(value: str) -> list[Column]:
    total = F.coalesce(F.sum(value).cast("decimal(28,2)"), F.lit(0).cast("decimal(28,2)"))
    return [F.count(F.lit(1)).alias("row_count"), total.alias("total")]


def observed(source: DataFrame, steps: list[Step], value: str = "amount") -> tuple[DataFrame, list[tuple[str, Observation]]]:
    """The result of all steps, and what is observed behind each of them when it is computed once."""
    watched, current = [], source
    for name, apply in steps:
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        current = apply(current).observe(seen, *_measures(value))
        watched.append((name, seen))
    return current, watched


def step_totals(source: DataFrame, steps: list[Step], value: str = "amount") -> DataFrame:
    """Rows and sum after each step: step, step_name, row_count, total; all from one read of ``source``.

    Steps are applied one after another, each to the result of the one before, and rows are counted and summed up as they
    go by. The steps run here, once, whatever their number. A task that has to be repeated after its result was counted
    (an executor was lost behind an exchange) would count twice; if a task failed, totals come from one aggregate per
    step instead. No steps: no rows.
    """
    spark = source.sparkSession
    last, watched = observed(source, steps, value)
    if not watched:
        return spark.createDataFrame([], TOTALS)
    if _run_without_failures(last.select(F.lit(1).alias("one"))):
        rows = [(i, name, seen.get["row_count"], seen.get["total"]) for i, (name, seen) in enumerate(watched, 1)]
        return spark.createDataFrame(rows, TOTALS)
    return _totals_one_by_one(source, steps, value)


def _run_without_failures(df: DataFrame) -> bool:
    """Compute every row of ``df``, keep none, and tell whether all tasks ran once."""
    context, group = df.sparkSession.sparkContext, f"control-totals-{uuid.uuid4().hex}"
    before = [context.getLocalProperty(f"spark.{k}") for k in ("jobGroup.id", "job.description", "job.interruptOnCancel")]
    context.setJobGroup(group, "control totals")
    try:
        df.write.format("noop").mode("overwrite").save()
        status = context.statusTracker()
        stages = [status.getStageInfo(s) for job in status.getJobIdsForGroup(group) for s in (status.getJobInfo(job) or _NO_JOB).stageIds]
        return all(s is None or (s.numFailedTasks == 0 and s.currentAttemptId == 0) for s in stages)
    finally:
        for k, v in zip(("jobGroup.id", "job.description", "job.interruptOnCancel"), before):
            context.setLocalProperty(f"spark.{k}", v)


class _NO_JOB:
    stageIds: list[int] = []


def _totals_one_by_one(source: DataFrame, steps: list[Step], value: str) -> DataFrame:
    frames, current = [], source
    for i, (name, apply) in enumerate(steps, 1):
        current = apply(current)
        frames.append(current.agg(*_measures(value)).select(F.lit(i).alias("step"), F.lit(name).alias("step_name"), "row_count", "total"))
    return reduce(DataFrame.unionByName, frames)


def step_checks(totals: DataFrame, expected: DataFrame, threshold: float = D.GAP_THRESHOLD) -> DataFrame:
    """Difference to the expected total (step_name, expected_total) per step, and whether it is the first too large one."""
    side = expected.select(F.col("step_name").alias("_name"), F.col("expected_total").cast("decimal(28,2)"))
    joined = pin(totals).join(side, F.col("step_name") == F.col("_name"), "left").drop("_name")  # a row per step
    off = F.coalesce(F.abs(F.col("delta")) > F.lit(str(threshold)).cast("decimal(28,2)"), F.lit(False))
    checked = joined.withColumn("delta", (F.col("total") - F.col("expected_total")).cast("decimal(28,2)")).withColumn("is_off", off)
    first = F.min(F.when(F.col("is_off"), F.col("step"))).over(Window.partitionBy())  # over the few rows of steps
    return checked.withColumn("first_off", F.coalesce(F.col("step") == first, F.lit(False)))
