"""Rows of two tables whose time spans overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BUCKET_SECONDS = 24 * 3600


def overlapping(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    keys: list[str] = (),
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose spans have a moment in common; columns of both, ``keys`` once.

    A left span (timestamps) holds its end, a right span ends before it; so a left span may be a moment. Both sides are put
    into the buckets of time that they touch (a day by default) and meet there by an equi-join; a pair is made only in
    the first bucket that both touch. A span costs one row for each of its buckets, so ``bucket_seconds`` should fit
    usual spans. Null ends: no pairs. A right span without a moment: no pairs. Other column names have to differ.
    """
    size = F.lit(bucket_seconds * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda m: F.floor(m / size)
    ours = left.withColumns({"_from": micros(left_span[0]), "_to": micros(left_span[1])}).where("_from <= _to")
    ours = ours.withColumn("_bucket", _buckets(bucket(F.col("_from")), bucket(F.col("_to"))))
    theirs = right.withColumns({"_begin": micros(right_span[0]), "_end": micros(right_span[1])}).where("_begin < _end")
    theirs = theirs.withColumn("_place", _buckets(bucket(F.col("_begin")), bucket(F.col("_end") - 1)))
    theirs = theirs.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    first = F.col("_bucket") == bucket(F.greatest("_from", "_begin"))
    match = [F.col("_bucket") == F.col("_place"), F.col("_from") < F.col("_end"), F.col("_to") >= F.col("_begin"), first]
    match += [F.col(k) == F.col(f"_key_{k}") for k in keys]
    own = ("_from", "_to", "_bucket", "_begin", "_end", "_place", *[f"_key_{k}" for k in keys])
    return ours.join(theirs, reduce(lambda a, b: a & b, match)).drop(*own)


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def quarter_spans(periods: DataFrame) -> DataFrame:
    """Distinct ``period`` texts like 2024Q1 or 2024-Q1 with their start and the start of the next one; others are left out."""
    parts = [F.regexp_extract("period", r"^(\d{4})-?Q([1-4])$", i) for i in (1, 2)]
    rows = periods.select("period").distinct().where(parts[0] != "")
    start = F.make_date(parts[0].cast("int"), parts[1].cast("int") * 3 - 2, F.lit(1))
    return rows.select("period", start.cast("timestamp").alias("period_start"), F.add_months(start, 3).cast("timestamp").alias("period_end"))
