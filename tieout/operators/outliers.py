"""Accounts whose total is unusual among all accounts, by a forest of random splits.

Each of the trees sees a bounded sample of accounts, so growing them takes one small task per tree.
As there is one value per account, a tree is a list of intervals with a path length each, and the
whole forest is one step function. Steps and accounts are brought into one order by value, which is cut into
ranges, and every account takes the sum of the steps before it: an as-of lookup between two tables. Neither
the forest nor the accounts pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.scale import pin, running_total

EULER = 0.5772156649015329


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n, 2) - 1.0) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def grow_tree(values: np.ndarray, seed: int) -> tuple[list[float], list[float]]:
    """Left ends of the leaf intervals and their path lengths, in order."""
    rng = np.random.default_rng(seed)
    depth_limit = int(np.ceil(np.log2(max(len(values), 2))))
    starts, paths = [], []
    stack = [(np.sort(values), -np.inf, 0)]
    while stack:
        part, start, depth = stack.pop()
        if depth >= depth_limit or len(part) <= 1 or part[0] == part[-1]:
            starts.append(start)
            paths.append(depth + float(average_path(len(part))))
            continue
        cut = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, cut, side="right"))
        if at == len(part):
            cut, at = part[0], int(np.searchsorted(part, part[0], side="right"))
        stack.append((part[at:], float(np.nextafter(cut, np.inf)), depth + 1))
        stack.append((part[:at], start, depth + 1))
    return starts, paths


def account_amounts(source: DataFrame) -> DataFrame:
    return source.filter(F.col("account_code").isNotNull()).groupBy("account_code").agg(F.sum("amount").alias("amount"))


def _samples(accounts: DataFrame, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """The ``sample`` accounts with the smallest hash for every tree.

    Every account gets its tickets as one array, of which only those below a threshold leave the row; the threshold
    lets eight times the sample through on average (all of them if there are fewer accounts), so a tree that gets less
    than its sample does not occur in practice and ranks a bounded number of rows.
    """
    span = min(2**64 * 8 * sample / max(n, 1), 2.0**64 - 2**12)
    draws = F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.struct(t.alias("tree"), F.xxhash64("account_code", t, F.lit(seed)).alias("ticket")))
    drawn = F.filter(draws, lambda d: d["ticket"] <= F.lit(int(-(2**63) + span)))
    tickets = accounts.select("*", F.inline(drawn))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("ticket", "account_code"))
    return tickets.withColumn("place", place).filter(F.col("place") <= sample).select("tree", F.col("amount").cast("double").alias("amount"))


def outlier_scores(
    accounts: DataFrame,
    trees: int = D.OUTLIER_TREES,
    sample: int = D.OUTLIER_SAMPLE,
    share: float = D.OUTLIER_SHARE,
    minimum: int = D.OUTLIER_MIN_ACCOUNTS,
    seed: int = 42,
) -> DataFrame:
    """Score and flag per account (account_code, amount). With fewer than ``minimum`` accounts none is flagged."""
    accounts = pin(accounts)
    n = accounts.count()
    if n < minimum:
        return accounts.withColumns({"score": F.lit(None).cast("double"), "is_anomalous": F.lit(False)})

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        starts, paths = grow_tree(pdf.amount.to_numpy(), seed * 1_000_003 + tree)
        return pd.DataFrame({"tree": tree, "start": starts, "path": paths})

    leaves = _samples(accounts, n, trees, sample, seed).groupBy("tree").applyInPandas(grow, "tree int, start double, path double")
    depth = as_of_sum(accounts, forest_steps(leaves))
    score = F.pow(F.lit(2.0), -F.col("depth").cast("double") / (trees * float(average_path(min(sample, n)))))
    return flag_highest(depth.withColumn("score", score).drop("depth"), share)


def forest_steps(leaves: DataFrame) -> DataFrame:
    """(start, change): by how much the summed path length of all trees changes at each left end of an interval.

    Path lengths are rounded to twelve places and summed as decimals, so the sum does not depend on an order.
    """
    path = F.col("path").cast("decimal(28,12)")
    before = F.lag(path, 1).over(Window.partitionBy("tree").orderBy("start"))  # at most ``sample`` intervals a tree
    change = (path - F.coalesce(before, F.lit(0).cast("decimal(28,12)"))).cast("decimal(28,12)")
    return leaves.select("start", change.alias("change")).groupBy("start").agg(F.sum("change").cast("decimal(28,12)").alias("change"))


def as_of_sum(accounts: DataFrame, steps: DataFrame) -> DataFrame:
    """``accounts`` (account_code, amount) with ``depth``: the sum of all changes up to their amount, that included."""
    none = F.lit(0).cast("decimal(28,12)")
    marks = steps.select(F.col("start").alias("value"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("account_code"), F.lit(None).cast(accounts.schema["amount"].dataType).alias("amount"), "change")
    rows = accounts.select(F.col("amount").cast("double").alias("value"), F.lit(1).alias("kind"), "account_code", "amount", none.alias("change"))
    summed = running_total(marks.unionByName(rows), [], [F.col("value"), F.col("kind"), F.col("account_code")], "change", "depth")
    return summed.filter("kind = 1").select("account_code", "amount", "depth")


def flag_highest(scored: DataFrame, share: float = D.OUTLIER_SHARE) -> DataFrame:
    """Adds ``is_anomalous``: the score is above the one that ``share`` of all rows exceed.

    The cut is exact, interpolated between two scores. Scores of a forest take at most trees * sample values, which bounds
    the state of the aggregate; it stays in the plan as one value.
    """
    scored = pin(scored)
    cut = scored.agg(F.percentile("score", F.lit(1.0 - share)).alias("cut")).scalar()
    return scored.withColumn("is_anomalous", F.coalesce(F.col("score") > cut, F.lit(False)))


def outlier_accounts(scored: DataFrame) -> DataFrame:
    return scored.filter("is_anomalous").drop("is_anomalous")


def top_outliers(scored: DataFrame, n: int = 20) -> DataFrame:
    return outlier_accounts(scored).orderBy(F.desc(F.abs("amount")), "account_code").limit(n)


def outlier_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if("is_anomalous").alias("anomalous_count"),
        F.when(F.count("score") > 0, "complete").otherwise("skipped").alias("status"),
    )
