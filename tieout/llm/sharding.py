"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.llm.common import pin

BLOCK_ROWS = 20_000
SEED = 7
LARGE = 10**9  # beyond it numpy draws no hypergeometric numbers


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of every shard, at most one apart; the first ones have more."""
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shard of every block; a shard is cut into blocks that one task can permute."""
    sizes, owners = [], []
    for shard, size in enumerate(shard_sizes(rows, shards).tolist()):
        parts = max(1, -(-size // block_rows))
        sizes.append(shard_sizes(size, parts))
        owners.append(np.full(parts, shard))
    return np.concatenate(sizes), np.concatenate(owners)


def hypergeometric(good: int, bad: int, drawn: int, rng) -> int:
    """Good ones among ``drawn`` of ``good + bad``; large populations by inversion around the mode."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good else 0
    all_ = good + bad
    mode = (drawn + 1) * (good + 1) // (all_ + 2)
    spread = 40 * math.isqrt(max(drawn * good // all_ * bad // all_, 1)) + 40
    low, high = max(0, drawn - bad, mode - spread), min(good, drawn, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    ratio = (good - k) / (k + 1) * (drawn - k) / (bad - drawn + k + 1)  # P(k + 1) / P(k)
    log = np.append(0.0, np.cumsum(np.log(ratio)))
    chance = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def split_counts(columns: np.ndarray, drawn: int, rng) -> np.ndarray:
    """How many of ``drawn`` rows, taken without replacement, fall to every column."""
    if columns.sum() < LARGE:
        return rng.multivariate_hypergeometric(columns, drawn, method="marginals")
    out, left = np.zeros_like(columns), int(columns.sum())
    for i, column in enumerate(columns.tolist()):
        left -= column
        out[i] = hypergeometric(column, left, drawn, rng) if left else drawn
        drawn -= int(out[i])
    return out


def matrix_row(part: int, before: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row of the communication matrix: rows of ``part`` that go to each column.

    ``before`` holds the running total of rows over parts. The matrix is drawn by halving the range of parts; every half
    gets its share of the columns by one multivariate hypergeometric draw, seeded by the range, so that any task can draw
    its own row again and all rows add up to the columns.
    """
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_counts(columns, int(before[middle] - before[low]), rng)
        columns, low, high = (left, low, middle) if part < middle else (columns - left, middle, high)
    return columns


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` in uniformly random order, cut into ``shards`` whose counts are at most one apart.

    Adds ``shard`` (from 0) and ``slot`` (place in the shard, without gaps from 0); columns of these names are replaced.
    The rows are written out once with the task that read them and their place in it. Each task draws how many of its
    rows go to which block of a shard, permutes its rows and deals them out accordingly; after the exchange the rows of
    each block are permuted again. Every order of all rows has the same probability, sizes are exact, no task holds more
    than a block of ``block_rows`` rows, and a task that is run again deals the same rows. Nothing depends on the values, so
    nulls, ties and repeated rows are rows like others; shards beyond the number of rows are empty. Empty input: no rows.
    """
    place = F.monotonically_increasing_id()
    own = [c for c in df.columns if c not in ("shard", "slot")]
    rows = pin(df.select(F.struct(*own).alias("row"), place.alias("place")))
    part, at = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND((1 << 33) - 1)
    counted = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per task
    parts = np.array(sorted(counted), np.int64)
    before = np.append(0, np.cumsum([counted[int(p)] for p in parts])).astype(np.int64)
    sizes, owners = block_sizes(int(before[-1]), shards, block_rows)
    shared = df.sparkSession.sparkContext.broadcast((parts, before, sizes))  # 16 bytes per task and 8 per block

    @F.pandas_udf("int")
    def block(batches: "Iterator[tuple[pd.Series, pd.Series]]") -> "Iterator[pd.Series]":
        parts, before, sizes = shared.value
        held, order, ends = None, None, None  # of the part being read: a task draws its row and permutation once
        for part_of, places in batches:
            out = np.empty(len(part_of), np.int32)
            for p in part_of.unique():
                if p != held:
                    held, number = p, int(np.searchsorted(parts, p))
                    order = np.random.default_rng([seed, 1, number]).permutation(int(before[number + 1] - before[number]))
                    ends = np.cumsum(matrix_row(number, before, sizes, seed))
                mine = (part_of == p).to_numpy()
                out[mine] = np.searchsorted(ends, order[places[mine].to_numpy()], "right")
            yield pd.Series(out)

    first = np.cumsum(sizes) - sizes
    start = {}
    for i, shard in enumerate(owners.tolist()):
        start.setdefault(shard, int(first[i]))
    shared_start = df.sparkSession.createDataFrame([(i, int(owners[i]), int(first[i]) - start[int(owners[i])]) for i in range(len(sizes))], "b int, shard int, first long")
    dealt = rows.select("row", "place", block(part, at).alias("block"))
    again = Window.partitionBy("block").orderBy(F.xxhash64("place", F.lit(seed)), "place")
    dealt = dealt.withColumn("again", F.row_number().over(again) - 1)
    return dealt.join(shared_start, F.col("block") == F.col("b")).select("row.*", "shard", (F.col("first") + F.col("again")).alias("slot"))
