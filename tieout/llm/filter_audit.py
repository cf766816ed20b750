"""What every order of a chain of filters keeps and removes, from one contingency tensor per part."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tieout.llm.common import pin

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
PARTS_AT_ONCE = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def step_selectors(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, dict[str, list[np.ndarray]]]:
    """All orders, the filter of every (order, step), and per count one (order and step) x 2 matrix for each axis.

    A row of a matrix says which side of that axis the step counts: documents that pass, that fail, or all.
    """
    orders = list(permutations(range(filters)))
    current = np.array([f for order in orders for f in order])
    place = np.array([[order.index(f) for f in range(filters)] for order in orders for _ in order])
    step = np.tile(np.arange(filters), len(orders))
    sides: dict[str, list[np.ndarray]] = {"kept": [], "removed": [], "failing": [], "unique": []}
    for axis in range(filters):
        before, now = place[:, axis] < step, place[:, axis] == step
        for name, earlier, own, other in (("kept", PASS, PASS, ALL), ("removed", PASS, FAIL, ALL), ("failing", ALL, FAIL, ALL), ("unique", PASS, FAIL, PASS)):
            sides[name].append(np.where(before[:, None], earlier, np.where(now[:, None], own, other)).astype(np.int64))
    return orders, current, sides


def contract(tensor: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
    """(parts, measures, 2, ..., 2) and one matrix for each of the last axes: (parts, measures, steps)."""
    axes = "abcdefghij"[: len(sides)]
    selected = ",".join(f"s{a}" for a in axes)
    return np.einsum(f"pm{axes},{selected}->pms", tensor, *sides, optimize=True)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A, B, C, D, E (whether the document fails that filter), good, toxic: one row for each row of ``docs``.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * A-Z characters > 3 * code points; D: one of
    ``#$%&*|``; E: some smaller doc_id has the same text. Texts are compared by their SHA-256. A text's first document is
    found by one aggregation that sums up where rows are read, and is joined on its own doc_id, so a text that a third of
    all documents have is no hot key.

    Null text: empty. Null lang: part ``''``. Null doc_id: has no smaller doc_id, is nobody's smaller one, and has no
    labels. Rows that share doc_id and text are rows of their own, and none is a copy of the other. Several labels of a
    doc_id: one of them is enough. Any further columns of either table are left aside.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n_words, length = F.size("words"), F.length("text")
    capitals = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = rows.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (n_words < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * n_words).alias("B"),
        (100 * capitals.cast("long") > 3 * length.cast("long")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    rows = pin(rows)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("_first")).withColumnRenamed("digest", "_digest")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(_any(F.col("quality") == 1).alias("good"), _any(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(first, (F.col("doc_id") == F.col("_first")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.join(marks, F.col("doc_id") == F.col("_labelled"), "left")
    copied = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return rows.select("part", "A", "B", "C", "D", copied.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _any(condition: Column) -> Column:
    return F.max(F.coalesce(condition, F.lit(False)))


def contingency(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """part and its tensor: ``counts`` has all, good and toxic documents for each of the 2 ** k ways to pass or fail.

    Cells are summed up where the rows are read; what is exchanged is one row per part, cell and task.
    """
    cell = sum((F.col(name).cast("int") * 2 ** (len(filters) - 1 - i) for i, name in enumerate(filters)), F.lit(0))
    cells = flagged.groupBy("part", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    by_cell = [F.map_from_entries(F.collect_list(F.struct("cell", m))).alias(m) for m in ("n", "good", "toxic")]  # at most 2 ** k each
    whole = [F.coalesce(F.col(m)[i], F.lit(0).cast("long")) for m in ("n", "good", "toxic") for i in range(2 ** len(filters))]
    return cells.groupBy("part").agg(*by_cell).select("part", F.array(*whole).alias("counts"))


def filter_audit(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """part, filter_order, step and the counts of ``COUNTS`` for every order of the filters.

    ``flagged`` has one row per document with a boolean per filter (true: it fails), ``part``, ``good`` and ``toxic``. A
    part's counts are reshaped to a tensor with one axis of length two for each filter; every count of every step is a
    contraction that selects pass, fail or all along each axis. Numbers of rows matter for the first aggregation only;
    the rest grows with the number of parts, which are dealt out over tasks. Sums are whole numbers.

    Parts are those of the rows; all orders and steps of a part are there, zeros included. No rows: no rows.
    """
    names = [str(f) for f in filters]

    def run(frames):
        orders, current, sides = step_selectors(len(names))
        texts = np.repeat(["".join(names[f] for f in order) for order in orders], len(names))
        step = np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))
        mine = current == np.arange(len(names))[:, None]
        for frame in frames:
            for at in range(0, len(frame), PARTS_AT_ONCE):
                some = frame.iloc[at : at + PARTS_AT_ONCE]
                tensor = np.stack(some["counts"].to_list()).astype(np.int64).reshape(len(some), 3, *[2] * len(names))
                removed = contract(tensor, sides["removed"])
                every = tensor[:, :1]
                credit = removed[:, 0] @ mine.T  # what each filter removes, summed over all orders
                out = {
                    "kept": contract(every, sides["kept"])[:, 0],
                    "removed": removed[:, 0],
                    "redundant": contract(every, sides["failing"])[:, 0] - removed[:, 0],
                    "unique_fails": contract(every, sides["unique"])[:, 0],
                    "good_lost": removed[:, 1],
                    "toxic_lost": removed[:, 2],
                    "shapley": credit[:, current],
                }
                keys = {"part": np.repeat(some["part"].to_numpy(), len(step)), "filter_order": np.tile(texts, len(some)), "step": np.tile(step, len(some))}
                yield pd.DataFrame(keys | {name: out[name].ravel() for name in COUNTS})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in COUNTS)
    return contingency(flagged, names).mapInPandas(run, schema)
