"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tieout.scale import pin, scratch, settled, small_side

__all__ = ["pin", "scratch", "settled", "small_side", "lower_ascii", "fold", "fold_of", "free", "within", "in_worker", "kept", "bit_table", "in_table"]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fold_of(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is.

    ``lower`` does the same where no other character has a lower case, and is much faster than ``translate``.
    """
    other = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(other, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def within(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column of that name); broadcast only if counted small."""
    return df.join(small_side(ids.select(F.col(key).alias("_wanted"))), F.col(key) == F.col("_wanted"), "left_semi")


TABLE_BITS = 26


def bit_table(values: DataFrame) -> np.ndarray:
    """Bits of all numbers in the one column of ``values``, in a table of 2 ** ``TABLE_BITS`` bits whatever their number.

    A number whose bit is not set is not among them. The more numbers, the more others share a bit with one of them.
    """
    bit = F.col(values.columns[0]).bitwiseAND((1 << TABLE_BITS) - 1)
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    cells = values.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(mark).alias("bits")).toArrow()  # 2 ** (TABLE_BITS - 6) rows at most
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value (unsigned) is set."""
    bit = values & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


@lru_cache(maxsize=1)
def kept(make: Callable, *arguments):
    """What ``make`` gives; a worker keeps it for its next tasks until one runs there that keeps nothing."""
    return make(*arguments)


def give_back() -> None:
    """Return unused memory of Arrow and of the C library to the machine; else a worker holds it through later stages."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def forget() -> None:
    kept.cache_clear()


def _one_by_one(batches: Iterator) -> Iterator:
    for batch in batches:
        yield batch
        del batch
        give_back()


def in_worker(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` as a function for ``mapInArrow`` whose worker gives memory back after every batch.

    Workers serve the tasks of many stages. Only a ``run`` that ``keeps`` finds what ``kept`` holds from earlier tasks.
    """

    def task(batches):
        if not keeps:
            forget()
        try:
            yield from run(_one_by_one(batches))
        finally:
            give_back()

    return task
