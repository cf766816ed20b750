"""Words, word hashes and shingles of many texts at once, as numpy arrays over Arrow buffers.

The helpers run inside ``mapInArrow`` tasks. A text is split on ASCII white space, A-Z are lower-cased, and every
word becomes a 64-bit hash. Texts are taken in slices of a few megabytes, so a task needs the same memory however
many rows a batch has; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 750_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.Philox(20240501))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
ODD = _RANDOM.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of rows; a null text counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column  # else the texts are not copied
    if not len(column):
        return
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, whole[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of a slice: ``hashes``, byte spans ``begin`` and ``end``, and ``starts`` (first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        texts = offsets[:-1][offsets[:-1] < len(data)]
        first[texts] = inside[texts]  # a text that begins right after another one begins a word
        at = np.flatnonzero(inside)
        self.begin = np.flatnonzero(first)
        if len(self.begin):
            runs = np.searchsorted(at, self.begin)
            lengths = np.diff(np.append(runs, len(at)))
            place = np.arange(len(at)) - np.repeat(runs, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), _STEP, dtype=np.uint64))
            terms = powers[place]
            del place
            terms *= (_BYTE[_LOWER] if lower else _BYTE)[data[at]]
            self.hashes = mix(np.add.reduceat(terms, runs) + lengths.astype(np.uint64))
            self.end = self.begin + lengths
        else:
            self.hashes, self.end = np.zeros(0, np.uint64), self.begin
        self.starts = np.searchsorted(self.begin, offsets)

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.starts[row] : self.starts[row + 1]]


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; of the whole sequence if it is shorter; nothing without words."""
    count = len(hashes) - width + 1
    if not len(hashes):
        return hashes
    if count < 1:
        return mix(np.array([np.sum(hashes * ODD[: len(hashes)], dtype=np.uint64) + np.uint64(len(hashes))], dtype=np.uint64))
    total = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        total += hashes[i : i + count] * ODD[i]
    return mix(total + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
