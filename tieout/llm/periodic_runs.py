"""Periodic runs of words, found with longest common extensions over a difference cover."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tieout.llm.common import in_worker
from tieout.llm.words import Words, mix, text_slices

LEAST_WORDS, LEAST_PERIODS = 24, 3
CYCLE = 31
#: Every number from 0 to 30 is the difference, modulo 31, of two of these six.
COVER = (1, 5, 11, 24, 25, 27)
GRID_POINTS = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Words from places (i, j), modulo ``CYCLE``, to covered ones.
_SHIFT = np.array([[next(d for d in range(CYCLE) if (i + d) % CYCLE in COVER and (j + d) % CYCLE in COVER) for j in range(CYCLE)] for i in range(CYCLE)])


class Extensions:
    """Longest common extensions of a word sequence to the right.

    Only suffixes that begin at covered positions (modulo ``CYCLE`` in ``COVER``) are sorted, over letters that stand for
    ``CYCLE`` words each. Any two places reach covered positions after the same number of words, fewer than ``CYCLE``; up
    to there words are compared one by one. From there the smallest entry between the two ranks in the table of common
    letters, found with a sparse table, gives the letters in common, and the words of the next letter are compared again.
    """

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, np.arange(CYCLE * 2, dtype=np.uint64) + np.uint64(1))  # differs from everything within a cycle
        n, v = len(words), CYCLE
        self.n = n
        covered = np.isin(np.arange(v), COVER)
        self.at = at = np.flatnonzero(covered[np.arange(n) % v])
        self.place = np.full(n + v, -1, np.int64)  # number of a covered position
        self.place[at] = np.arange(len(at))
        letter = np.zeros(n, np.uint64)
        for k, salt in enumerate(_STEP * np.arange(1, v + 1, dtype=np.uint64)):
            letter += mix(self.words[k : n + k] + salt)
        letter = letter[at]
        letter[at + v > n] = mix(at[at + v > n].astype(np.uint64))  # a letter that is cut off equals no other
        follows = np.where(at + v < n, self.place[np.minimum(at + v, n - 1)], -1)
        self.letter, self.follows = letter, follows
        rank = np.unique(letter, return_inverse=True)[1].astype(np.int64)
        jump = follows.copy()
        while len(at) and rank.max() + 1 < len(at):  # prefix doubling over letters
            after = np.where(jump >= 0, rank[jump], -1) + 1
            rank = np.unique(rank * (len(at) + 1) + after, return_inverse=True)[1].astype(np.int64)
            jump = np.where(jump >= 0, jump[jump], -1)
        self.rank = rank
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        self.rows = [self._common(order)] if len(at) > 1 else []
        while self.rows and len(self.rows[-1]) > 2 ** (len(self.rows) - 1):
            last, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def _common(self, order: np.ndarray) -> np.ndarray:
        """Letters that neighbours in the sorted order have in common, by galloping over blocks of 2 ** k letters."""
        a, b = order[:-1].copy(), order[1:].copy()
        hashes, jumps = [self.letter], [self.follows]
        while (jumps[-1] >= 0).any():
            h, j = hashes[-1], jumps[-1]
            hashes.append(mix(h * _STEP + np.where(j >= 0, h[j], np.uint64(0))))
            jumps.append(np.where(j >= 0, j[j], -1))
        total = np.zeros(len(a), np.int64)
        for k in range(len(hashes) - 1, -1, -1):
            whole = self._whole(a, k) & self._whole(b, k)
            same = whole & (hashes[k][a] == hashes[k][b])
            total[same] += 2**k
            a[same], b[same] = jumps[k][a[same]], jumps[k][b[same]]
            ended = same & ((a < 0) | (b < 0))
            a[ended] = b[ended] = -1
        return total

    def _whole(self, number: np.ndarray, k: int) -> np.ndarray:
        return (number >= 0) & (self.at[number] + CYCLE * 2**k <= self.n)

    def right(self, i: np.ndarray, j: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Words that are equal from ``i`` and from ``j`` (i < j) on, before ``j`` reaches ``until``."""
        found = np.zeros(len(i), np.int64)
        steps = _SHIFT[i % CYCLE, j % CYCLE]
        going, first = np.arange(len(i)), np.zeros(len(i), np.int64)
        for part in ("to the sample", "behind it"):
            for k in range(CYCLE):
                going = going[(found[going] - first[going] < (steps[going] if part == "to the sample" else CYCLE)) & (j[going] + found[going] < until[going])]
                if not len(going):
                    break
                going = going[self.words[i[going] + found[going]] == self.words[j[going] + found[going]]]
                found[going] += 1
            if part == "behind it":
                break
            going = np.flatnonzero((found == steps) & (j + found < until))
            x, y = self.place[i[going] + found[going]], self.place[j[going] + found[going]]
            low, high = np.minimum(self.rank[x], self.rank[y]), np.maximum(self.rank[x], self.rank[y])
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            common = np.zeros(len(going), np.int64)
            for k in np.unique(level):
                mine = level == k
                common[mine] = np.minimum(self.rows[k][low[mine]], self.rows[k][high[mine] - 2**k])
            found[going] += common * CYCLE
            first = found.copy()
        return np.minimum(found, until - j)


def grid_step(period: np.ndarray) -> np.ndarray:
    """Distance of grid points: every run of the period has one of them one period before its end or earlier."""
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period


def _grids(sizes: np.ndarray, starts: np.ndarray):
    """(text, place, period) for all grid points, in portions: for each period of a text the places 0, step, 2 * step."""
    most = int(sizes.max(initial=0)) // LEAST_PERIODS
    texts, period = np.flatnonzero(sizes >= LEAST_WORDS), 1
    order = texts[np.argsort(-sizes[texts], kind="stable")]
    falling = -sizes[order]
    held, points = [], 0
    while period <= most:
        long = order[: int(np.searchsorted(falling, -LEAST_PERIODS * period, "right"))]
        step = int(grid_step(np.int64(period)))
        count = (sizes[long] - period - 1) // step + 1
        held.append((long, count, period, step))
        points += int(count.sum())
        period += 1
        if points >= GRID_POINTS or period > most:
            long, count = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            lengths = [len(h[0]) for h in held]
            periods = np.repeat(np.repeat([h[2] for h in held], lengths), count)
            steps = np.repeat(np.repeat([h[3] for h in held], lengths), count)
            text = np.repeat(long, count)
            number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            yield text, starts[text] + number * steps, periods
            held, points = [], 0


def runs_of(words: np.ndarray, starts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text that has some, by start and then period.

    ``words`` holds the word hashes of all texts one after the other, ``starts`` where each begins, and the end.
    """
    sizes = np.diff(starts)
    right = left = None
    total, parts = len(words), []
    for text, at, period in _grids(sizes, starts):
        same = words[at] == words[at + period]
        text, at, period = text[same], at[same], period[same]
        # A first look at the neighbours that a run must have; most pairs of equal words end here.
        for away in (1, 2, 3):
            ahead, back = at + period + away, at - away
            goes = (ahead < starts[text + 1]) & (words[np.minimum(at + away, total - 1)] == words[np.minimum(ahead, total - 1)])
            came = (back >= starts[text]) & (words[np.maximum(back, 0)] == words[np.maximum(back, 0) + period])
            keep = goes | came  # a run is far longer than a period and the grid point, so one side has these words
            text, at, period = text[keep], at[keep], period[keep]
        if not len(at):
            continue
        if right is None:
            right, left = Extensions(words), Extensions(words[::-1].copy())
        ahead = right.right(at, at + period, starts[text + 1])
        back = left.right(total - at - period, total - at, total - starts[text])
        length = back + period + ahead
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        parts.append(np.stack([text[keep], at[keep] - back[keep], length[keep], period[keep]]))
    if not parts:
        return {}
    found = np.concatenate(parts, axis=1)
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    first = np.ones(found.shape[1], bool)
    first[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)  # of equal stretches the smallest period
    out: dict[int, list[tuple[int, int, int]]] = {}
    for text, start, length, period in found[:, first].T.tolist():
        out.setdefault(text, []).append((start - int(starts[text]), length, period))
    for text, runs in out.items():
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def planted(doc_id, count: int) -> np.ndarray | None:
    """For one document in ten the place that every word is taken from, which makes it periodic from some word on."""
    if doc_id is None or not count:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    begin = g % count
    period = 1 + (count - begin) // (3 + g % 8)
    place = np.arange(count)
    place[begin:] = begin + (place[begin:] - begin) % period
    return place


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest exact length / period; ties go to the smallest start, then to the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def kept_places(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run contains after its first period."""
    change = np.zeros(count + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string,"
    " runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def periodic_runs(docs: DataFrame, plant: bool = False, texts: bool = True) -> DataFrame:
    """Runs of every text: doc_id, n_words, n_runs, the strongest run, digests, all ``runs`` and the ``collapsed`` text.

    Words are split on ASCII white space and compared as they are written. A run is a stretch of at least 24 words and
    three periods that repeats with its smallest period and that no neighbouring word extends. ``collapsed`` keeps the
    words that no run contains after its first period, joined by one space; without ``texts`` that column is null.
    ``plant`` makes the words of one document in ten periodic (by the crc32 of its id) before they are searched.

    For each period, places at a distance of two periods (more for short periods) are compared with the place one period
    on; the harmonic sum keeps this near n log n points for n words. Where both words are equal, common extensions to both
    sides give the whole stretch, and stretches found with several periods belong to the smallest. A task takes slices of
    a few megabytes of whole texts, so its memory grows with the longest text and not with the rows; nothing is exchanged.

    Words are compared by 64-bit hashes. Null or empty text: no words, no runs, digests of empty texts. Null doc_id: a
    row like others, never made periodic. Repeated rows give equal rows. Further columns are left aside. No rows: no rows.
    """

    def run(batches):
        for batch in batches:
            ids, done = batch.column("doc_id").to_pylist(), 0
            for first, end, data, offsets in text_slices(batch.column("text")):
                hashed = Words(data, offsets, lower=False)
                starts, sequence = hashed.starts, hashed.hashes.copy()
                raw, moved = data.tobytes(), {}
                for row in range(end - first):
                    place = planted(ids[first + row], int(starts[row + 1] - starts[row])) if plant else None
                    if place is not None:
                        moved[row] = place
                        sequence[starts[row] : starts[row + 1]] = hashed.of(row)[place]
                found = runs_of(sequence, starts)
                out = []
                for row in range(end - first):
                    split = raw[offsets[row] : offsets[row + 1]].split()
                    if row in moved:
                        split = [split[i] for i in moved[row].tolist()]
                    runs = found.get(row, [])
                    kept = [split[i] for i in kept_places(len(split), runs).tolist()] if runs else split
                    collapsed = b" ".join(kept)
                    best = strongest(runs) if runs else (None, None, None)
                    out.append(
                        (
                            ids[first + row], len(split), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                            hashlib.sha256(collapsed).hexdigest(),
                            [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed.decode() if texts else None,
                        )
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(in_worker(run), SCHEMA)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_NAMES = "doc_id n_words n_runs start length period exponent_milli runs_sha256 collapsed_sha256 runs collapsed".split()
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string(), _RUN, pa.string()]
