"""Exact Jaccard join of word shingle sets: cells, Voronoi regions of pivots, and changes against a pivot."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.llm.common import bit_table, in_table, in_worker, pin, small_side, within
from tieout.llm.components import components
from tieout.llm.near_dedup import shingle_sets
from tieout.llm.words import ODD, Words, mix, shingles, signed, text_slices

CELL = 64
DEMOTED = 1 << 20
PIVOTS = 8
LEVELS = 4
WHOLE = 256  # regions of at most so many sets are not cut
NEAR = 0.5  # a set belongs to a pivot's region only up to this distance
PAIRS_AT_ONCE = 1 << 20
CHANGE_CELLS = 8
CROWDS = (8, 64, 512)  # changes with more holders than these come later and later in their order
MEMBER = ("region", "node", "which", "c", "n")


def prefix_size(n: int, percent: int) -> int:
    """Two sets that are similar enough have one of their first so many shingles in common, in any order of shingles."""
    return n - -(-percent * n // 100) + 1 if n else 0


def sketch_level(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the number of bits of a set's sketch: one for one or two shingles, 64 at least."""
    return np.maximum(np.frexp(np.maximum(n, 1) / 2.0)[1], 6)


def sketch(sorted_set: np.ndarray, level: int) -> bytes:
    """For each bucket of shingles (by the leading bits of their hash) whether their number is odd."""
    buckets = (sorted_set >> np.uint64(64 - level)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=2**level) & 1).tobytes()


def summaries(docs: DataFrame, width: int, percent: int, demoted: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_shingles, two halves of a 128-bit key of the whole set, its prefix and its sketch.

    Shingles are ordered by hash, those that are ``demoted`` after all others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(demoted)) if demoted is not None else None

    def ordered(s):
        if shared is not None and len(s):
            late = shared.value[np.minimum(np.searchsorted(shared.value, s), len(shared.value) - 1)] == s
            s = np.concatenate([s[~late], s[late]])
        return s[: prefix_size(len(s), percent)]

    def run(batches):
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                sets = [np.unique(shingles(words.of(row), width)) for row in range(end - first)]
                levels = sketch_level(np.array([len(s) for s in sets])).tolist()
                keys = [(np.sum(s, dtype=np.uint64), np.sum(mix(s ^ ODD[500]), dtype=np.uint64)) for s in sets]
                heads = [ordered(s) for s in sets]
                ends = np.cumsum([0] + [len(h) for h in heads]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(sets)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(np.array([k[0] for k in keys], np.uint64))),
                        pa.array(signed(np.array([k[1] for k in keys], np.uint64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(heads)))),
                        pa.array([sketch(s, level) for s, level in zip(sets, levels)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "prefix", "sketch"],
                )
                done += len(sets)

    return docs.select("doc_id", "text").mapInArrow(in_worker(run), "doc_id long, n_shingles long, key_a long, key_b long, prefix array<long>, sketch binary")


def _classes(summed: DataFrame) -> DataFrame:
    """One row for each different set; ``node`` is the smallest doc_id that has it."""
    own = summed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return own.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("prefix").alias("prefix"), F.any_value("sketch").alias("sketch"))


def _counted(classes: DataFrame) -> DataFrame:
    """Classes in each cell; a cell is a shingle, and holds the classes that have it in their prefix."""
    return classes.select(F.explode("prefix").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def _cell_rows(classes: DataFrame, table: np.ndarray) -> DataFrame:
    """(cell, node, n) for the cells of ``table``; those of one class only stay out before anything is exchanged."""
    shared = classes.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            column = batch.column("prefix")
            cell, size = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            keep = in_table(shared.value, cell.view(np.uint64))
            node, n = (np.repeat(batch.column(c).to_numpy(), size)[keep] for c in ("node", "n_shingles"))
            yield pa.RecordBatch.from_arrays([pa.array(cell[keep]), pa.array(node), pa.array(n)], names=["cell", "node", "n"])

    return classes.select("node", "n_shingles", "prefix").mapInArrow(in_worker(run), "cell long, node long, n long")


def _with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of cells in which some other class has a size that similar sets can have; cells are small."""
    by_size = Window.partitionBy("cell").orderBy("n", "node")
    less, more = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = (100 * less >= percent * F.col("n")) | (100 * F.col("n") >= percent * more)
    return rows.withColumn("_near", F.coalesce(near, 100 * less >= percent * F.col("n"), 100 * F.col("n") >= percent * more, F.lit(False))).where("_near").drop("_near")


def crowded(counts: DataFrame, cell_rows: int, most: int) -> np.ndarray:
    """Shingles of the fullest cells, at most ``most`` of them, all above one size; a choice that changes no result."""
    wide = counts.where(F.col("n") > cell_rows)
    power = F.floor(F.log2("n")).cast("int")
    by_power = sorted(((r["p"], r["c"]) for r in wide.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    total, least = 0, None
    for p, c in by_power:
        if total + c > most:
            break
        total, least = total + c, p
    if least is None:
        return np.zeros(0, np.uint64)
    rows = wide.where(power >= least).select("cell").toArrow()  # at most ``most`` numbers
    return rows.column("cell").to_numpy().view(np.uint64)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; only sets of these pairs are exchanged."""
    side = lambda c: within(sets, pairs.select(F.col(c).alias("doc_id")).distinct()).select(F.col("doc_id").alias(f"_{c}"), F.col("shingles").alias(f"_of_{c}"))
    both = pairs.join(side("b"), F.col("b") == F.col("_b")).join(side("a"), F.col("a") == F.col("_a"))
    common = F.size(F.array_intersect("_of_a", "_of_b"))
    return pin(both.where(100 * common >= percent * (F.size("_of_a") + F.size("_of_b") - common)).select("a", "b"))


def _labelled(df: DataFrame, found: DataFrame) -> DataFrame:
    side = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(side, F.col("node") == F.col("_node"), "left").withColumn("c", F.coalesce("_component", "node")).drop("_node", "_component")


def _differences(first: np.ndarray, second: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Least number of shingles that only one set of each pair has: the buckets that are odd in one of them only.

    The wider sketch of a pair is folded to the other's number of buckets. It is never less than the sizes differ.
    """
    levels = sketch_level(n)
    out = np.zeros(len(first), np.int64)
    lower = np.minimum(levels[first], levels[second])
    for level in np.unique(lower):
        mine = np.flatnonzero(lower == level)
        used, index = np.unique(np.concatenate([first[mine], second[mine]]), return_inverse=True)
        table = np.empty((len(used), 2 ** (level - 6)), np.uint64)
        for row, member in enumerate(used.tolist()):
            bits = np.frombuffer(sketches[member], np.uint8)
            if levels[member] > level:
                bits = np.packbits(np.bitwise_xor.reduce(np.unpackbits(bits).reshape(2**level, -1), axis=1))
            table[row] = bits.view(np.uint64)
        step = max(1, PAIRS_AT_ONCE >> int(level - 6))
        for at in range(0, len(mine), step):
            x, y = index[: len(mine)][at : at + step], index[len(mine) :][at : at + step]
            out[mine[at : at + step]] = np.bitwise_count(table[x] ^ table[y]).sum(axis=1, dtype=np.int64)
    return np.maximum(out, np.abs(n[first] - n[second]))


def _near_pairs(node, c, n, sketches, starts, percent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, bound) for members of the same cell and of different components that their sketches let be similar."""
    sizes = np.diff(starts)
    number = np.arange(len(node))
    ahead = np.repeat(starts[1:], sizes) - number - 1  # members of the cell behind each one
    first = np.repeat(number, ahead)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    fits = (c[first] != c[second]) & (100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second]))
    first, second = first[fits], second[fits]
    bound = _differences(first, second, n, sketches)
    fits = (100 + percent) * bound <= (100 - percent) * (n[first] + n[second])
    return first[fits], second[fits], bound[fits]


def _in_cells(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Candidates (a, b, bound) among the classes of each cell of ``rows`` (cell, node, c, n, sketch).

    Cells are small and come whole to a task. With ``nearest`` one candidate per class: the closest smaller one, or else
    the closest; without, all pairs that are not yet connected and that sketches do not rule out.
    """

    def cells(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            cell = held.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield held

    def run(batches):
        for rows in cells(batches):
            cell, node, c, n = (rows.column(name).to_numpy() for name in ("cell", "node", "c", "n"))
            starts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            first, second, bound = _near_pairs(node, c, n, rows.column("sketch").to_pylist(), starts, percent)
            a, b = node[first], node[second]
            if nearest and len(a):
                of, to, bound = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([bound, bound])
                order = np.lexsort((to, bound, to > of, of))
                order = order[np.append(True, of[order][1:] != of[order][:-1])]
                a, b, bound = to[order], of[order], bound[order]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bound)], names=["a", "b", "bound"])

    dealt = rows.repartition("cell").sortWithinPartitions("cell")
    return dealt.select("cell", "node", "c", "n", "sketch").mapInArrow(in_worker(run), "a long, b long, bound long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _pivot_distances(members: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Every member with each pivot of its region: number, pivot, shingles of the pivot, common ones, distance."""
    drawn = [F.min_by("node", F.xxhash64("node", F.lit(level), F.lit(i))) for i in range(PIVOTS)]
    pivots = members.groupBy("region").agg(F.array_distinct(F.array(*drawn)).alias("pivots"))
    pivots = pivots.select(F.col("region").alias("_region"), F.posexplode("pivots").alias("number", "pivot"))
    of = sets.select(F.col("doc_id").alias("_pivot"), F.col("shingles").alias("_of"))
    pivots = pin(pivots.join(of, F.col("pivot") == F.col("_pivot")).drop("_pivot"))
    mine = members.join(sets, (F.col("node") == F.col("doc_id")) & (F.col("which") == F.col("digest")))
    met = mine.join(small_side(pivots), F.col("region") == F.col("_region"))
    common = F.size(F.array_intersect("shingles", "_of")).cast("long")
    met = met.select(*MEMBER, "number", "pivot", F.size("_of").cast("long").alias("n_pivot"), common.alias("common"))
    return pin(met.withColumn("d", 1 - F.col("common") / (F.col("n") + F.col("n_pivot") - F.col("common"))))


def regions(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between members and pivots, and the regions (their ``pivot`` and ``MEMBER``) in which all other links lie.

    ``members`` (``MEMBER``; ``which`` tells sets of the same node apart) starts with one region per family. At every level each region draws ``PIVOTS`` of its
    sets. A set belongs to the region of its nearest pivot, up to the distance ``NEAR``; all others make up one region that
    draws again. With r as the largest distance of similar sets, the triangle inequality says where a set can have
    partners, and it is replicated there: to a pivot's region if its distance is at most that to its own pivot + 2r, and at
    most the region's radius + r; to the region without a pivot if it is farther than ``NEAR`` - r from all of them.
    A region of at most ``WHOLE`` sets, or one that does not get smaller this way, is not split; its pivot is the one with
    the least mean distance.
    """
    r = 1 - percent / 100 + 1e-9
    links, leaves = [], []
    for level in range(LEVELS):
        state = members.groupBy(F.col("region").alias("_of")).agg(F.min("c").alias("low"), F.max("c").alias("high"))
        members = pin(members.join(state.where("low < high").select("_of"), F.col("region") == F.col("_of"), "left_semi"))
        met = _pivot_distances(members, sets, level)
        similar = 100 * F.col("common") >= percent * (F.col("n") + F.col("n_pivot") - F.col("common"))
        links.append(met.where(similar & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        each = met.where("number = 0")
        mean = met.groupBy("region", "pivot").agg(F.avg("d").alias("mean")).groupBy(F.col("region").alias("_of")).agg(F.min_by("pivot", F.struct("mean", "pivot")).alias("centre"))
        wide = each.groupBy("region").agg(F.count(F.lit(1)).alias("whole")).where(F.col("whole") > WHOLE)
        if level + 1 == LEVELS or wide.isEmpty():
            leaves.append(each.select(*MEMBER).join(mean, F.col("region") == F.col("_of")).select(*MEMBER, F.col("centre").alias("pivot")))
            break
        parts = pin(_replicated(met, r))
        sizes = parts.groupBy(F.col("region").alias("_of"), "number").agg(F.count(F.lit(1)).alias("rows")).groupBy("_of").agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"))
        split = sizes.join(wide, F.col("region") == F.col("_of")).where((F.col("rows") <= 1.5 * F.col("whole")) & (F.col("most") <= 0.8 * F.col("whole")))
        split = pin(split.select(F.col("region").alias("_split")))
        rest = each.select(*MEMBER).join(split, F.col("region") == F.col("_split"), "left_anti")
        leaves.append(rest.join(mean, F.col("region") == F.col("_of")).select(*MEMBER, F.col("centre").alias("pivot")))
        if split.isEmpty():
            break
        members = parts.join(split, F.col("region") == F.col("_split"), "left_semi").select(F.xxhash64("region", "number").alias("region"), *MEMBER[1:])
    return reduce(DataFrame.union, links), reduce(DataFrame.union, leaves)


def _replicated(met: DataFrame, r: float) -> DataFrame:
    """``MEMBER`` and the number of the pivot (-1: none) of every region in which a set is or can have partners."""
    home = met.groupBy("region", "node", "which").agg(F.min("d").alias("least"), F.min_by("number", F.struct("d", "number")).alias("home"))
    home = home.withColumn("home", F.when(F.col("least") <= NEAR, F.col("home")).otherwise(-1))
    placed = met.join(home, ["region", "node", "which"])
    radius = home.groupBy(F.col("region").alias("_region"), F.col("home").alias("_home")).agg(F.max("least").alias("radius"))
    near = placed.where((F.col("home") >= 0) & (F.col("d") <= NEAR + r) & (F.col("d") <= F.col("least") + 2 * r))
    near = near.join(radius, (F.col("region") == F.col("_region")) & (F.col("number") == F.col("_home"))).where(F.col("d") <= F.col("radius") + r)
    far = placed.where((F.col("number") == 0) & (F.col("least") > NEAR - r))
    return near.select("number", *MEMBER).union(far.select(F.lit(-1).alias("number"), *MEMBER))


def change_sketch(changes: str) -> list[Column]:
    """For each of 64 * ``CHANGE_CELLS`` buckets whether their number of changes is odd, as ``CHANGE_CELLS`` numbers."""

    def cell(i):
        mine = F.filter(changes, lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(CHANGE_CELLS - 1) == i)
        mark = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(mark(x)))

    return [cell(i).alias(f"bits_{i}") for i in range(CHANGE_CELLS)]


def _in_region(region: str, change: Column) -> Column:
    """A number for a change in a region."""
    return F.xxhash64(region).bitwiseXOR(change)


def by_changes(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar, by what each of them has changed against its pivot.

    ``members``: ``MEMBER`` and changes (shingles in which the set and the region's pivot differ). With D(x) as the
    changes of x, x and y differ in |D(x)| + |D(y)| - 2 * |common changes|: the triangle inequality over the pivot, and
    exactly what it leaves open. So a similar pair has some number of changes in common, and in any fixed order the first
    of these leaves room for the others in both sets. Changes are ordered by how many members share them (``CROWDS``), and members
    meet only at a change that leaves that room: copies that were edited in different places never meet. Which changes
    leave it in one member at most is told before anything is joined (``_first_changes``). Pairs that need
    no common change are both linked to the pivot. Members meet once for all changes that the same members have, and are
    a pair only if the sketches of their changes (``change_sketch``), which differ in no more places than the sets, leave
    it open.
    """
    more, less = 100 + percent, 100 - percent
    members = members.withColumn("size", F.size("changes")).withColumn("weight", more * F.col("size") - less * F.col("n"))
    each = members.select("region", "c", F.explode("changes").alias("change")).select(_in_region("region", F.col("change")).alias("change"), "c")
    shared = each.groupBy("change").agg(F.count(F.lit(1)).alias("holders"), F.min("c").alias("low"), F.max("c").alias("high"))
    shared = pin(shared.where("low < high").select("change", "holders"))
    tables = [bit_table(shared.where(F.col("holders") > least).select("change")) for least in (1, *CROWDS)]
    each = pin(_first_changes(members, tables, percent))
    cells = [f"bits_{i}" for i in range(CHANGE_CELLS)]
    side = members.select(F.col("region").alias("_region"), F.col("node").alias("_node"), F.col("which").alias("_which"), "n", *change_sketch("changes"))
    held = _by_holders(each).join(side, (F.col("region") == F.col("_region")) & (F.col("node") == F.col("_node")) & (F.col("which") == F.col("_which")))
    held = pin(held.select("region", "held_by", "node", "c", "n", "weight", "room", *cells))
    other = held.select(*[F.col(name).alias(f"_{name}") for name in held.columns])
    meet = (F.col("region") == F.col("_region")) & (F.col("held_by") == F.col("_held_by")) & (F.col("node") < F.col("_node")) & (F.col("c") != F.col("_c"))
    both = F.col("weight") + F.col("_weight")
    apart = reduce(Column.__add__, [F.bit_count(F.col(cell).bitwiseXOR(F.col(f"_{cell}"))) for cell in cells])
    similar = more * apart <= less * (F.col("n") + F.col("_n"))
    met = held.join(other, meet & (both > 0) & (F.col("room") >= both) & (F.col("_room") >= both) & similar)
    return pin(met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct())


def _first_changes(members: DataFrame, tables: list[np.ndarray], percent: int) -> DataFrame:
    """(region, change, node, which, c, weight, room): the changes at which a member can have its first common one with a similar set.

    ``tables`` (``bit_table``) hold the changes of several components and the crowded ones of these; the order of changes
    in a region depends on their bits and hashes alone, so a full table changes the work and no result. x has no more than
    |x - y| changes that a similar y lacks, and y at most 100 / ``percent`` times as many shingles, so all but so many of
    D(x) are common, and the first of these leaves the others behind it. ``room``: what a change leaves, on the scale of ``weight``.
    """
    more, less = 100 + percent, 100 - percent
    shared = members.sparkSession.sparkContext.broadcast(tables)
    names = ["region", "change", "node", "which", "c", "weight", "room"]

    def run(batches):
        for batch in batches:
            column = batch.column("changes")
            change, size = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
            region, node, which, c, weight, salt, n = (batch.column(x).to_numpy() for x in ("region", "node", "which", "c", "weight", "salt", "n"))
            owner = np.repeat(np.arange(len(size)), size)
            place = (change ^ salt[owner]).view(np.uint64)
            several = in_table(shared.value[0], place)
            owner, change, place = owner[several], change[several], place[several]
            crowd = sum(in_table(table, place).astype(np.int8) for table in shared.value[1:])
            order = np.lexsort((place, crowd, owner))
            owner, change = owner[order], change[order]
            held = np.bincount(owner, minlength=len(size))
            apart = less * (n + 100 * n // percent) // more  # a similar set differs in no more shingles
            rank = np.arange(len(owner)) - (np.cumsum(held) - held)[owner]
            keep = rank <= (held - np.maximum(size - apart, 1))[owner]
            owner, change, rank = owner[keep], change[keep], rank[keep]
            out = [region[owner], change, node[owner], which[owner], c[owner], weight[owner], 2 * more * (held[owner] - rank)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    wanted = members.select("region", "node", "which", "c", F.col("weight").cast("long").alias("weight"), _in_region("region", F.lit(0).cast("long")).alias("salt"), F.col("n").cast("long").alias("n"), "changes")
    return wanted.mapInArrow(in_worker(run), ", ".join(f"{x} long" for x in names))


def _by_holders(each: DataFrame) -> DataFrame:
    """``each`` with one row of a member for all changes that the same members have (``held_by``), and the most room of them.

    Two members that share thousands of changes would else meet at each of them. Changes that leave no room for any of
    their holders are no longer here.
    """
    holders = each.groupBy(F.col("region").alias("_region"), F.col("change").alias("_change")).agg(
        F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "which")), F.bit_xor(F.xxhash64("which", "node"))).alias("held_by"), F.min("weight").alias("least"), F.min("c").alias("low"), F.max("c").alias("high")
    )
    each = each.join(holders.where("low < high"), (F.col("region") == F.col("_region")) & (F.col("change") == F.col("_change"))).where("room >= weight + least")
    return each.groupBy("region", "held_by", "node", "which", "c", "weight").agg(F.max("room").alias("room"))


def _in_families(spokes: DataFrame, sets: DataFrame, found: DataFrame, links: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to pivots, and pairs still to be compared, among the classes that ``spokes`` (node, hub) connect."""
    family = components(spokes.select(F.col("hub").alias("a"), F.col("node").alias("b"))).select("node", F.col("component").alias("region"))
    sizes = sets.select("doc_id", F.col("digest").alias("which"), F.size("shingles").cast("long").alias("n"))
    members = pin(_labelled(family, found).join(sizes, F.col("node") == F.col("doc_id")).select(*MEMBER))
    pivots, leaves = regions(members, sets, percent)
    pivots = pin(pivots)
    leaves = _labelled(leaves.drop("c"), components(links.union(pivots)))
    leaves = pin(leaves)
    mixed = leaves.groupBy(F.col("region").alias("_open")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("_open")
    leaves = leaves.join(mixed, F.col("region") == F.col("_open"), "left_semi")
    of = sets.select(F.col("doc_id").alias("_pivot"), F.col("digest").alias("_digest"), F.col("shingles").alias("_of"))
    centres = leaves.groupBy("region").agg(F.min("pivot").alias("pivot")).join(of, F.col("pivot") == F.col("_pivot"))
    centres = centres.groupBy(F.col("region").alias("_region")).agg(F.min_by("_of", "_digest").alias("_of"))
    leaves = leaves.join(sets, (F.col("node") == F.col("doc_id")) & (F.col("which") == F.col("digest"))).join(small_side(pin(centres)), F.col("region") == F.col("_region"))
    changes = F.concat(F.array_except("shingles", "_of"), F.array_except("_of", "shingles"))
    return pivots, by_changes(pin(leaves.select(*MEMBER, changes.alias("changes"))), percent)


def _without_repeats(docs: DataFrame, summed: DataFrame) -> DataFrame:
    """``docs`` with rows of equal doc_id and text once; costs an exchange of ids, and of texts only where ids repeat."""
    ids = pin(summed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"))
    if ids.isEmpty():
        return docs
    repeated = within(docs, ids.select(F.col("_id").alias("doc_id")))
    single = docs.join(small_side(ids.select("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    return pin(single.union(repeated.distinct()))


def jaccard_groups(docs: DataFrame, width: int = 4, percent: int = 85, text: Column | str = "text", cell_rows: int = CELL, demoted: int = DEMOTED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``: the components of an exact Jaccard join.

    Two documents are linked if their shingle sets (``width`` words) have 100 * common >= ``percent`` * all; a component
    holds everything that links connect. Documents with equal sets are one class first. 1 - Jaccard is a metric:

    1. Sets without a common shingle are at distance 1, where no pivot tells them apart, so the first pivots are single
       shingles: a set lies in the cells of its first shingles in a fixed order, as many as a similar set can lack, and
       one more. Similar sets share a cell. Shingles of cells with more than ``cell_rows`` classes come last in the
       order (the ``demoted`` fullest ones; which ones changes the work, never the result).
    2. In cells of at most ``cell_rows`` classes all of them are compared by sketches (odd or even numbers of shingles per
       hash bucket), which never differ in more places than the sets; what they leave is compared on full sets, for each class its
       closest partner first, then only pairs that are still in different components.
    3. Classes that fuller cells connect are a family. Families are cut into Voronoi regions of drawn pivots with
       replicated borders, again and again (``regions``), and what is left of each region is joined by what its
       members have changed against its pivot (``by_changes``).

    No step drops a pair that could be similar and is not yet connected; every link is confirmed on full sets of 64-bit
    shingle hashes. Null or empty text: no shingles, linked with nothing. Null doc_id: linked with nothing, component
    null. Rows that share a doc_id are one document with one component. Very long texts are sets like others. Further
    columns are left aside. No rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    summed = pin(summaries(docs, width, percent).drop("prefix", "sketch"))
    docs = _without_repeats(docs, summed)
    classes = pin(_classes(summaries(docs, width, percent)))
    late = crowded(_counted(classes), cell_rows, demoted)
    if len(late):
        some = docs.sparkSession.createDataFrame([(int(x),) for x in late.view(np.int64)], "_late long")
        full = classes.select("node", F.explode("prefix").alias("cell")).join(F.broadcast(some), F.col("cell") == F.col("_late"), "left_semi").select(F.col("node").alias("_full")).distinct()
        full = pin(full)
        again = _classes(summaries(within(docs, full.select(F.col("_full").alias("doc_id"))), width, percent, late))
        kept = classes.join(small_side(full), F.col("node") == F.col("_full"), "left_anti")
        classes = kept.select("node", "n_shingles", "prefix", "sketch").union(pin(again.select("node", "n_shingles", "prefix", "sketch")))
    counts = pin(_counted(classes).where("n > 1").select(F.col("cell").alias("_cell"), F.col("n").alias("members")))
    rows = pin(_cell_rows(classes, bit_table(counts.select("_cell"))).join(counts, F.col("cell") == F.col("_cell")).drop("_cell"))
    side = classes.select(F.col("node").alias("_of"), F.col("n_shingles").alias("_size"), "sketch")
    small = pin(_with_partners(rows.where(F.col("members") <= cell_rows), percent).select("cell", "node", "n"))
    sketched = (F.col("node") == F.col("_of")) & (F.col("n") == F.col("_size"))
    light = small.join(side, sketched).select("cell", "node", F.col("node").alias("c"), "n", "sketch")
    closest = pin(_in_cells(light, percent, True).groupBy("b").agg(F.min_by("a", F.struct(F.col("a") > F.col("b"), "bound", "a")).alias("a")))
    heavy = rows.where(F.col("members") > cell_rows).select("cell", "node")
    hubs = heavy.groupBy(F.col("cell").alias("_cell")).agg(F.min("node").alias("hub"))
    spokes = pin(heavy.join(hubs, F.col("cell") == F.col("_cell")).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")))
    towards = spokes.where("node > hub").groupBy(F.col("node").alias("b")).agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a"))
    wanted = closest.select(F.col("b").alias("doc_id")).union(spokes.select("node")).distinct()
    sets = pin(shingle_sets(within(docs, wanted), width).withColumn("digest", F.xxhash64("shingles")))
    first = pin(_ordered(closest.select("a", "b").union(towards.select("a", "b"))))
    links = _confirmed(first, sets, percent)
    found = components(links)

    mixed = _labelled(within(small, wanted.withColumnRenamed("doc_id", "node"), "node"), found)
    open_ = mixed.groupBy(F.col("cell").alias("_cell")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    mixed = mixed.join(open_, F.col("cell") == F.col("_cell")).join(side, sketched)
    second = pin(_ordered(_in_cells(mixed.select("cell", "node", "c", "n", "sketch"), percent, False)).join(first, ["a", "b"], "left_anti"))
    links = links.union(_confirmed(second, sets, percent))

    if not spokes.isEmpty():
        pivots, third = _in_families(spokes, sets, found, links, percent)
        links = links.union(pivots).union(_confirmed(third.join(first.union(second), ["a", "b"], "left_anti"), sets, percent))

    nodes = classes_of(summed)
    same_set = (F.col("key_a") == F.col("_a")) & (F.col("key_b") == F.col("_b")) & (F.col("n_shingles") == F.col("_n"))
    out = summed.select("doc_id", "n_shingles", "key_a", "key_b").join(nodes, same_set, "left")
    out = pin(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")))
    texts = out.groupBy(F.col("doc_id").alias("_of")).agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    links = links.union(out.join(texts, F.col("doc_id") == F.col("_of")).where("node > a").select("a", F.col("node").alias("b")))
    return _labelled(out, components(links)).select("doc_id", "n_shingles", F.col("c").alias("component_id"))


def classes_of(summed: DataFrame) -> DataFrame:
    own = summed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return own.groupBy(F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), F.col("n_shingles").alias("_n")).agg(F.min("doc_id").alias("node"))
