"""Near-duplicate documents by min-max hashing of word shingles, confirmed on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.llm.common import free, in_worker, pin, settled, small_side, within
from tieout.llm.components import components
from tieout.llm.words import ODD, Words, mix, shingles, signed, text_slices

BANDS = 64
PER_BAND = 4  # permutations; each gives its minimum and its maximum, so a band has twice as many values


def _sets(column, width):
    """Sorted distinct shingle hashes of every text."""
    for first, end, data, offsets in text_slices(column):
        words = Words(data, offsets)
        yield [np.unique(shingles(words.of(row), width)) for row in range(end - first)]


def signatures(docs: DataFrame, width: int, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """doc_id, n_shingles, two halves of a 128-bit key of the whole set, and one key for every band."""

    def run(batches):
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for sets in _sets(batch.column("text"), width):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                every = np.concatenate(sets)
                keys = np.zeros((len(sets), 2), np.uint64)
                banded = np.zeros((len(sets), bands), np.uint64)
                if len(full):
                    starts = (np.cumsum(sizes) - sizes)[full]
                    keys[full, 0] = np.add.reduceat(every, starts)
                    keys[full, 1] = np.add.reduceat(mix(every ^ ODD[500]), starts)
                    for band in range(bands):
                        total = np.full(len(full), band, np.uint64)
                        for k in range(band * per_band, (band + 1) * per_band):
                            permuted = every * ODD[k]
                            total = mix(total * ODD[501] + np.minimum.reduceat(permuted, starts))
                            total = mix(total * ODD[501] + np.maximum.reduceat(permuted, starts))
                        banded[full, band] = total
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(sets)).cast(pa.int64()),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(signed(keys[:, 0])),
                        pa.array(signed(keys[:, 1])),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32)), pa.array(signed(banded).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "bands"],
                )
                done += len(sets)

    return docs.select("doc_id", "text").mapInArrow(in_worker(run), "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the full set of shingle hashes."""

    def run(batches):
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for sets in _sets(batch.column("text"), width):
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = pa.array(signed(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(sets)).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "shingles"])
                done += len(sets)

    return docs.select("doc_id", "text").mapInArrow(in_worker(run), "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; written out."""
    x = sets.select(F.col("doc_id").alias("_a"), F.col("shingles").alias("_x"))
    y = sets.select(F.col("doc_id").alias("_b"), F.col("shingles").alias("_y"))
    both = pairs.join(y, F.col("b") == F.col("_b")).join(x, F.col("a") == F.col("_a"))
    common = F.size(F.array_intersect("_x", "_y"))
    return pin(both.where(100 * common >= percent * (F.size("_x") + F.size("_y") - common)).select("a", "b"))


def _labelled(df: DataFrame, column: str, found: DataFrame | None, out: str) -> DataFrame:
    if found is None:
        return df.withColumn(out, F.col(column))
    side = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return df.join(side, F.col(column) == F.col("_node"), "left").withColumn(out, F.coalesce("_component", column)).drop("_node", "_component")


def _families(classes: DataFrame, met: DataFrame, first: DataFrame) -> DataFrame:
    """(node, family): what the buckets of ``met`` (node, hub) connect; the smallest node names it.

    ``first`` has one link to a hub for each class, and joins most of a family before buckets are looked at. A class that
    meets another hub in every bucket then gives no row for each of them: only buckets that still hold several parts link these.
    """
    parts = components(first)
    placed = _labelled(classes.select("node", "bands"), "node", parts, "part").select(F.explode("bands").alias("bucket"), "part")
    open_ = placed.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("part").alias("a"), F.max("part").alias("last")).where("a < last")
    links = placed.join(open_, F.col("bucket") == F.col("_bucket")).where("part > a").select("a", F.col("part").alias("b")).distinct()
    nodes = _labelled(met.select("node").distinct(), "node", parts, "part")
    return _labelled(nodes, "part", components(links), "family").select("node", "family")


def _within_families(spokes: DataFrame, family: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of families, and pairs (a, b) of different components that still have to be compared.

    A ``family`` (node, family) is what ``spokes`` (node, hub) connects; its pivot is the hub of most nodes. With D(x) as the shingles in
    which x and the pivot differ, x and y differ in |D(x)| + |D(y)| - 2 * |common to D(x) and D(y)|. So a similar pair
    has some number of changes in common, and in any fixed order of shingles the first of these leaves room for the
    others in both sets. Changes are ordered by how many classes share them, and classes meet only at a change that
    leaves that room: copies that were edited in different places never meet. Pairs that need no common change are
    both linked to the pivot.
    """
    more, less = 100 + percent, 100 - percent
    placed = pin(_labelled(family, "node", found, "c"))
    open_ = placed.groupBy(F.col("family").alias("_family")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("_family")
    placed = placed.join(small_side(open_), F.col("family") == F.col("_family"), "left_semi")
    wide = spokes.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(placed, F.col("hub") == F.col("node"))
    pivots = wide.groupBy(F.col("family").alias("_family")).agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("pivot"))
    pivots = pin(pivots.join(sets, F.col("pivot") == F.col("doc_id")).select("_family", "pivot", F.col("shingles").alias("_of")))
    members = placed.join(sets, F.col("node") == F.col("doc_id")).join(small_side(pivots), F.col("family") == F.col("_family"))
    changes = F.concat(F.array_except("shingles", "_of"), F.array_except("_of", "shingles"))
    members = members.select("family", "pivot", "node", "c", F.size("shingles").alias("n"), F.size("_of").alias("n_pivot"), changes.alias("changes"))
    members = pin(members.withColumn("size", F.size("changes")).withColumn("weight", more * F.col("size") - less * F.col("n")))
    near = members.where((F.col("node") != F.col("pivot")) & (more * F.col("size") <= less * (F.col("n") + F.col("n_pivot"))))

    each = members.select("family", "node", "c", "size", "weight", F.explode("changes").alias("change"))
    shared = each.groupBy(F.col("family").alias("_family"), F.col("change").alias("_change")).agg(
        F.count(F.lit(1)).alias("holders"), F.min("weight").alias("least"), F.min("c").alias("low"), F.max("c").alias("high")
    )
    each = each.join(shared.where("low < high"), (F.col("family") == F.col("_family")) & (F.col("change") == F.col("_change")))
    # Changes that only one component has come first in the order, and are no longer here.
    rest = F.count(F.lit(1)).over(Window.partitionBy("node")) - F.row_number().over(Window.partitionBy("node").orderBy("holders", "change"))
    each = each.withColumn("room", 2 * more * (rest + 1)).where("room >= weight + least")
    each = pin(each.select("family", "change", "node", "c", "weight", "room"))
    other = each.select(*[F.col(name).alias(f"_{name}") for name in each.columns])
    meet = (F.col("family") == F.col("_family")) & (F.col("change") == F.col("_change")) & (F.col("node") < F.col("_node")) & (F.col("c") != F.col("_c"))
    both = F.col("weight") + F.col("_weight")
    met = each.join(other, meet & (both > 0) & (F.col("room") >= both) & (F.col("_room") >= both))
    pairs = pin(met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct())
    return near.select(F.col("pivot").alias("a"), F.col("node").alias("b")), pairs


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, text: Column | str = "text", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked if their shingle sets (``width`` words) have 100 * common >= ``percent`` * all; a component
    holds everything that links connect, and its smallest doc_id is kept. Documents with equal sets are first merged
    into one class, so copies meet once and not in pairs. Classes that agree in a band meet in its bucket:

    1. every class is compared with the smallest class that it meets in most buckets;
    2. then with the smallest class of each bucket that is not yet in its component;
    3. then classes that buckets connect (a family) but that are still in different components, by what each of them
       has changed against one class of the family; see ``_within_families``.

    Step 3 leaves out only pairs that are already connected or cannot be similar enough, so no candidate is lost; with
    the default bands a pair at exactly 80 % is missed with probability 0.000008. All links are confirmed on full sets.

    Null or empty text: no shingles, linked with nothing. Null doc_id: linked with nothing, component null, kept. Rows
    that share a doc_id are one document: they get one component, and both are kept or not. Empty input: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    signed_docs = pin(signatures(docs, width, bands))
    own = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = own.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"))
    classes = pin(classes)
    met = classes.select(F.explode("bands").alias("bucket"), "node")
    hubs = met.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select(F.col("bucket").alias("_bucket"), "hub")
    met = pin(met.join(hubs, F.col("bucket") == F.col("_bucket")).select("bucket", "node", "hub"))
    sets = pin(shingle_sets(within(docs, met.select(F.col("node").alias("doc_id")).distinct()), width))

    spokes = pin(met.where("node > hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")))
    first = pin(spokes.groupBy(F.col("node").alias("b")).agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a")).select("a", "b"))
    links = _confirmed(first, sets, percent)
    found = components(links)

    apart = pin(_labelled(classes.select("node", "bands"), "node", found, "c")).select(F.explode("bands").alias("bucket"), "node", "c")
    hubs = apart.groupBy(F.col("bucket").alias("_bucket")).agg(F.min_by(F.struct(F.col("node").alias("a"), "c"), "node").alias("hub"), F.min("c").alias("low"), F.max("c").alias("high"))
    rest = apart.join(hubs.where("low < high"), (F.col("bucket") == F.col("_bucket")) & (F.col("c") != F.col("hub.c")))
    rest = pin(rest.select("hub.a", F.col("node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    links = links.union(_confirmed(rest, sets, percent))
    found = components(links)

    near, pairs = _within_families(spokes, _families(classes, met, first), sets, found, percent)
    links = links.union(near).union(_confirmed(pairs.join(first.union(rest), ["a", "b"], "left_anti"), sets, percent))

    nodes = classes.select(F.col("key_a").alias("_a"), F.col("key_b").alias("_b"), F.col("n_shingles").alias("_n"), "node")
    same_set = (F.col("key_a") == F.col("_a")) & (F.col("key_b") == F.col("_b")) & (F.col("n_shingles") == F.col("_n"))
    out = pin(signed_docs.drop("bands").join(nodes, same_set, "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")))
    texts = out.groupBy(F.col("doc_id").alias("_of")).agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    links = links.union(out.join(texts, F.col("doc_id") == F.col("_of")).where("node > a").select("a", F.col("node").alias("b")))
    out = _labelled(out, "node", components(links), "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document is kept by ``near_groups``; columns unchanged. Rows without doc_id stay."""
    name = free(docs, "_gone")
    gone = settled(docs.sparkSession, lambda: near_groups(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
