"""Best near match of every unmapped code among the mapped codes.

The score is the token-sort ratio: words sorted and joined, then 200 * common / (length + length),
where ``common`` is the length of the longest common subsequence. Two texts have a common
subsequence of length L exactly if deleting characters from both can leave the same text of length L.
No pair is made to find that out. Searches go on in rounds, fewest deletions first, and after each round
only those codes go on for which more deletions could still give an equal or better score.

Up to ``WHOLE_DELETIONS`` characters are deleted from whole texts, and the sides meet by an equi-join on the texts
that remain. Of all mapped codes that leave the same text and have the same length only the smallest can win,
so the mapped side is reduced to that one before the join: a text shared by very many codes stays one row.

More deletions would leave too many texts. There a mapped text is cut into one segment more than there can be
deletions in both texts; each deletion spoils one segment at most, so one is whole in the other text, not
farther from its place than the deletions allow. The sides meet by an equi-join on length, segment number and the
segment's text, and every pair is scored once, by a fold over the characters that stays inside Spark.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from tieout import defaults as D
from tieout.functions import token_sorted
from tieout.operators.enrich import mapping_keys
from tieout.scale import pin

WHOLE_DELETIONS = 2
LIMB = 62  # characters for each number of the fold


def distinct_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct codes with their word-sorted text and its length."""
    codes = df.select(F.col(column).cast("string").alias("code")).dropna().distinct()
    return codes.withColumn("text", token_sorted(F.col("code"))).withColumn("size", F.length("text"))


def unmapped_distinct(source: DataFrame, mapping: DataFrame) -> DataFrame:
    codes = distinct_codes(source, "account_code")
    keys = mapping_keys(mapping)
    return codes.join(_exchanged(keys), codes.code == keys.mapped_code, "left_anti")


def _exchanged(side: DataFrame) -> DataFrame:
    """A side with a row or more for every code. Its files are far smaller than its rows, and a side that is made of them
    by deleting characters is larger still, so Spark's guess of its size would broadcast it through the driver."""
    return side.hint("merge")


def fuzzy_matches(
    source: DataFrame,
    mapping: DataFrame,
    min_score: float = D.FUZZY_MIN_SCORE,
    whole_deletions: int = WHOLE_DELETIONS,
) -> DataFrame:
    """Every unmapped code with a match of at least ``min_score``: code, match, score and its category.

    Equal scores are settled by the smaller code, repeated mapping rows by the smaller category.
    """
    best = best_matches(unmapped_distinct(source, mapping), distinct_codes(mapping, "source_account_code"), min_score, whole_deletions)
    categories = mapping.groupBy(F.col("source_account_code").cast("string").alias("_known")).agg(
        F.min("metric_category").alias("suggested_category")
    )
    joined = best.join(_exchanged(categories), F.col("suggested_code") == F.col("_known"), "left")
    return joined.select("source_code", "suggested_code", F.round("score", 1).alias("score"), "suggested_category")


def best_matches(left: DataFrame, right: DataFrame, min_score: float, whole_deletions: int = WHOLE_DELETIONS) -> DataFrame:
    """Best match of each left code; both sides as made by ``distinct_codes``.

    ``whole_deletions`` is the number of deletions (of the side with more of them) up to which whole texts meet; the
    result does not depend on it. Negative: segments only.
    """
    # Of codes with the same words only the smallest can be suggested.
    right = right.groupBy("text", "size").agg(F.min("code").alias("code"))
    left, right = pin(left), pin(right)
    # One row per text length, so this stays small however many codes there are.
    both = left.select(F.lit("l").alias("side"), "size").union(right.select(F.lit("r").alias("side"), "size")).distinct().collect()
    rounds = deletion_rounds(sorted(r["size"] for r in both if r["side"] == "l"), sorted(r["size"] for r in both if r["side"] == "r"), min_score)
    best = left.select(F.col("code").alias("source_code"), F.lit(None).cast("string").alias("suggested_code"), F.lit(None).cast("double").alias("score")).limit(0)
    waiting = left
    for last, needed in passes(rounds, whole_deletions):
        found = _round(waiting, right, needed) if last <= whole_deletions else _by_segments(waiting, right, needed)
        best = _better(best.unionByName(found))
        bounds = remaining_bounds(rounds, last)
        if not bounds:
            break
        best = pin(best)
        waiting = pin(_unsettled(left, best, bounds))
        if waiting.isEmpty():
            break
    return best


def deletion_rounds(ours: list[int], theirs: list[int], min_score: float) -> dict[int, list[tuple[int, int, int]]]:
    """Lengths (left, right, common) that can reach ``min_score``, by the larger number of deletions."""
    rounds: dict[int, list[tuple[int, int, int]]] = {}
    for n in ours:
        for m in theirs:
            least = max(1, ceil(min_score * (n + m) / 200 - 1e-9))
            for common in range(min(n, m), least - 1, -1):
                rounds.setdefault(max(n, m) - common, []).append((n, m, common))
    return rounds


def passes(rounds: dict, whole_deletions: int):
    """(last round, lengths) of rounds that are searched together: each one on whole texts, else up to twice as many deletions."""
    together: dict[tuple[int, int], list[int]] = {}
    for r in sorted(rounds):
        together.setdefault((0, max(r, 1)) if r <= whole_deletions else (1, r.bit_length()), []).append(r)
    for some in together.values():
        yield some[-1], [lengths for r in some for lengths in rounds[r]]


def remaining_bounds(rounds: dict, done: int) -> dict[int, float]:
    """Best score that later rounds could give, by left length."""
    bounds: dict[int, float] = {}
    for r, needed in rounds.items():
        if r > done:
            for n, m, common in needed:
                bounds[n] = max(bounds.get(n, 0.0), 200.0 * common / (n + m))
    return bounds


def deletions(codes: DataFrame, wanted: set[tuple[int, int]]) -> DataFrame:
    """Texts left after deleting exactly ``k`` characters, for the wanted pairs (length, k).

    Characters are deleted from left to right, of equal neighbours only the first.
    """
    level = codes.select("code", "size", "text", F.lit(1).alias("start"))
    parts = []
    for k in range(max(k for _, k in wanted) + 1):
        if k:
            at = F.explode(F.sequence(F.col("start"), F.length("text"))).alias("at")
            fresh = (F.col("at") == F.col("start")) | (
                F.substr("text", F.col("at"), F.lit(1)) != F.substr("text", F.col("at") - 1, F.lit(1))
            )
            shorter = F.concat(F.substr("text", F.lit(1), F.col("at") - 1), F.substr("text", F.col("at") + 1))
            level = level.filter(F.col("start") <= F.length("text")).select("*", at).filter(fresh)
            level = level.select("code", "size", shorter.alias("text"), F.col("at").alias("start"))
        lengths = [n for n, j in wanted if j == k]
        deeper = [n for n, j in wanted if j >= k]
        level = level.filter(F.col("size").isin(deeper))
        if lengths:
            parts.append(level.filter(F.col("size").isin(lengths)).select("code", "size", "text"))
    return reduce(DataFrame.unionByName, parts)


def _round(left: DataFrame, right: DataFrame, needed: list[tuple[int, int, int]]) -> DataFrame:
    ours = deletions(left, {(n, n - k) for n, m, k in needed})
    theirs = deletions(right, {(m, m - k) for n, m, k in needed}).groupBy("text", F.col("size").alias("their_size"))
    smallest = theirs.agg(F.min("code").alias("suggested_code"))
    allowed = F.concat_ws("-", "size", "their_size", F.length("text")).isin(*[f"{n}-{m}-{k}" for n, m, k in needed])
    score = F.lit(200.0) * F.length("text") / (F.col("size") + F.col("their_size"))
    met = ours.join(_exchanged(smallest), "text").filter(allowed)
    return _better(met.select(F.col("code").alias("source_code"), "suggested_code", score.alias("score")))


def _better(found: DataFrame) -> DataFrame:
    """Highest score per code, then the smallest match."""
    order = F.struct((-F.col("score")).alias("s"), F.col("suggested_code"))
    return found.groupBy("source_code").agg(F.min(order).alias("b")).select(
        "source_code", F.col("b.suggested_code").alias("suggested_code"), (-F.col("b.s")).alias("score")
    )


def _unsettled(left: DataFrame, best: DataFrame, bounds: dict[int, float]) -> DataFrame:
    """Codes for which a later round could still give an equal or better score."""
    bound = F.coalesce(*[F.when(F.col("size") == n, F.lit(b)) for n, b in bounds.items()])
    joined = left.join(_exchanged(best), F.col("code") == F.col("source_code"), "left")
    return joined.filter(bound.isNotNull() & (F.col("score").isNull() | (bound >= F.col("score")))).select("code", "text", "size")


def _segments(lengths: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(left length, right length, deletions in both, segments of the right text) from the least common length."""
    least: dict[tuple[int, int], int] = {}
    for n, m, common in lengths:
        least[n, m] = min(common, least.get((n, m), common))
    most: dict[int, int] = {}
    for (n, m), common in least.items():
        most[m] = max(most.get(m, 0), n + m - 2 * common)
    return [(n, m, n + m - 2 * common, most[m] + 1) for (n, m), common in least.items()]


def _place(number: Column, size: Column, parts: Column) -> tuple[Column, Column]:
    """Start (from zero) and length of a segment when a text of ``size`` is cut into ``parts``; the later ones are longer."""
    short = (size / parts).cast("int")
    plain = parts - size % parts
    return number * short + F.greatest(number - plain, F.lit(0)), short + (number >= plain).cast("int")


def segment_pairs(left: DataFrame, right: DataFrame, lengths: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs (code, their_code), each once, that can have the common lengths of ``lengths``.

    With k deletions in both texts together, take the first segment of the right text that none of them spoils. Those
    before it take one deletion each, which leaves k minus its number for what follows it; the difference of what follows
    it in both texts, and that of what goes before it, cannot be larger than that.
    """
    table = left.sparkSession.createDataFrame(_segments(lengths), "n int, m int, k int, parts int")  # a row per pair of lengths
    each = F.explode(F.sequence(F.lit(0), F.col("k"))).alias("number")
    ours = left.select("code", "text", "size").join(F.broadcast(table), F.col("size") == F.col("n")).select("*", each)
    start, length = _place(F.col("number"), F.col("m"), F.col("parts"))
    apart = F.col("n") - F.col("m")
    low = F.greatest(F.ceil((apart - F.col("k")) / 2).cast("int"), apart - (F.col("k") - F.col("number")), -start)
    high = F.least(F.floor((apart + F.col("k")) / 2).cast("int"), apart + (F.col("k") - F.col("number")), F.col("n") - start - length)
    ours = ours.select("code", "text", "m", "number", start.alias("start"), length.alias("length"), low.alias("low"), high.alias("high")).where("low <= high")
    texts = F.transform(F.sequence("low", "high"), lambda by: F.substr("text", F.col("start") + by + 1, F.col("length")))
    ours = ours.select("code", "m", "number", F.explode(F.array_distinct(texts)).alias("segment"))
    cut = F.broadcast(table.select(F.col("m").alias("_m"), "parts").distinct())
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_number")
    theirs = right.join(cut, F.col("size") == F.col("_m")).select(F.col("code").alias("their_code"), "text", "_m", "parts", every)
    start, length = _place(F.col("_number"), F.col("_m"), F.col("parts"))
    theirs = theirs.select("their_code", "_m", "_number", F.substr("text", start + 1, length).alias("_segment"))
    met = ours.join(_exchanged(theirs), (F.col("m") == F.col("_m")) & (F.col("number") == F.col("_number")) & (F.col("segment") == F.col("_segment")))
    return met.select("code", "their_code").distinct()


def _by_segments(left: DataFrame, right: DataFrame, lengths: list[tuple[int, int, int]]) -> DataFrame:
    """Best match through pairs that share a segment, as far as the common lengths of ``lengths`` go."""
    limits = left.sparkSession.createDataFrame([(n, m, (n + m - k) // 2) for n, m, k, _ in _segments(lengths)], "n int, m int, least int")
    ours = left.select("code", F.col("size").alias("n"), places(F.col("text"), F.col("size")).alias("places"))
    theirs = right.select(F.col("code").alias("_code"), F.col("text").alias("their_text"), F.col("size").alias("m"))
    pairs = segment_pairs(left, right, lengths).join(_exchanged(ours), "code").join(_exchanged(theirs), F.col("their_code") == F.col("_code"))
    scored = pairs.withColumn("common", common_length(F.col("places"), F.col("n"), F.col("their_text")))
    good = scored.join(F.broadcast(limits), ["n", "m"]).where(F.col("common") >= F.col("least"))
    score = F.lit(200.0) * F.col("common") / (F.col("n") + F.col("m"))
    return _better(good.select(F.col("code").alias("source_code"), F.col("their_code").alias("suggested_code"), score.alias("score")))


def characters(text: Column, size: Column) -> Column:
    """Characters of a text of ``size``; of an empty one a single empty text."""
    return F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(text, i, F.lit(1)))


def places(text: Column, size: Column) -> Column:
    """Map from each character of a text to its places, as bits of one number for every ``LIMB`` characters."""
    chars = characters(text, size)
    limbs = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / LIMB), F.lit(0)).cast("int"))

    def bits(c):
        def limb(j):
            part = F.slice(chars, j * LIMB + 1, F.lit(LIMB))
            marks = F.transform(part, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(marks, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

        return F.transform(limbs, limb)

    each = F.array_distinct(chars)
    return F.map_from_arrays(each, F.transform(each, bits))


def common_length(places_: Column, size: Column, other: Column) -> Column:
    """Length of the longest common subsequence of the text of ``places_`` and ``other``.

    One bit per character of the first text says whether it is still open; a character of the other text closes, in
    every run of open ones, the first place where it stands (by an addition whose carry goes through the run).
    """
    zero = F.lit(0).cast("long")
    full = (1 << LIMB) - 1
    limbs = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / LIMB), F.lit(0)).cast("int"))
    width = lambda j: F.least(size - j * LIMB, F.lit(LIMB)).cast("int")
    every = F.transform(limbs, lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), width(j)) - 1)

    def character(open_, c):
        here = F.try_element_at(places_, c)

        def limb(state, j):
            v = F.get(open_, j)
            hit = v.bitwiseAND(F.get(here, j))
            total = v + hit + state["carry"]
            left = total.bitwiseAND(F.lit(full)).bitwiseOR(v - hit).bitwiseAND(F.get(every, j))
            return F.struct(F.concat(state["limbs"], F.array(left)).alias("limbs"), F.shiftright(total, LIMB).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("limbs"), zero.alias("carry"))
        return F.when(here.isNull(), open_).otherwise(F.aggregate(limbs, start, limb, lambda s: s["limbs"]))

    chars = characters(other, F.length(other))
    return F.aggregate(chars, every, character, lambda v: size - F.aggregate(F.transform(v, F.bit_count), F.lit(0), lambda a, b: a + b))
