"""Fingerprints of documents by consistent weighted sampling of their words.

Only DataFrame functions are used. Every sample draws, for a word and a sample number, two gamma numbers r and c and a
uniform number b from hashes; a word with weight w gets the score ln c - r * (floor(ln w / r + b) - b + 1), and the word
with the smallest score is the sample. Two texts agree in a sample with a probability equal to the generalised Jaccard
similarity of their word counts, sum of minima over sum of maxima. The smallest score itself stands for the word and its
rounded weight, as scores of different ones are different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.llm.common import pin

SAMPLES = 16
SLICE_ROWS = 500_000
_UNIT = 1 << 25


def _uniform(bits: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(_UNIT - 1)) + 0.5) / _UNIT


def sample_score(term: Column, log_weight: Column, sample: int) -> Column:
    """Score of a term in one sample."""
    one, two = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.log(_uniform(one, 39) * _uniform(one, 14))
    c = -F.log(_uniform(two, 39) * _uniform(two, 14))
    b = (one.bitwiseAND(F.lit((1 << 14) - 1)) * (1 << 14) + two.bitwiseAND(F.lit((1 << 14) - 1)) + 0.5) / (1 << 28)
    return F.log(c) - r * (F.floor(log_weight / r + b) - b + 1)


def _terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term): a hash of every word; a text without words has one empty word."""
    words = texts.select(*keys, F.explode(F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r")), r"\s+")).alias("word"))
    return words.select(*keys, F.xxhash64("word").alias("term"))


def signatures(texts: DataFrame, keys: list[str], names: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """Keys and one array of scores for every column in ``names`` (text column to output column).

    Words are counted per text before anything else, so a word costs its samples once per text.
    """
    sides = list(names)
    both = texts.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate(sides)])).alias("v"))
    terms = _terms(both.select(*keys, "v.side", "v.text"), [*keys, "side"], "text")
    counts = terms.groupBy(*keys, "term").agg(*[F.count(F.when(F.col("side") == i, 1)).alias(f"n{i}") for i in range(len(sides))])
    least = []
    for i in range(len(sides)):
        log = F.log(F.col(f"n{i}").cast("double"))
        least += [F.min(F.when(F.col(f"n{i}") > 0, sample_score(F.col("term"), log, j))).alias(f"s{i}_{j}") for j in range(samples)]
    out = counts.groupBy(*keys).agg(*least)
    return out.select(*keys, *[F.array(*[f"s{i}_{j}" for j in range(samples)]).alias(names[c]) for i, c in enumerate(sides)])


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda total, x: total + x) / F.size(a)


def printed(signature: Column) -> Column:
    """Eight hexadecimal digits for every sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _neighbours(keys: DataFrame) -> DataFrame:
    """(key, n, next_key): the next key in descending doc_id, after the last one the first.

    Keys are range-partitioned and written out; a slice finds the next key of all its rows but the last, and the first
    rows of the slices (one each) give those of the last ones.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("key")]
    slices = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // SLICE_ROWS))
    ranged = pin(keys.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("slice").orderBy(*order)
    rows = ranged.select("*", F.lead("key").over(inside).alias("later"), F.row_number().over(inside).alias("at"))
    rows = pin(rows)
    firsts = rows.where("at = 1").select("slice", F.col("key").alias("first"))
    after = Window.orderBy("slice")  # one row per slice
    firsts = firsts.select(F.col("slice").alias("of"), F.coalesce(F.lead("first").over(after), F.first("first").over(after)).alias("first"))
    return rows.join(F.broadcast(firsts), F.col("slice") == F.col("of")).select("key", "n", F.coalesce("later", "first").alias("next_key"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like it is to that and to the next document's.

    The edited text has the last floor(n / 2) characters replaced by as many first characters (or all) of the next
    document in descending doc_id; after the last one comes the first. Null text counts as empty; texts without words
    have the fingerprint of the empty text. Null doc_ids come last; documents that share a doc_id follow each other by a
    hash of their text, and rows that are equal in both count as one document in that order, each with its own result
    row. Empty input: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    keys = pin(rows.groupBy("key", "doc_id").agg(F.max(F.char_length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("copies")))
    near = _neighbours(keys)
    wanted = near.select(F.col("next_key").alias("_next"), F.col("key").alias("for_key"), F.floor(F.col("n") / 2).cast("int").alias("take"))
    links = pin(near.join(wanted, F.col("key") == F.col("_next")).select(F.col("key").alias("_key"), "n", "next_key", "for_key", "take"))
    texts = rows.join(links, F.col("key") == F.col("_key")).drop("_key")
    heads = texts.select(F.col("for_key").alias("of_key"), F.substring("text", F.lit(1), F.col("take")).alias("head"))
    if not keys.where("copies > 1").isEmpty():
        texts, heads = texts.dropDuplicates(["key"]), heads.dropDuplicates(["of_key"])
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - half), "head")
    made = texts.join(heads, F.col("key") == F.col("of_key")).select("key", "text", edited.alias("edited"))
    made = made.select("key", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    marks = pin(signatures(made, ["key", "edited_sha256"], {"text": "own", "edited": "changed"}, samples))
    mine = keys.join(marks.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).join(links.select(F.col("_key").alias("_link"), "next_key"), F.col("key") == F.col("_link"))
    following = marks.select(F.col("key").alias("_following"), F.col("own").alias("next_own"))
    out = mine.join(following, F.col("next_key") == F.col("_following"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        "doc_id", F.col("n").alias("n_chars"), "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
