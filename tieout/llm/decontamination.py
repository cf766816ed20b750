"""Benchmark passages in documents: windows of benchmark words, looked up in every window of every document.

Only DataFrame functions are used. Hashes of all windows of a text are made by joining neighbouring hashes, 1 + 1, 2 + 2,
4 + 4 and so on, and looked up in the hashes of the benchmark windows, which are broadcast if counted small. What is found
is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieout.llm.common import lower_ascii, pin, small_side

WINDOW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # no word character in a text that is not lower-cased
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
EDGE = f"(?<={BETWEEN})(?={INSIDE})|(?<={INSIDE})(?={BETWEEN})"
_ROW = -1  # stands in the looked-up hashes of every document once, so that its own row is found too


def words_of(text: Column) -> Column:
    """Digits, a-z and characters beyond ASCII in runs, A-Z lower-cased; none for a null text."""
    parts = F.split(F.coalesce(lower_ascii(text), F.lit("")), GAP)
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _joined(df: DataFrame, length: int) -> DataFrame:
    """``df`` with column ``windows``: a hash of every run of ``length`` words, from column ``hashes``."""
    df, made, have, take = df.withColumn("_1", F.col("hashes")), 0, None, 1
    mixed = lambda a, b: F.xxhash64(a, b)
    while take <= length:
        if length & take:
            if have is None:
                df = df.withColumn("windows", F.col(f"_{take}"))
            else:
                df = df.withColumn("windows", F.zip_with("windows", F.slice(f"_{take}", made + 1, F.greatest(F.size(f"_{take}"), F.lit(1))), mixed))
            have, made = True, made + take
        if take * 2 <= length:
            df = df.withColumn(f"_{take * 2}", F.zip_with(f"_{take}", F.slice(f"_{take}", take + 1, F.greatest(F.size(f"_{take}"), F.lit(1))), mixed))
        take *= 2
    whole = F.slice("windows", 1, F.greatest(F.size("hashes") - (length - 1), F.lit(0)))
    return df.withColumn("windows", whole).drop(*[c for c in df.columns if c.startswith("_") and c[1:].isdigit()])


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, hash, words) for the windows of every item; an item with fewer words is one window."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = pin(_hashed(items).withColumn("length", F.least(F.size("words"), F.lit(window))))
    out = None
    for length in sorted(r[0] for r in items.select("length").distinct().collect()) or [window]:
        own = _joined(items.where(F.col("length") == length), length)
        own = own.select("item_id", "length", "words", F.posexplode("windows").alias("at", "hash"))
        own = own.select("item_id", "length", "hash", F.slice("words", F.col("at") + 1, F.lit(length)).alias("words"))
        out = own if out is None else out.union(own)
    return pin(out.distinct())


def _candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, at, length, hash) for one row per document (hash ``_ROW``) and every window that looks like one of ``windows``.

    ``key`` is a hash of the whole text, so rows with the same doc_id and text are told apart from no other row.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most as many as a window has words
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    texts = _hashed(texts).withColumn("n_words", F.size("words").cast("long")).drop("words")
    out = None
    for length in lengths or [WINDOW]:
        own = _joined(texts, length)
        row = F.array(F.lit(_ROW).cast("long")) if out is None else F.array().cast("array<long>")
        looked = F.posexplode(F.concat(row, "windows")).alias("at", "hash")
        own = own.select("doc_id", "key", "n_words", F.lit(length).alias("length"), looked).withColumn("at", F.col("at") - (1 if out is None else 0))
        wanted = windows.where(F.col("length") == length).select(F.col("hash").alias("wanted")).distinct()
        if out is None:
            wanted = wanted.union(docs.sparkSession.range(1).select(F.lit(_ROW).cast("long").alias("wanted")))
        own = own.join(small_side(wanted), F.col("hash") == F.col("wanted")).drop("wanted")
        out = own if out is None else out.union(own)
    return pin(out)


def _hits(docs: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, at, length, item_id): candidates whose words are those of the window."""
    looked = found.where("at >= 0").select("doc_id", "key", "n_words", "at", "length", "hash").distinct()
    of = small_side(looked.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    texts = texts.join(of, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "key"])
    texts = texts.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), words_of(F.col("text")).alias("_words"))
    both = looked.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    both = both.select("doc_id", "key", "n_words", "at", "length", "hash", F.slice("_words", F.col("at") + 1, F.col("length")).alias("there"))
    items = windows.select("item_id", F.col("hash").alias("_hash"), F.col("words").alias("_item_words"))
    same = (F.col("hash") == F.col("_hash")) & (F.col("there") == F.col("_item_words"))
    return pin(both.join(items, same).select("doc_id", "key", "n_words", "at", "length", "item_id"))


def _covered(hits: DataFrame) -> DataFrame:
    """(_doc, _key, of_words, covered, items): number of words, word positions inside any window, and the items, for each text; bounded by the text and the benchmark."""
    inside = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("length") - 1))))
    return hits.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.max("n_words").alias("of_words"), inside.alias("covered"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of ``window`` words of an item (of all words of a shorter item).
    items_sha256 is the digest of the ids of those items, sorted as texts and joined by commas. Null or empty text: no
    words and no hits. Null doc_id: a row like others. Items without id, text or words are not looked for. Repeated rows
    are counted each, repeated items once. No benchmark: no hits. No documents: no rows.
    """
    windows = benchmark_windows(benchmark, window)
    found = _candidates(docs, windows)
    covered = _covered(_hits(docs, found, windows))
    rows = found.where("at < 0").select("doc_id", "key", "n_words")
    rows = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("covered").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that are hit, and what stands between them; a document of which no word is left goes.

    Other rows and all other columns stay as they are.
    """
    windows = benchmark_windows(benchmark, window)
    covered = _covered(_hits(docs, _candidates(docs, windows), windows)).select("_doc", "_key", "of_words", "covered")
    covered = small_side(pin(covered))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_of"))
    joined = own.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_key")), "left")
    parts = F.when(F.col("covered").isNotNull(), F.split("text", EDGE))
    # Columns of their own, so that no part evaluates them again; the place of the first word among the parts is 0 or 1.
    joined = joined.withColumn("_parts", parts).withColumn("_begins", F.when(F.element_at("_parts", 1).rlike(BETWEEN), 1).otherwise(0))
    begins = F.col("_begins")
    is_in = lambda i: F.coalesce(F.array_contains("covered", i), F.lit(False))
    word = lambda i: ((i - begins) / 2).cast("int")
    stays = lambda p, i: F.when((i - begins) % 2 == 0, ~is_in(word(i))).otherwise(~(is_in(word(i - 1)) & is_in(word(i + 1))))
    left = F.array_join(F.filter("_parts", stays), "")
    cut = F.when(F.col("covered").isNull(), F.col("text")).otherwise(left)
    # Which documents go is told by counts: a condition on the new text would be evaluated inside the loops above.
    joined = joined.where(F.col("covered").isNull() | (F.size("covered") < F.col("of_words"))).withColumn("text", cut)
    return joined.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
