"""One registered query for each operator over its whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.llm import decontamination, filter_audit, fingerprints, jaccard_join, language_id, licenses, lm_scoring, near_dedup, periodic_runs, sentence_pieces, sharding, substring_dedup, token_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sentence_pieces(spark, folder):
    """Number and digest of the pieces of every document, and whether decoding gives the text back."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ids = sentence_pieces.encode(docs, decode=True)
    same = F.col("decoded") == F.translate("text", sentence_pieces.MARK, " ")
    return ids.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"), same.alias("round_trip"))


@query
def op2_substring_dedup(spark, folder):
    """Passages of 50 words or more that an earlier document also has."""
    return substring_dedup.repeated_passages(_table(spark, folder, "documents"))


@query
def op5_near_dedup(spark, folder):
    """Near-duplicate components on 2-word shingles."""
    return near_dedup.near_groups(_table(spark, folder, "documents"), width=2, percent=80)


@query
def op8_lm_scoring(spark, folder):
    """Log probability of every document under the interpolated model."""
    return lm_scoring.lm_scores(_table(spark, folder, "documents"))


@query
def op3_sharding(spark, folder):
    """All documents in 40 shards of equal counts, in uniformly random order."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_language_id(spark, folder):
    """Language of every document."""
    return language_id.predicted(_table(spark, folder, "documents"))


@query
def op10_token_counts(spark, folder):
    """Tokens of every line of every document; a token across a line end goes to the line of its first byte."""
    return token_counts.section_tokens(_table(spark, folder, "documents"))


@query
def op4_decontamination(spark, folder):
    """Words of every document that lie in windows of benchmark items."""
    return decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLES["op4_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
items AS (
  SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS v
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, n, i, w[i : i + n - 1] AS v
  FROM words, (SELECT DISTINCT n FROM windows) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows x ON p.n = x.n AND p.v = x.v),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op7_fingerprints(spark, folder):
    """Fingerprints of all texts and of their edited texts."""
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


@query
def op6_license_scan(spark, folder):
    """Licence statements of all documents by family."""
    return licenses.license_statements(_table(spark, folder, "documents"))


@query
def op11_filter_audit(spark, folder):
    """What each of five filters removes in every order, per language."""
    flagged = filter_audit.failures(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return filter_audit.filter_audit(flagged, list("ABCDE"))


ORACLES["op11_filter_audit"] = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM docs),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
stopped AS (SELECT *, coalesce(list_min([strpos(o, y) FOR y IN string_split(f, '') IF y <> '']), 6) AS stop FROM cells, orders),
credit AS (SELECT part, substr(o, stop, 1) AS x, sum(n) AS n FROM stopped WHERE stop < 6 GROUP BY ALL)
SELECT s.part, o AS filter_order, k::INTEGER AS step,
  coalesce(sum(s.n) FILTER (WHERE stop > k), 0)::BIGINT AS kept, coalesce(sum(s.n) FILTER (WHERE stop = k), 0)::BIGINT AS removed,
  coalesce(sum(s.n) FILTER (WHERE stop < k AND contains(f, substr(o, k, 1))), 0)::BIGINT AS redundant,
  coalesce(sum(s.n) FILTER (WHERE f = substr(o, k, 1)), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE stop = k), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE stop = k), 0)::BIGINT AS toxic_lost,
  coalesce(any_value(credit.n), 0)::BIGINT AS shapley
FROM stopped s CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) LEFT JOIN credit ON credit.part = s.part AND credit.x = substr(o, k, 1)
GROUP BY s.part, o, k
"""


@query
def op12_periodic_runs(spark, folder):
    """Periodic runs of the words of every document, one document in ten made periodic before."""
    return periodic_runs.periodic_runs(_table(spark, folder, "documents"), plant=True, texts=False).drop("n_words", "runs", "collapsed")


@query
def op13_jaccard_join(spark, folder):
    """Components of documents whose 4-word shingle sets are similar to 85 % or more."""
    return jaccard_join.jaccard_groups(_table(spark, folder, "documents"))
