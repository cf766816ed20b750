"""Language models, language identification, licences, fingerprints, shards and decontamination."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_copies import words
from tieout.llm import decontamination, fingerprints, language_id, licenses, lm_scoring, queries, sharding
from tieout.llm.common import lower_ascii
from verification.compare import difference, oracle

SMALL = "/root/testdata/sf0.001"


def crc(doc):
    return zlib.crc32(str(doc).encode()) % 5


def test_scores_are_those_of_counts(given):
    df, texts = given
    rows = {r.doc_id: r for r in lm_scoring.lm_scores(df, block_tokens=3_000, part_keys=2_000).collect()}
    tokens = {d: [*words(t), "\n"] for d, t in texts.items()}
    train = {d: w for d, w in tokens.items() if crc(d) != 1}
    count = collections.Counter(w for ws in train.values() for w in ws)
    total, types = sum(count.values()), len(count)
    for doc, ws in tokens.items():
        r = rows[doc]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        assert r.held_out == (crc(doc) == 1) and (r.n_tokens, r.train_tokens) == (len(ws), total)
        assert r.n_known == sum(count[w] > 0 for w in ws) and r.base_score == pytest.approx(base)
        assert r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_is_that_of_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_weights", lambda cells, types: np.tile([0.1, 0.3, 0.6], (lm_scoring.BUCKETS, 1)))
    texts = {i: t for i, t in enumerate(["a b a", "b a c", "", "a A b", "c c", "d a b", "e", "a b"] * 3)}
    rows = lm_scoring.lm_scores(docs(*texts.items()), block_tokens=7, part_keys=3).collect()
    train = [[*words(t), "\n"] for d, t in texts.items() if crc(d) != 1]
    count = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip(["\n", *ws], ws))
    total, types = sum(count.values()), len(count)
    for r in rows:
        ws = [*words(texts[r.doc_id]), "\n"]
        want = sum(math.log10(0.1 / (types + 1) + 0.3 * count[w] / total + (0.6 * pairs[v, w] / count[v] if count[v] else 0)) for v, w in zip(["\n", *ws], ws))
        assert r.score == pytest.approx(want)


def test_scores_of_odd_rows(docs):
    df = docs((None, "a b"), (1, None), (2, ""), (3, "a"), (3, "a"), (2**60 + 1, "z")).withColumn("block", F.lit("x"))
    rows = lm_scoring.lm_scores(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 3), (1, 1), (2, 1), (3, 2), (3, 2), (2**60 + 1, 2)]
    assert lm_scoring.lm_scores(docs()).count() == 0


def test_weights_follow_the_counts():
    import pandas as pd

    cells = pd.DataFrame({"bucket": [5, 5], "word": [60, 60], "bigram": [10, -1], "n": [900, 100]})
    weights = lm_scoring._weights(cells, 1000)
    assert weights[5][2] > 0.7 and weights.sum(axis=1) == pytest.approx(np.ones(len(weights)))
    assert weights[0][2] == 0


def test_languages_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predicted(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_code_lengths_are_those_of_one_byte_after_another():
    counts = collections.Counter()
    texts = {"x": b"abracadabra alakazam", "y": b"lorem ipsum dolor"}
    for lang, text in texts.items():
        padded = b"\n\n" + text
        for i in range(2, len(padded)):
            for k in range(3):
                counts[lang, padded[i - k : i + 1]] += 1
    model = language_id.Model([(a, g, n) for (a, g), n in counts.items()], 2)
    trees = {x: collections.defaultdict(dict) for x in texts}
    for (lang, gram), n in counts.items():
        trees[lang][gram[:-1]][gram[-1]] = n

    def spread(lang, context):
        lower = spread(lang, context[1:]) if context else np.full(256, 1 / 256)
        found = trees[lang].get(context)
        if not found:
            return lower
        out, total = lower.copy(), sum(found.values()) + len(found)
        out[list(found)] = 0
        out *= len(found) / total / out.sum()
        for byte, n in found.items():
            out[byte] = n / total
        return out

    data = b"abra lorem " * 120 + b"\xff\xfe"
    got = model.code_lengths(np.frombuffer(data + b"dolor", np.uint8), np.array([0, len(data), len(data), len(data) + 5]))
    for row, text in ((0, data), (1, b""), (2, b"dolor")):
        for j, lang in enumerate(model.languages):
            padded = b"\n\n" + text
            want = -sum(math.log2(spread(lang, padded[i - 2 : i])[padded[i]]) for i in range(2, len(padded)))
            assert got[row, j] == pytest.approx(want, rel=1e-4)


def test_languages_of_odd_rows(docs):
    train = [(i, t, lang) for i in range(10, 40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    df = docs(*train, (1, None), (2, ""), (3, "12 $%"), (None, "the dog"), (5, "日本語"), (6, "die katze", None)).withColumn("score", F.lit("old"))
    rows = {r.doc_id: r.lang_pred for r in language_id.predicted(df).where("doc_id < 10 OR doc_id IS NULL").collect()}
    assert rows[1] == rows[2] == rows[3] == "und" and rows[None] == "en" and rows[6] == "de" and rows[5] in ("en", "de")
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() == df.count() - 3
    assert language_id.predicted(docs()).count() == 0
    assert [r.lang_pred for r in language_id.predicted(docs((1, "a", None))).collect()] == ["und"]


def test_long_texts_are_learned_from_and_nothing_goes_without_a_model(docs):
    short, long = "the cat and the dog ", "köttur og hundur í þorpinu "
    df = docs(*[(i, short * 5, "en") for i in range(20)], *[(100 + i, long * 2_000, "is") for i in range(20)], (200, None, "en"), (201, "12 34", "en"))
    rows = {r.doc_id: r.lang_pred for r in language_id.predicted(df).collect()}
    assert rows == {**{i: "en" for i in range(20)}, **{100 + i: "is" for i in range(20)}, 200: "und", 201: "und"}
    assert max(len(r.text.encode()) for r in language_id.training_rows(df).collect()) <= 1.01 * language_id.TRAIN_BYTES
    assert sorted(r.doc_id for r in language_id.keep_identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()) == [*range(20), *range(100, 120)]


def test_statements_of_planted_licences(docs):
    fill = [(i, "\n".join(f"word{(i * j) % 97} of the ver{j} and to{i} it was" for j in range(1, 9))) for i in range(40)]
    df = docs(
        *fill, (100, "some words\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (101, "RELEASED under the MIT license."),
        (102, "all rights of man are reserved for the license holder of version"), (103, None), (104, ""), (None, "All rights reserved."), (None, "All rights reserved."),
    )
    found = [(r.doc_id, r.paragraph, r.family) for r in licenses.license_statements(df.withColumn("paragraph", F.lit("x"))).where("confirmed").collect()]
    assert sorted(f for f in found if f[0]) == [(100, 1, "GPL"), (101, 0, "MIT")]
    assert [f for f in found if not f[0]] == [(None, 0, "reserved")] * 2
    assert licenses.license_statements(docs()).count() == 0


def test_all_given_licence_lines_are_found(given):
    df, texts = given
    want = {(d, i) for d, t in texts.items() for i, line in enumerate(t.split("\n")) if re.search(r"(?i)licen[cs]e|rights reserved|CC BY", line)}
    found = licenses.license_statements(df).collect()
    assert {(r.doc_id, r.paragraph) for r in found if r.confirmed} == want
    assert {(r.doc_id, r.paragraph) for r in found} == want


def test_likeness_is_generalised_jaccard(given):
    df, texts = given
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(df).collect()}
    order, off = sorted(texts, reverse=True), []
    for i, doc in enumerate(order):
        text, following = texts[doc], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = collections.Counter(text.split()), collections.Counter(other.split())
            off.append(near - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12


def test_fingerprints_of_odd_rows(docs):
    rows = fingerprints.edited_fingerprints(docs((1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (None, "x 𝔸"), (4, " \n")).withColumn("key", F.lit("k"))).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 7 and len(by[3]) == 2 and by[3][0] == by[3][1]
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[4][0].fingerprint and by[1][0].near_next == 0
    assert by[3][0].fingerprint == by[5][0].fingerprint and by[None][0].n_chars == 3
    assert by[5][0].edited_sha256 == hashlib.sha256(b"a b  \n").hexdigest()
    assert by[1][0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    one = fingerprints.edited_fingerprints(docs((1, "p q"))).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"p p").hexdigest()
    assert fingerprints.edited_fingerprints(docs()).count() == 0


def test_shards_hold_every_row_once(docs):
    df = docs(*[(i, f"t{i}") for i in range(997)], (None, None), (5, "t5")).withColumn("shard", F.lit("old")).repartition(7)
    out = sharding.shuffle_into_shards(df, 10, block_rows=30)
    rows = out.collect()
    assert collections.Counter(r.text for r in rows) == collections.Counter([f"t{i}" for i in range(997)] + [None, "t5"])
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(10)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(out.columns) == sorted([*docs().columns, "slot", "shard"])
    assert sharding.shuffle_into_shards(docs(), 4).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shuffle_into_shards(docs((1, "a"), (2, "b")), 5).collect()) == [(0, 0), (1, 0)]


def test_places_of_rows_are_uniform(docs):
    df, hits = docs(*[(i, "x") for i in range(24)]).repartition(3), np.zeros((2, 4))
    for seed in range(25):
        for r in sharding.shuffle_into_shards(df.select("doc_id"), 4, seed=seed, block_rows=4).collect():
            hits[r.doc_id % 2, r.shard] += 1
    assert abs(hits - 75).max() < 40


def test_matrix_rows_and_columns():
    before = np.append(0, np.cumsum([5, 0, 30, 7, 12, 1]))
    columns = np.array([20, 15, 10, 10])
    matrix = np.array([sharding.matrix_row(p, before, columns, 3) for p in range(6)])
    assert matrix.sum(axis=0).tolist() == columns.tolist() and matrix.sum(axis=1).tolist() == np.diff(before).tolist()
    drawn = [sharding.hypergeometric(6 * 10**9, 4 * 10**9, 10**6, np.random.default_rng(i)) for i in range(200)]
    assert abs(np.mean(drawn) - 600_000) < 200 and 300 < np.std(drawn) < 700


def test_contamination_is_that_of_sql(spark):
    df = queries.op4_decontamination(spark, SMALL)
    assert difference(df, oracle(SMALL), queries.ORACLES["op4_decontamination"]) is None


def test_windows_of_odd_items_and_texts(docs, spark):
    items = spark.createDataFrame([(1, "One two, THREE!"), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (None, "x"), (3, None), (4, "--"), (10, "three")], "item_id long, text string")
    df = docs((1, "zero one TWO three four"), (2, "a b c d e f g h i j"), (3, "b c d e f g h i j k z b c"), (4, None), (5, ""), (None, "three three"), (None, "three three"), (6, "Three É three"), (7, "x y"))
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(df.withColumn("key", F.lit(1)), items).collect()]
    assert sorted(r for r in rows if r[0]) == [(1, 5, 3, 2), (2, 10, 10, 1), (3, 13, 10, 1), (4, 0, 0, 0), (5, 0, 0, 0), (6, 3, 2, 1), (7, 2, 0, 0)]
    assert [r for r in rows if not r[0]] == [(None, 2, 2, 1)] * 2
    digest = {r.doc_id: r.items_sha256 for r in decontamination.contamination(df, items).collect()}
    assert digest[1] == hashlib.sha256(b"1,10").hexdigest() and digest[7] == hashlib.sha256(b"").hexdigest()
    left = {r.doc_id: r.text for r in decontamination.remove_spans(df, items).collect()}
    assert left == {1: "zero  four", 3: " z b c", 4: None, 5: "", 6: " É ", 7: "x y"}
    assert decontamination.contamination(docs(), items).count() == 0
    assert decontamination.contamination(df, items.limit(0)).where("contaminated").count() == 0


def test_only_a_to_z_are_lowered(docs):
    texts = {1: "ABZ äÖ", 2: "İSTANBUL", 3: "PLAIN text", 4: "ǅ ΑΣ", 5: None}
    got = {r.doc_id: r.x for r in docs(*texts.items()).select("doc_id", lower_ascii(F.col("text")).alias("x")).collect()}
    assert got == {1: "abz äÖ", 2: "İstanbul", 3: "plain text", 4: "ǅ ΑΣ", 5: None}
