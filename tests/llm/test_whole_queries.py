"""Registered queries and the pipeline as a whole."""

import collections
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tieout.llm import queries, sentence_pieces, sharding

SMALL = "/root/testdata/sf0.001"


def test_op3_puts_every_document_into_one_place(spark, given):
    rows = queries.op3_sharding(spark, SMALL).collect()
    texts = given[1]
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = collections.defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert sorted(map(tuple, queries.op3_sharding(spark, SMALL).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_shards_do_not_depend_on_batches(spark):
    df = spark.range(2500).repartition(3).select(F.col("id").alias("doc_id"))
    places = []
    for size in ("10000", "97"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        places.append({r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 7, block_rows=100).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert places[0] == places[1] and len(set(places[0].values())) == 2500


def test_pipeline_of_small_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = [r for r in given.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 120][:12]
    text = {r.doc_id: r.text for r in some}
    first, second = some[0], some[1]
    fresh = " ".join(f"zu{rng.integers(10**8)} wort" for _ in range(80))
    item = " ".join(f"frage{i}" for i in range(14))
    passage = " ".join(f"satz{i}" for i in range(70))
    ends = [" ".join(f"ende{rng.integers(10**8)}" for _ in range(60)) for _ in range(2)]
    extra = [
        (10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "12 34"), (10_005, first.text), (10_005, first.text), (10_006, fresh + " " + item + " " + fresh[::-1]),
        (10_007, "Ein Anfang. " + passage + " und " + ends[0]), (10_008, "Another one: " + passage + " the end " + ends[1]), (10_009, second.text + " more"), (None, "a text without a number"),
    ]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some] + [(d, t, "de", "s", None) for d, t in extra]
    df = spark.createDataFrame(rows, given.schema).withColumn("_spans", F.lit(1)).withColumn("node", F.lit("n")).withColumn("key", F.lit(2))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "sentence_pieces" or set(docs.columns) == set(df.columns)
    assert set(seen["language_id"]) == set(text) | {None, 10_005, 10_006, 10_007, 10_008, 10_009}
    assert set(seen["near_dedup"]) == set(seen["language_id"]) - {10_005, 10_009}
    cut = {d: r.text for d, r in seen["substring_dedup"].items()}
    assert passage in cut[10_007] and passage not in cut[10_008] and cut[10_008].startswith("Another one: ") and cut[10_008].endswith(ends[1])
    assert all(cut[d] == text[d] for d in text)
    clean = seen["decontamination"]
    assert "frage3" not in clean[10_006].text and clean[10_006].text.startswith(fresh)
    last = seen["sentence_pieces"]
    assert set(last) == set(clean)
    decoded = sentence_pieces.encode(spark.createDataFrame([(r.doc_id, r.text) for r in clean.values()], "doc_id long, text string"), decode=True).collect()
    for r in decoded:
        assert r.piece_ids == last[r.doc_id].piece_ids and last[r.doc_id].n_pieces == len(r.piece_ids)
        assert r.decoded == clean[r.doc_id].text.replace(sentence_pieces.MARK, " ")


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
