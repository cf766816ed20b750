"""Licence statements in documents: a trained paragraph classifier, confirmed by comparison with templates.

Only DataFrame functions and Spark's own logistic regression are used. Features are pairs of neighbouring words. The
model is trained on the templates, alone and inside ordinary paragraphs, against paragraphs of a bounded sample of
documents. As its weights are sparse, only the pairs that have one are looked up in the paragraphs of the corpus; a
paragraph without any is ordinary.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, functions as F

from tieout.llm.common import pin, small_side
from tieout.llm.decontamination import words_of

# Wordings of public licence notices by family.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
]
ORDINARY, UNKNOWN = "none", "unknown"
SAMPLE_DOCS = 300  # documents whose paragraphs are the ordinary examples
SAMPLE_CHARS = 20_000  # longest document among them
MIXED = 40  # examples of every template inside an ordinary paragraph
CONFIRMED = 0.8
MISSED = 0.02  # share of held-out statements that may fall below the least probability
EPS = 1e-9


def word_pairs(words: Column) -> Column:
    """Pairs of neighbouring words as texts; a single word stands for itself."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) < 2, words).otherwise(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def pair_hashes(words: Column) -> Column:
    """Hashes of the same pairs, made without joining texts."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) < 2, hashes).otherwise(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, paragraph, words) for every line that has a word. ``copy`` is a hash of the text."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", r"\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "copy", "paragraph", words_of(F.col("line")).alias("words")).where(F.size("words") > 0)


def _templates(spark) -> DataFrame:
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string")
    return rows.select("template", "family", words_of(F.col("text")).alias("words")).withColumn("pairs", F.array_distinct(word_pairs(F.col("words"))))


def _closest(pairs: Column, templates: list) -> Column:
    """Largest share of a template's word pairs that a paragraph has."""
    return F.greatest(F.lit(0.0), *[F.size(F.array_intersect(pairs, F.array(*[F.lit(p) for p in t["pairs"]]))) / len(t["pairs"]) for t in templates])


def examples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(family, pairs, held_out): ordinary paragraphs, every template, and templates between words of ordinary paragraphs."""
    templates = pin(_templates(docs.sparkSession))
    known = templates.collect()
    text = F.coalesce("text", F.lit(""))
    few = docs.where(F.octet_length(text) <= SAMPLE_CHARS).select("doc_id", "text", F.xxhash64("doc_id", F.lit(6)).alias("h")).orderBy("h", "text").limit(sample_docs)
    plain = pin(paragraphs(few).select("words", F.xxhash64("words").alias("h"), word_pairs(F.col("words")).alias("pairs")).dropDuplicates(["h"]))
    plain = plain.where(_closest(F.col("pairs"), known) < 0.5)
    places = F.explode(F.sequence(F.lit(0), F.lit(MIXED - 1))).alias("place")
    mixed = templates.select("template", "family", F.col("words").alias("t"), places)
    around = plain.select("words", F.pmod(F.col("h"), F.lit(len(TEMPLATES) * MIXED)).alias("at")).groupBy("at").agg(F.min("words").alias("words"))
    mixed = mixed.join(around, F.col("template") * MIXED + F.col("place") == F.col("at"), "left")
    before = F.slice(F.coalesce("words", F.array().cast("array<string>")), 1, 1 + F.col("place") % 20)
    all_words = F.when(F.col("place") % 4 == 0, F.col("t")).when(F.col("place") % 4 == 1, F.concat("t", before)).otherwise(F.concat(before, "t"))
    positive = mixed.select("family", word_pairs(all_words).alias("pairs"), (F.col("place") % 5 == 0).alias("held_out"))
    negative = plain.select(F.lit(ORDINARY).alias("family"), "pairs", (F.pmod(F.col("h"), F.lit(5)) == 0).alias("held_out"))
    return pin(positive.union(negative).coalesce(2))


class Classifier:
    """Weights of the word pairs that have any, the intercepts, a temperature and the least probability."""

    def __init__(self, docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
        rows = examples(docs, sample_docs)
        self.spark = docs.sparkSession
        names = sorted({f for f, _ in TEMPLATES}) + [ORDINARY]
        label = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1
        rows = rows.withColumn("label", label.cast("double"))
        counted = CountVectorizer(inputCol="pairs", outputCol="features", binary=True, vocabSize=1 << 16, minDF=2.0).fit(rows)
        train = counted.transform(rows.where("NOT held_out"))
        model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.9, maxIter=60, standardization=False).fit(train)
        matrix = model.coefficientMatrix.toArray()
        classes = min(matrix.shape[0], len(names))  # the last class is missing if the sample has no ordinary paragraph
        self.names = names[:classes]
        intercepts = model.interceptVector.toArray()
        kept = [i for i in range(matrix.shape[1]) if abs(matrix[:, i]).max() > EPS]
        self.intercepts = [float(x) for x in intercepts[:classes]]
        self.weights = pin(self.spark.createDataFrame([(counted.vocabulary[i], [float(x) for x in matrix[:classes, i]]) for i in kept], "pair string, weight array<double>").withColumn("h", F.element_at(pair_hashes(F.split("pair", " ")), 1)))
        self.temperature, self.least = 1.0, 0.5
        held = pin(rows.where("held_out").withColumn("id", F.monotonically_increasing_id()).withColumn("hashes", F.transform("pairs", lambda p: F.element_at(pair_hashes(F.split(p, " ")), 1))))
        scored = self._sums(held.select("id", F.explode("hashes").alias("h")), ["id"])
        scored = pin(held.select("id", "label").join(scored, "id", "left").withColumn("sums", F.coalesce("sums", F.array(*[F.lit(0.0)] * classes))))
        losses = scored.agg(*[F.avg(-F.log(F.greatest(F.element_at(self._chances(t), F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(_TEMPERATURES)]).first()
        self.temperature = min(((loss if loss is not None else 0.0), t) for loss, t in zip(losses, _TEMPERATURES))[1]
        right = F.element_at(self._chances(self.temperature), F.col("label").cast("int") + 1)
        low = scored.where(F.col("label") < len(names) - 1).agg(F.percentile_approx(right, MISSED)).first()[0]
        self.least = min(max(low or 0.5, 0.3), 0.9)

    def _sums(self, features: DataFrame, keys: list[str]) -> DataFrame:
        """Sum of weights of all classes for every key with a weighted word pair."""
        known = small_side(self.weights.select(F.col("h").alias("_h"), *[F.element_at("weight", i + 1).alias(f"w{i}") for i in range(len(self.names))]))
        found = features.join(known, F.col("h") == F.col("_h")).dropDuplicates([*keys, "h"]).groupBy(*keys).agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(self.names))])
        return found.select(*keys, F.array(*[f"s{i}" for i in range(len(self.names))]).alias("sums"))

    def _chances(self, temperature: float) -> Column:
        logits = F.zip_with("sums", F.array(*[F.lit(x) for x in self.intercepts]), lambda s, b: (s + b) / temperature)
        powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
        return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))

    def statements(self, docs: DataFrame, confirmed: float = CONFIRMED) -> DataFrame:
        """doc_id, paragraph, family, probability, template_likeness, confirmed for paragraphs that are no ordinary ones."""
        lines = paragraphs(docs)
        features = lines.select("doc_id", "copy", "paragraph", F.explode(pair_hashes(F.col("words"))).alias("h"))
        chances = F.slice(F.col("chances"), 1, len({f for f, _ in TEMPLATES}))
        scored = self._sums(features, ["doc_id", "copy", "paragraph"]).withColumn("chances", self._chances(self.temperature))
        scored = scored.withColumn("probability", F.array_max(chances)).withColumn("ordinary", F.coalesce(F.try_element_at("chances", F.lit(len({f for f, _ in TEMPLATES}) + 1)), F.lit(0.0)))
        scored = scored.withColumn("family", F.element_at(F.array(*[F.lit(n) for n in self.names]), F.array_position(chances, F.col("probability")).cast("int")))
        scored = pin(scored.where("probability > ordinary").select("doc_id", "copy", "paragraph", "family", "probability"))
        return _confirm(docs, scored, self.least, confirmed)


_TEMPERATURES = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0]


def _confirm(docs: DataFrame, found: DataFrame, least: float, confirmed: float) -> DataFrame:
    """Compare the paragraphs found with the templates of their family; what is unsure or unlike is ``unknown``."""
    wanted = small_side(found.select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c"), F.col("paragraph").alias("_p"), "family", "probability").distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("copy") == F.col("_c")) & (F.col("paragraph") == F.col("_p"))
    of = small_side(found.select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c")).distinct())
    some = docs.join(of, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_c")), "left_semi")
    lines = paragraphs(some).join(wanted, same)
    pairs = word_pairs(F.col("words"))
    likeness, templates = F.lit(0.0), _templates(docs.sparkSession).collect()
    for family in sorted({f for f, _ in TEMPLATES}):
        likeness = F.when(F.col("family") == family, _closest(F.col("pairs"), [t for t in templates if t["family"] == family])).otherwise(likeness)
    out = lines.withColumn("pairs", pairs).withColumn("template_likeness", likeness)
    sure = (F.col("template_likeness") >= confirmed) & (F.col("probability") >= least)
    return out.select("doc_id", "paragraph", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "template_likeness", sure.alias("confirmed"))


def license_statements(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row for every paragraph that states a licence: doc_id, paragraph (line number from 0), family, probability, template_likeness, confirmed.

    The family is ``unknown`` if the calibrated probability is below the least one of held-out statements or the
    paragraph has less than 80 % of the word pairs of every template of its family. Ordinary paragraphs give no row. Null or
    empty text: no rows. Null doc_id: rows like others. Repeated rows give repeated results. Empty input: no rows.
    """
    return Classifier(docs, sample_docs).statements(docs)
