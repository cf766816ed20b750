"""Near copies and repeated passages against brute force."""

import collections
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tieout import scale
from tieout.llm import near_dedup, substring_dedup
from tieout.llm.components import components
from tieout.llm.words import Words, shingles, text_slices
from tieout.scale import application_folder, pin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def brute(texts, width, percent):
    sets = {}
    for doc, text in texts.items():
        w = words(text)
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_are_those_of_brute_force(given, width):
    df, texts = given
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(df, width, 80).collect()}
    assert got == brute(texts, width, 80)


def test_families_with_edits_at_the_limit(docs):
    rng = random.Random(5)
    texts, doc = {}, 0
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[doc] = " ".join(copy)
            doc += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(*texts.items()), 2, 80).collect()}
    assert got == brute(texts, 2, 80)


def test_families_are_joined_by_few_links(docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for doc in range(80):
        copy = list(base)
        for place in rng.sample(range(120), 6):
            copy[place] = f"n{doc}x{place}"
        texts[doc] = " ".join(copy)
    sizes = []

    def counted(links):
        sizes.append(links.distinct().count())
        return components(links)

    monkeypatch.setattr(near_dedup, "components", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs(*texts.items()), 2, 80).collect()}
    assert got == brute(texts, 2, 80)
    assert max(sizes) <= 3 * len(texts)  # one for each hub that a copy meets would be several times as many


def test_near_groups_of_odd_rows(docs):
    df = docs((5, None), (6, ""), (7, "  \n"), (None, "a b c"), (8, "One"), (9, "oNE"), (9, "oNE"), (4, "x y"), (4, "q r"), (3, "Q R"), (2, "É é"), (1, "é é"))
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df, 2, 80).collect()]
    assert sorted(r for r in rows if r[0] is not None) == [
        (1, 1, 1, True), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 3, False), (4, 1, 3, False), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False),
    ]
    assert [r for r in rows if r[0] is None] == [(None, 2, None, True)]
    assert near_dedup.near_groups(docs(), 2, 80).count() == 0
    extra = df.withColumn("bands", F.lit(1)).withColumn("node", F.lit("n"))
    kept = near_dedup.drop_near_copies(extra, 2)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 5, 6, 7, 8]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 150)] + [(300, 200), (200, 250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))
    assert got[300] == got[250] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_long_repeat_is_found(given):
    df, texts = given
    rows = {d: words(t) for d, t in texts.items()}
    first, wanted = {}, collections.defaultdict(set)
    for doc in sorted(rows):
        w = rows[doc]
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if first.setdefault(run, doc) != doc:
                wanted[doc].update(range(i, i + 50))
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(df).collect():
        found[r.doc_id].update(range(r.first_word, r.end_word))
        mine, other = rows[r.doc_id][r.first_word : r.end_word], rows[r.source_doc_id][r.source_first_word : r.source_end_word]
        assert r.source_doc_id < r.doc_id and len(mine) >= 50 and r.identity >= 0.8
        assert len(set(mine) & set(other)) >= 0.6 * len(set(mine))
        assert words(texts[r.doc_id].encode()[r.begin_byte : r.end_byte].decode()) == mine
    assert wanted and all(span <= found[doc] for doc, span in wanted.items())


def uncovered(texts, found, least=50):
    """Words in runs of ``least`` words that an earlier document has too and that no passage covers, by document."""
    first, wanted = {}, collections.defaultdict(set)
    for doc in sorted(texts):
        w = words(texts[doc])
        for i in range(len(w) - least + 1):
            if first.setdefault(tuple(w[i : i + least]), doc) != doc:
                wanted[doc].update(range(i, i + least))
    for r in found:
        wanted[r.doc_id] -= set(range(r.first_word, r.end_word))
        assert r.identity < 1 or words(texts[r.doc_id])[r.first_word : r.end_word] == words(texts[r.source_doc_id])[r.source_first_word : r.source_end_word]
    return {d: sorted(x) for d, x in wanted.items() if x}


def test_copies_of_documents_that_repeat_themselves_are_found(docs):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"s{rng.randrange(10**7)}" for _ in range(n))
    line, block = fresh(9), fresh(30)
    mixed = "\n".join(x for _ in range(5) for x in (block, fresh(7)))
    texts = {1: "same " * 372, 2: "same " * 372, 3: "\n".join([line] * 30), 4: fresh(60) + "\n" + "\n".join([line] * 40), 5: mixed, 6: fresh(20) + " " + mixed, 7: "same " * 900}
    found = substring_dedup.repeated_passages(docs(*texts.items())).collect()
    assert {2, 4, 6, 7} == {r.doc_id for r in found} and uncovered(texts, found) == {}
    cut = {r.doc_id: words(r.text) for r in substring_dedup.dedup_passages(docs(*texts.items())).collect()}
    assert set(cut) == {1, 3, 4, 5, 6} and len(cut[4]) == 60 and len(cut[6]) == 20


def test_a_passage_whose_parts_stand_in_other_documents_is_found(docs):
    rng = random.Random(6)
    fresh = lambda n: [f"p{rng.randrange(10**7)}" for _ in range(n)]
    make = lambda *parts: " ".join(w for p in parts for w in p)
    passage, ends = fresh(60), fresh(52)
    texts = {0: make(fresh(40), passage[30:], fresh(40)), 1: make(fresh(30), passage[:30], fresh(30)), 2: make(fresh(70), passage), 3: make(passage, fresh(90)), 4: make(fresh(30), ends[:26], fresh(20), ends[26:]), 5: make(ends, fresh(20)), 6: make(fresh(25), ends, fresh(25))}
    found = substring_dedup.repeated_passages(docs(*texts.items())).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(3, 2), (6, 5)} and uncovered(texts, found) == {}


@pytest.mark.parametrize("every", [10, 7, 5])
def test_passages_with_many_changed_words_are_found(docs, every):
    rng = random.Random(every)
    fresh = lambda n: [f"f{rng.randrange(10**8)}" for _ in range(n)]
    rows = {}
    for i in range(40):
        passage = fresh(60)
        edited = [fresh(1)[0] if k % every == every // 2 else w for k, w in enumerate(passage)]
        rows[i], rows[100 + i] = " ".join(fresh(50) + passage + fresh(30)), " ".join(fresh(20) + edited + fresh(60))
    found = substring_dedup.repeated_passages(docs(*rows.items())).collect()
    assert all(r.source_doc_id == r.doc_id - 100 and r.identity >= 0.8 for r in found) and len({r.doc_id for r in found}) >= 38


def test_fuzzy_passages_whose_parts_stand_in_two_earlier_documents(docs):
    """A has the end of a passage, B its beginning, C the whole, and D the whole with every tenth word changed."""
    rng = random.Random(8)
    fresh = lambda n: [f"q{rng.randrange(10**8)}" for _ in range(n)]
    rows, border = {}, 35
    for i in range(60):
        passage = fresh(60)
        edited = [fresh(1)[0] if k % 10 == border % 10 else w for k, w in enumerate(passage)]
        parts = (passage[border:], passage[:border], passage, edited)
        rows |= {1000 * k + i: " ".join(fresh(30) + part + fresh(30)) for k, part in enumerate(parts)}
    found = substring_dedup.repeated_passages(docs(*rows.items())).collect()
    assert all(r.doc_id - r.source_doc_id == 1000 for r in found if r.doc_id >= 3000)
    assert len({r.doc_id for r in found if r.doc_id >= 3000}) >= 54


def behind_others(rng, before):
    """``before`` documents with each part of a passage, then (2000) the whole, and (3000) the whole with every tenth word changed."""
    fresh = lambda n: [f"v{rng.randrange(10**8)}" for _ in range(n)]
    passage = fresh(60)
    edited = [fresh(1)[0] if k % 10 == 5 else w for k, w in enumerate(passage)]
    rows = {before * k + i: fresh(30) + part + fresh(30) for k, part in enumerate((passage[:23], passage[18:43], passage[38:])) for i in range(before)}
    return {d: " ".join(w) for d, w in (rows | {2000: fresh(40) + passage + fresh(20), 3000: fresh(20) + edited + fresh(50)}).items()}


@pytest.mark.parametrize("before", [4, 84])
def test_fuzzy_passages_whose_source_comes_behind_other_documents(docs, before):
    """Also if the seeds stand in so many surroundings that they are matched by two."""
    found = substring_dedup.repeated_passages(docs(*behind_others(random.Random(0), before).items())).collect()
    assert [(r.doc_id, r.source_doc_id) for r in found] == [(3000, 2000)]
    assert found[0].first_word <= 24 and found[0].end_word >= 76 and found[0].identity >= 0.85


def test_the_stage_of_the_pipeline_cuts_passages_whose_source_comes_behind_other_documents(spark, docs):
    rows = behind_others(random.Random(0), 4)
    cut = {r.doc_id: words(r.text) for r in corpus_pipeline.cut_repeated_passages(spark, docs(*rows.items()), "").collect()}
    assert len(cut[3000]) <= 75 and all(cut[d] == words(t) for d, t in rows.items() if d != 3000)


@pytest.mark.parametrize("size, held", [(10000, 100_000), (7, 100_000), (7, 5)])
def test_open_seeds_meet_every_earlier_document(spark, docs, monkeypatch, size, held):
    """Against all pairs of occurrences; rows cut into batches and groups given in parts change nothing."""
    rng = random.Random(4)
    line = [f"l{i}" for i in range(9)]
    texts = {i: [f"r{rng.randrange(40)}" for _ in range(70)] + line + [f"r{rng.randrange(40)}" for _ in range(rng.randrange(70))] for i in range(30)}
    df = docs(*[(i, " ".join(w)) for i, w in texts.items()])
    spans = spark.createDataFrame([(3, [(0, 79)])], "_of long, _spans array<struct<first_word: int, end_word: int>>")
    table, hot = substring_dedup.repeated_seeds(df, 4, 1)
    monkeypatch.setattr(substring_dedup, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    met = substring_dedup.open_matches(substring_dedup.open_seeds(df, spans, 4, 1, table, 50)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = collections.defaultdict(list)
    for d, w in texts.items():
        for p in range(len(w) - 3):
            places[tuple(w[p : p + 4])].append((d, p))
    pairs = {(d, e, p, q) for at in places.values() for d, p in at for e, q in at if e < d and (d != 3 or p + 4 > 79)}
    crowded = {(r.doc_id, r.place) for r in met if r.source_doc_id is None}
    got = {(r.doc_id, r.source_doc_id, r.place, r.source_place) for r in met if r.source_doc_id is not None}
    assert got | {x for x in pairs if (x[0], x[2]) in crowded} == pairs and got
    assert bool(crowded) == (held == 5)


def test_crowded_seeds_meet_by_two(spark, monkeypatch):
    schema = substring_dedup.OPEN
    rows = [(s, d, p + d, 0, 1000 * d + p, d == 9) for d in range(10) for s, p in ((1, 0), (2, 30), (3, 100))]
    rows += [(4, d, 400 + p, 0, d, True) for d in (2, 3) for p in range(0, 40, 2)]  # a streak: its ends belong together
    for held in (100_000, 2):
        monkeypatch.setattr(substring_dedup, "HELD", held)
        two = substring_dedup.neighbours(spark.createDataFrame(rows, schema).coalesce(1))
        assert {(r.doc_id, r.place, r.next) for r in two.collect()} == {(9, 9, 39)}
        every = substring_dedup.neighbours(spark.createDataFrame(rows, schema), substring_dedup.bit_table(two.select("key")))
        met = {(r.doc_id, r.source_doc_id, r.place, r.source_place) for r in substring_dedup.neighbour_matches(every).collect()}
        assert met == {(9, d, p + 9, p + d) for d in range(9) for p in (0, 30)}


@pytest.mark.parametrize("rate, least", [(0.08, 0.97), (0.12, 0.93), (0.15, 0.9)])
def test_recall_of_edited_passages_of_given_documents(docs, given, rate, least):
    """Passages of 80 words of given texts, words replaced at random; those of 80 % identity or more are to be found."""
    rng = random.Random(int(rate * 100))
    long = [words(t) for t in given[1].values() if len(words(t)) > 300]
    rows, spans = {}, {}
    for i in range(60):
        source = long[rng.randrange(len(long))]
        at = rng.randrange(len(source) - 80)
        passage = [f"z{rng.randrange(10**8)}" if rng.random() < rate else w for w in source[at : at + 80]]
        rows[i], rows[1000 + i] = " ".join(source), " ".join([f"y{rng.randrange(10**8)}" for _ in range(40)] + passage + [f"y{rng.randrange(10**8)}" for _ in range(40)])
        if sum(a == b for a, b in zip(passage, source[at : at + 80])) >= 64:
            spans[1000 + i] = set(range(40, 120))
    covered = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs(*rows.items())).collect():
        covered[r.doc_id] |= set(range(r.first_word, r.end_word))
    hit = sum(len(span & covered[doc]) >= 64 for doc, span in spans.items())
    assert len(spans) > 40 and hit >= least * len(spans)


def test_tables_of_repeated_seeds_and_contexts(docs):
    same = " ".join(f"a{i}" for i in range(30))
    df = docs((1, same), (2, "x " + same), (3, " ".join(f"b{i}" for i in range(30))))
    table, hot = substring_dedup.repeated_seeds(df, 4, 1)
    rows = substring_dedup.seeds(df, 4, 1, table, hot)
    assert sum(int(x).bit_count() for x in table) == 27 and sorted(r.doc_id for r in rows.collect()) == [1] * 27 + [2] * 27 and not hot.any()
    met = substring_dedup.seed_matches(rows, 3).collect()
    assert {(r.doc_id, r.source_doc_id, r.place - r.source_place, r.number) for r in met} == {(2, 1, 1, 1)} and len(met) == 27
    assert not substring_dedup.repeated_seeds(docs(), 4, 1)[0].any()


@pytest.mark.parametrize("size", ["10000", "7"])
def test_matches_of_hot_seeds_and_of_small_batches(spark, docs, size):
    """Each occurrence meets the first three documents, whichever way and however rows are cut into batches."""
    rng = random.Random(12)
    line = " ".join(f"l{i}" for i in range(20))
    texts = {i: " ".join([f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(6))] + [line] * rng.randrange(1, 3)) for i in range(40)}
    df = docs(*texts.items())
    table, hot = substring_dedup.repeated_seeds(df, 4, 1, hot=30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    none = hot ^ hot
    one = {tuple(r) for r in substring_dedup.seed_matches(substring_dedup.seeds(df, 4, 1, table, none), 3).collect()}
    two = {tuple(r) for r in substring_dedup.hot_matches(substring_dedup.seeds(df, 4, 1, hot, none), 3).collect()}
    two |= {tuple(r) for r in substring_dedup.seed_matches(substring_dedup.seeds(df, 4, 1, table, hot), 3).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert hot.any() and one == two and {r[1] for r in one if r[4] <= 3} >= {0, 1, 2}
    assert all(r[0] > r[1] for r in one) and {r[4] for r in one} == {1, 2, 3}


def test_stages_leave_only_their_result_behind(spark, docs):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    planted = text(70)
    some = docs(*[(d, " ".join(text(100) + (planted if d < 3 else []) + text(40))) for d in range(6)], (6, " ".join(text(60))))
    folder = application_folder(spark)
    before = set(os.listdir(folder))
    kept = near_dedup.drop_near_copies(some)
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 7
    before = set(os.listdir(folder))
    cut = substring_dedup.dedup_passages(kept)
    assert len(set(os.listdir(folder)) - before) == 1
    assert {r.doc_id: len(words(r.text)) for r in cut.collect()} == {0: 210, 1: 140, 2: 140, 3: 140, 4: 140, 5: 140, 6: 60}


def test_units_of_two_documents_only_are_kept(docs):
    shared, one = [" ".join(f"{c}{i}" for i in range(80)) for c in "sx"]
    some = docs((1, shared + " a b c"), (2, "d e " + shared), (3, one + " " + one)).select("doc_id", "text")
    assert {r.doc_id for r in substring_dedup.shared_units(some, 50, 16).collect()} == {1, 2}


def test_planted_passages_are_cut_and_clean_documents_stay(docs):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"t{rng.randrange(10**7)}" for _ in range(n))
    passage = fresh(60)
    edited = passage.split()
    for i in (13, 30, 47):
        edited[i] = "other"
    short = fresh(30)
    rows = {1: fresh(100) + " " + passage, 2: passage + " " + fresh(80), 3: fresh(40) + "\n" + " ".join(edited) + " " + fresh(40), 4: fresh(90) + " " + short, 5: short + " " + fresh(70), 6: passage.upper(), 7: fresh(200)}
    df = docs(*rows.items(), (None, passage), (8, None), (9, ""))
    found = {r.doc_id: r.source_doc_id for r in substring_dedup.repeated_passages(df).collect()}
    assert found == {2: 1, 3: 1, 6: 1}
    cut = {r.doc_id: r.text for r in substring_dedup.dedup_passages(df.withColumn("_spans", F.lit(0))).collect()}
    assert set(cut) == {1, 2, 3, 4, 5, 7, 8, 9, None}
    assert all(cut[d] == rows[d] for d in (1, 4, 5, 7)) and cut[8] is None and cut[9] == ""
    assert passage not in cut[2] and words(cut[2]) == words(rows[2])[60:]
    assert 75 <= len(words(cut[3])) <= 85
    assert substring_dedup.dedup_passages(docs()).count() == 0


def test_chains_take_the_best_ordered_matches():
    place = [0, 6, 12, 18, 24, 30]
    other = np.array([100, 106, 5, 118, 124, 130])
    chains = substring_dedup.best_chains(place, other, 20, 40, 0.1, 5.0)
    assert chains == [[0, 1, 3, 4, 5]]
    assert substring_dedup.best_chains([0, 60], np.array([0, 60]), 0, 40, 0.01, 5.0) == [[0], [1]]


def test_plain_matches_are_one_best_chain():
    rng = np.random.default_rng(3)
    for _ in range(200):
        place = np.cumsum(rng.integers(1, 30, rng.integers(1, 40)))
        other = place + 7 + (np.arange(len(place)) > rng.integers(0, 80)) * rng.integers(0, 2)
        if substring_dedup.plain(place, other, 40, 0.1, 5.0):
            assert substring_dedup.best_chains(place.tolist(), other, 0, 40, 0.1, 5.0) == [list(range(len(place)))]
    assert substring_dedup.plain(np.array([3, 9]), np.array([4, 10]), 40, 0.1, 5.0) and not substring_dedup.plain(np.array([3, 9]), np.array([4, 11]), 40, 0.1, 5.0)


def test_alignment_counts_words_in_gaps():
    a = np.arange(100)
    b = np.concatenate([np.arange(40), [900, 901], np.arange(41, 100)])
    places = np.array([2, 20, 60, 90])
    others = np.array([2, 20, 61, 91])
    first, end, other_first, other_end, same = substring_dedup.align(a, b, places, others, 5)
    assert (first, end, other_first, other_end, same) == (0, 100, 0, 101, 99)


def test_hot_copies_stay_linear(docs):
    rng = random.Random(9)
    text = " ".join(f"h{rng.randrange(10**6)}" for _ in range(80))
    rows = [(i, text if i % 3 == 0 else " ".join(f"u{rng.randrange(10**7)}" for _ in range(60))) for i in range(300)]
    found = substring_dedup.repeated_passages(docs(*rows)).collect()
    assert len(found) == 99 and {r.source_doc_id for r in found} == {0}
    groups = near_dedup.near_groups(docs(*rows)).groupBy("component_id").count().where("count > 1").collect()
    assert [(r[0], r[1]) for r in groups] == [(0, 100)]


def test_seeds_and_units_of_a_slice_are_those_of_each_text():
    def kmers(hashes, width):
        return shingles(hashes, width) if len(hashes) >= width else np.zeros(0, np.uint64)

    rng = np.random.default_rng(2)
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else " ".join(rng.choice(list("abcd"), rng.integers(0, 30))) for _ in range(rng.integers(1, 8))]
        width, window, length = int(rng.integers(1, 6)), int(rng.integers(1, 6)), int(rng.integers(6, 12))
        for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
            words = Words(data, offsets)
            seeds, units = set(), set()
            for row in range(len(offsets) - 1):
                k = kmers(words.of(row), width)
                for i in range(max(len(k) - window + 1, min(len(k), 1))):
                    at = i + int(np.argmin(k[i : i + window]))
                    seeds.add((row, at, int(k[at])))
                units |= {(row, i, int(k[i + int(np.argmin(k[i : i + length - width + 1]))])) for i in range(len(words.of(row)) - length + 1)}
            assert set(zip(*(x.tolist() for x in substring_dedup.chosen_seeds(words, width, window)))) == seeds
            text, seed, _, place, n = substring_dedup.units_of(words, length, width)
            assert {(t, p + i, s) for t, s, p, m in zip(text.tolist(), seed.tolist(), place.tolist(), n.tolist()) for i in range(m)} == units


def test_chains_of_plain_and_bent_groups(spark):
    rows = [(2, 1, p, p + 5, 1, 0) for p in (0, 8, 16)] + [(3, 1, 0, 0, 2, 0), (3, 1, 8, 9, 1, 1)] + [(4, 1, 0, 0, 1, 0), (4, 1, 90, 90, 1, 1)] + [(5, 1, 7, 7, 3, 1)]
    found = substring_dedup._chains(spark.createDataFrame(rows, substring_dedup.MATCH), 0, 40, 0.1, 5.0).collect()
    assert sorted((r.doc_id, r.places, r.source_places, r.number, r.firm) for r in found) == [
        (2, [0, 8, 16], [5, 13, 21], 1, 0), (3, [0, 8], [0, 9], 1, 1), (4, [0], [0], 1, 0), (4, [90], [90], 1, 1), (5, [7], [7], 3, 1),
    ]


def test_a_pinned_table_leaves_no_exchanged_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: held.getAllBlocks().size()
    before = files()
    table = pin(spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and table.count() == 997
    assert spark.conf.get(scale.FILE_CLEANUP) == "false"
