"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_copies import brute
from tieout.llm import jaccard_join, queries

SMALL = "/root/testdata/sf0.001"


def groups(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, **options).collect()}


def test_query_is_that_of_brute_force(spark, given):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard_join(spark, SMALL).collect()}
    assert got == brute(given[1], 4, 85)


def families(rng, count, copies, long, vocabulary=3000):
    texts = {}
    for _ in range(count):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(8, long))]
        for _ in range(rng.randrange(1, copies)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
            base = copy if rng.random() < 0.3 else base
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize("cell_rows, demoted", [(2, 0), (2, 1 << 20), (6, 20), (32, 1 << 20)])
def test_families_with_every_way_to_compare(docs, cell_rows, demoted, monkeypatch):
    """Small cells send families through pivots and changes, large ones through sketches."""
    monkeypatch.setattr(jaccard_join, "WHOLE", 6)
    rng = random.Random(cell_rows + demoted)
    texts = families(rng, 12, 25, 160)
    line = "the same line in very many of all the documents here"
    texts |= {1000 + i: f"{line} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 60))) for i in range(40)}
    assert groups(docs(*texts.items()), cell_rows=cell_rows, demoted=demoted) == brute(texts, 4, 85)


def test_chains_that_reach_beyond_any_pivot(docs, monkeypatch):
    """Each text differs from the next a little, so that the ends have nothing in common."""
    monkeypatch.setattr(jaccard_join, "WHOLE", 6)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[i : i + 120]) for i in range(0, 250, 4)}
    for options in ({}, {"cell_rows": 2}):
        got = groups(docs(*texts.items()), **options)
        assert got == brute(texts, 4, 85) and {c for _, c in got.values()} == {0}


def test_sketches_never_exceed_the_differences():
    rng = np.random.default_rng(1)
    sets = []
    for n in (1, 3, 40, 100, 130, 500, 9000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        sets += [base, np.unique(np.append(base[n // 12 :], rng.integers(0, 2**64, n // 12, dtype=np.uint64)))]
    sets.append(np.unique(np.arange(1, 900, dtype=np.uint64)))  # all in one bucket
    sets.append(np.unique(np.arange(1, 990, dtype=np.uint64)))
    n = np.array([len(s) for s in sets])
    sketches = [jaccard_join.sketch(s, level) for s, level in zip(sets, jaccard_join.sketch_level(n).tolist())]
    first, second = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    bound = jaccard_join._differences(first, second, n, sketches)
    for a, b, least in zip(first, second, bound):
        assert least <= len(np.setxor1d(sets[a], sets[b]))
    assert (bound[first == second] == 0).all() and bound.max() > 900 and np.median(bound) > 30


def test_groups_of_odd_rows(docs):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    df = docs(
        (5, None), (6, ""), (7, " \n"), (None, "one two"), (8, "One two"), (9, "oNE two"), (9, "oNE two"), (9, "oNE two"), (4, "x y z u v"), (4, "q r s t"), (3, "Q R S T"),
        (2, "É é É é"), (1, "é é é é"), (20, long), (21, long + " end"), (22, "end " + long), (23, "x y z u v"), (4, "x y z u v"),
    )
    df = df.withColumn("node", F.lit("n")).withColumn("region", F.lit(1)).withColumn("sketch", F.lit(2))
    rows = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()]
    assert sorted(r for r in rows if r[0] is not None) == [
        (1, 1), (2, 2), (3, 3), (4, 3), (4, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 8), (9, 8), (9, 8), (9, 8), (20, 20), (21, 20), (22, 20), (23, 3),
    ]
    assert [r for r in rows if r[0] is None] == [(None, None)]
    assert jaccard_join.jaccard_groups(docs()).count() == 0


def test_members_meet_once_for_all_changes_that_they_share(spark):
    rng = np.random.default_rng(3)
    data = []
    for group in range(10):  # two members of each group differ in more than they may, and share very many changes
        common = rng.integers(-(2**63), 2**63, 600).tolist()
        for node in (2 * group, 2 * group + 1):
            own = rng.integers(-(2**63), 2**63, 80 if group < 8 else 5).tolist()
            data.append((1, node, node, node, len(common) + len(own), common + own))
    members = spark.createDataFrame(data, "region long, node long, which long, c long, n long, changes array<long>")
    pairs = jaccard_join.by_changes(members, 85)
    assert {(16, 17), (18, 19)} <= {(r.a, r.b) for r in pairs.collect()}
    assert pairs.count() < 6  # as many as ten without sketches
    each = spark.createDataFrame([(1, change, node, node, node, 3, change) for node in (1, 2) for change in range(50)] + [(1, 50, 2, 2, 2, 3, 50), (1, 50, 3, 3, 3, 3, 50)], "region long, change long, node long, which long, c long, weight long, room long")
    assert sorted((r.node, r.room) for r in jaccard_join._by_holders(each).collect()) == [(1, 49), (2, 49), (2, 50), (3, 50)]


def test_only_changes_that_can_be_the_first_common_one_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    draw = lambda n: set(rng.integers(-(2**63), 2**63, n).tolist())
    pivot, line, sets = draw(200), draw(12), []
    for _ in range(60):
        sets.append(draw(188) | line)
    for base in [*sets[:5], *[pivot] * 8]:  # the latter are changed in many places, some of them the same
        sets.append(set(sorted(base)[int(rng.integers(6, 40)) :]) | draw(6))
    data = [(1, node, node, node, len(s), sorted(s ^ pivot)) for node, s in enumerate(sets)]
    members = spark.createDataFrame(data, "region long, node long, which long, c long, n long, changes array<long>").cache()
    first, rows = jaccard_join._first_changes, []

    def counted(members, tables, percent):
        out = first(members, tables, percent)
        rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_first_changes", counted)
    pairs = {(r.a, r.b) for r in jaccard_join.by_changes(members, 85).collect()}
    near = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if near(sets[a], sets[b]) and not (near(sets[a], pivot) and near(sets[b], pivot))}
    assert similar and similar <= pairs
    assert rows[0] < sum(len(d[5]) for d in data) / 20
