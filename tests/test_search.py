"""Near matches and outliers against slow but plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.operators import fuzzy, outliers


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def words(text):
    return " ".join(sorted(text.split()))


def slow_best(left, right, least):
    out = {}
    for a in set(left) - set(right):
        scored = []
        for b in set(right):
            x, y = words(a), words(b)
            score = 200.0 * common(x, y) / (len(x) + len(y)) if x or y else 0.0
            if score >= least:
                scored.append((-score, b))
        if scored:
            s, b = min(scored)
            out[a] = (b, round(-s, 1))
    return out


def check(spark, left, right, least, **options):
    source = spark.createDataFrame([(c,) for c in left], "account_code string")
    mapping = spark.createDataFrame([(c, "T", "k") for c in right], "source_account_code string, target_account_code string, metric_category string")
    got = {r.source_code: (r.suggested_code, r.score) for r in fuzzy.fuzzy_matches(source, mapping, least, **options).collect()}
    assert got == slow_best(left, right, least)
    return got


@pytest.mark.parametrize("limits", [{}, {"whole_deletions": 1}, {"whole_deletions": -1}])
@pytest.mark.parametrize("least", [70, 45])
def test_random_codes(spark, limits, least):
    rng = random.Random(7)
    code = lambda: "".join(rng.choice("ab1 ") for _ in range(rng.randint(1, 9))).strip() or "a"
    left, right = [code() for _ in range(60)], [code() for _ in range(50)]
    check(spark, left, right, least, **limits)


def test_lengths_beyond_one_number_of_the_fold(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abcé😀 ") for _ in range(rng.choice((1, 61, 62, 63, 124, 125, 150)))), "".join(rng.choice("abcé😀 ") for _ in range(rng.choice((0, 1, 62, 130))))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("n", F.length("a"))
    got = df.withColumn("c", fuzzy.common_length(fuzzy.places(F.col("a"), F.col("n")), F.col("n"), F.col("b"))).collect()
    assert [r.c for r in got] == [common(a, b) for a, b in pairs]


def test_segments_make_fewer_rows_than_all_pairs(spark):
    """1,500 names that differ in their digits only: every zero dropped once, against all of them."""
    names = [f"Customer#{i:09d}" for i in range(1500)]
    right = fuzzy.distinct_codes(spark.createDataFrame([(n,) for n in names], "code string"), "code")
    left = fuzzy.distinct_codes(spark.createDataFrame([(n[:9] + n[10:],) for n in names], "code string"), "code")
    rounds = fuzzy.deletion_rounds([17], [18], 80)
    needed = [lengths for r in (0, 1) if r in rounds for lengths in rounds[r]]
    ours = fuzzy.deletions(left, {(n, n - k) for n, m, k in needed})
    theirs = fuzzy.deletions(right, {(m, m - k) for n, m, k in needed}).groupBy("text", "size").agg(F.min("code").alias("code"))
    rows = ours.join(theirs, "text").count()
    best = {r.source_code: r.suggested_code for r in fuzzy.best_matches(left, right, 80).collect()}
    assert len(best) == 1500 and rows < 1500 * 1500 / 50
    assert best["Customer#00000017"] == "Customer#000000017"


def test_long_codes_are_finished_by_segments(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(12)]
    cut = lambda t, n: "".join(c for i, c in enumerate(t) if i not in set(rng.sample(range(len(t)), n)))
    left = [cut(b, n) for b, n in zip(base, [1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20])]
    got = check(spark, left, base, 80)
    assert len(got) >= 8


def test_digits_that_differ_little_and_one_hot_text(spark):
    right = [f"C#{i:05d}" for i in range(400)]
    left = [f"C{i:05d}" for i in range(0, 400, 7)] + ["C#0001", "zzz"]
    assert "zzz" not in check(spark, left, right, 80)


def test_nothing_to_match(spark):
    assert check(spark, ["a"], ["a"], 80) == {}
    assert check(spark, ["abc"], ["xyz"], 80) == {}


def test_words_in_any_order(spark):
    assert check(spark, ["ring small"], ["small ring", "small rings"], 80) == {"ring small": ("small ring", 100.0)}


def test_outliers_are_found(spark):
    rng = np.random.default_rng(1)
    data = [(f"a{i}", float(v)) for i, v in enumerate(rng.normal(100, 5, 400))] + [("far", 100000.0), ("low", -100000.0)]
    accounts = spark.createDataFrame(data, "account_code string, amount double")
    scored = outliers.outlier_scores(accounts)
    flagged = {r.account_code: r.score for r in outliers.outlier_accounts(scored).collect()}
    assert {"far", "low"} <= set(flagged) and len(flagged) <= 0.05 * len(data) + 1
    assert min(flagged["far"], flagged["low"]) == max(flagged.values()) or sorted(flagged.values())[-2] == min(flagged["far"], flagged["low"])
    assert [r.account_code for r in outliers.top_outliers(scored, 2).collect()] == ["far", "low"]
    again = {r.account_code for r in outliers.outlier_accounts(outliers.outlier_scores(accounts.repartition(7))).collect()}
    assert again == set(flagged)
    summary = outliers.outlier_summary(scored).first()
    assert (summary.total_accounts, summary.status) == (402, "complete")


def test_outliers_with_large_table_use_bounded_samples(spark):
    accounts = spark.range(20000).select(F.col("id").cast("string").alias("account_code"), (F.col("id") % 1000).cast("double").alias("amount"))
    sample = outliers._samples(accounts, 20000, 20, 256, 42).groupBy("tree").count().collect()
    assert {r["count"] for r in sample} == {256}


def test_few_accounts_are_not_scored(spark):
    accounts = spark.createDataFrame([(str(i), float(10**i)) for i in range(9)], "account_code string, amount double")
    scored = outliers.outlier_scores(accounts)
    assert outliers.outlier_accounts(scored).count() == 0 and outliers.outlier_summary(scored).first().status == "skipped"
