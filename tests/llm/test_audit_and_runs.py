"""The filter audit and periodic runs against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import filter_audit, periodic_runs, queries
from verification.compare import difference, oracle

SMALL = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def audit_by_hand(rows, labels):
    """Every order applied document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    docs = []
    for doc, text, lang in rows:
        w, t = split(text), text or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)}
        fails |= {"D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, doc in good, doc in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        credit = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                late = [d for d in docs if d[0] == part and x in d[1] and d not in left]
                redundant = sum(1 for d in docs if d[0] == part and x in d[1]) - len(gone)
                assert len(late) <= redundant
                left = [d for d in left if x not in d[1]]
                credit[x] += len(gone)
                unique = sum(1 for d in docs if d[0] == part and d[1] == {x})
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(credit[key[1][key[2] - 1]])
    return out


def audited(docs, labels):
    rows = filter_audit.filter_audit(filter_audit.failures(docs, labels), list("ABCDE")).collect()
    return {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in rows}


def test_audit_is_that_of_its_sql(spark):
    assert difference(queries.op11_filter_audit(spark, SMALL), oracle(SMALL), queries.ORACLES["op11_filter_audit"]) is None


def test_audit_of_odd_rows(spark, docs):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "  \n\x0b", "en"), (4, long, None), (5, long, ""), (5, long, "en"), (None, long, "de"), (None, None, "de"),
        (6, "É $ " + long, "de"), (7, "ABC " * 300, "de"), (8, "a b " * 200_000, "de"), (9, "a b " * 200_000, "en"), (0, long.upper(), "de"),
    ]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, 0, 1), (9, None, 1), (None, 1, 1), (77, 1, 1)]
    df = docs(*rows).withColumn("part", F.lit("x")).withColumn("A", F.lit(1)).withColumn("words", F.lit(2)).withColumn("good", F.lit(True))
    marks = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("t")).withColumn("_first", F.lit(1))
    got = audited(df, marks)
    assert got == audit_by_hand(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 600 * 3
    assert audited(docs(), marks) == {}
    assert audited(docs((1, "a")), spark.createDataFrame([], LABELS))[("en", "ABCDE", 1)][:2] == [0, 1]


def test_contractions_are_those_of_random_tables():
    rng = np.random.default_rng(3)
    tensor = rng.integers(0, 50, (2, 3, 2, 2, 2))
    orders, current, sides = filter_audit.step_selectors(3)
    removed = filter_audit.contract(tensor, sides["removed"])
    for s in range(len(current)):
        order, step = orders[s // 3], s % 3
        want = sum(tensor[1, 2][cell] for cell in itertools.product((0, 1), repeat=3) if cell[order[step]] and not any(cell[f] for f in order[:step]))
        assert removed[1, 2, s] == want


def runs_by_hand(w):
    """All maximal stretches for every period, checked for a smaller one word by word."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_by_hand(doc, text, plant):
    w = split(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(kept))]
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_runs_are_those_of_brute_force(spark, given):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    want = {doc: row_by_hand(doc, text, True) for doc, text in given[1].items()}
    assert got == want
    assert sum(r[1] for r in want.values()) > 10


def test_runs_of_planted_repeats(docs):
    rng = random.Random(11)
    texts = {}
    for doc in range(160):
        w = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abAB" if doc % 2 else "abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 7, 8, 9, 16, 30, 31, 40, 62)))]
            w += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)] + [rng.choice("abxyz") for _ in range(rng.randrange(4))]
        texts[doc] = rng.choice((" ", "\n", " \t")).join(w)
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs(*texts.items())).collect()}
    for doc, text in texts.items():
        r = got[doc]
        assert tuple(r[c] for c in COLUMNS) == row_by_hand(doc, text, False)
        assert [tuple(x) for x in r.runs] == runs_by_hand(split(text)) and r.n_words == len(split(text))
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256


@pytest.mark.parametrize("letters", [2, 3, 50])
def test_extensions_are_those_of_a_plain_scan(letters):
    rng = np.random.default_rng(letters)
    words = rng.integers(1, letters, 1500).astype(np.uint64) * np.uint64(977)
    words[700:1200] = words[100:600]
    words[1210:1500] = words[1200:1490]
    i = rng.integers(0, 1490, 3000)
    j = rng.integers(0, 1499, 3000)
    i, j = np.minimum(i, j), np.maximum(i, j) + 1
    until = np.minimum(j + rng.integers(0, 800, 3000), 1500)
    got = periodic_runs.Extensions(words).right(i, j, until)
    for a, b, end, n in zip(i, j, until, got):
        k = 0
        while b + k < end and words[a + k] == words[b + k]:
            k += 1
        assert n == k


def test_runs_of_odd_rows(docs):
    long = "a " * 30_000 + "b " * 40 + " ".join(str(i) for i in range(20_000)) + " x y" * 9_000
    df = docs((1, None), (2, ""), (3, " \n"), (None, "q " * 24), (4, "q " * 23), (5, "Q q " * 12), (5, "Q q " * 12), (6, long), (7, "é ü " * 12))
    df = df.withColumn("runs", F.lit(1)).withColumn("start", F.lit("s"))
    rows = periodic_runs.periodic_runs(df, plant=True).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and [by[d].n_runs for d in (1, 2, 3, None, 4, 5, 6, 7)] == [0, 0, 0, 1, 0, 1, 3, 1]
    assert (by[1].runs_sha256, by[1].collapsed) == (hashlib.sha256(b"").hexdigest(), "")
    assert (by[None].start, by[None].length, by[None].period, by[None].collapsed) == (0, 24, 1, "q")
    assert (by[6].start, by[6].length, by[6].period) == (0, 30_000, 1) and by[7].collapsed == "é ü"
    assert [tuple(r) for r in by[6].runs] == [(0, 30_000, 1), (30_000, 40, 1), (50_040, 18_000, 2)]
    assert periodic_runs.periodic_runs(docs()).count() == 0
