"""Encoding, decoding and token attribution against the libraries themselves."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tieout.llm import sentence_pieces, token_counts

ODD = ["", " ", "   ", "  a", "a  b ", "\ta\nb", "ﬁ①é é", "É\xa0b", "日本𝔸", "a\x00b", "<s>", "<0x41>", " <unk>", "a" * 700, "the " * 300, "ab" * 400, " " * 90]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)


def test_pieces_are_those_of_the_library(docs, given, library):
    df, texts = given
    every = docs(*[(i, t) for i, t in enumerate([*texts.values(), *ODD])])
    rows = sentence_pieces.encode(every, decode=True, batch_chars=50_000, most_known=3_000).collect()
    assert len(rows) == len(texts) + len(ODD)
    for row in rows:
        assert row.piece_ids == library.encode(row.text)
        assert row.decoded == row.text


def test_space_mark_is_read_as_a_space(docs, library):
    row = sentence_pieces.encode(docs((1, "x▁y")), decode=True).first()
    assert row.piece_ids == library.encode("x▁y") and row.decoded == "x y"


def test_null_repeated_and_clashing_columns(docs, spark):
    df = docs((1, None), (None, "a b"), (None, "a b")).withColumn("piece_ids", F.lit("old")).withColumn("decoded", F.lit(1))
    rows = sentence_pieces.encode(df, decode=True).collect()
    assert sorted((r.piece_ids is None, r.decoded) for r in rows if r.text) == [(False, "a b")] * 2
    assert [r.piece_ids for r in rows if r.text is None] == [None]
    assert sentence_pieces.encode(docs()).count() == 0


def test_suffixes_and_occurrences():
    codes = np.array([2, 1, 2, 1, 2, 0, 1, 2, 0], np.int32)
    order = sentence_pieces.suffix_order(codes, 4)
    suffixes = [tuple(codes[i : i + 4]) for i in order]
    assert suffixes == sorted(suffixes)
    table = np.array([[1, 2, 0], [2, 1, 2], [1, 1, 0]])
    low, high = sentence_pieces.occurrences(codes, order, table, np.array([2, 3, 2]))
    assert [sorted(order[a:b].tolist()) for a, b in zip(low, high)] == [[1, 3, 6], [0, 2], []]


def test_suffix_order_of_a_large_alphabet():
    codes = np.random.default_rng(1).integers(0, 200_000, 5_000).astype(np.int32)
    codes[::3] = 7
    order = sentence_pieces.suffix_order(codes, 8)
    suffixes = [tuple(codes[i : i + 8]) for i in order]
    assert suffixes == sorted(suffixes)


def test_tokens_of_sections_add_up(given):
    df, texts = given
    import base64

    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for rule in token_counts.RULES:
        sums = token_counts.section_tokens(df, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("document_tokens").alias("all"), F.count("*").alias("sections"))
        for row in sums.collect():
            want = len(encoding.encode_ordinary(texts[row.doc_id]))
            assert row["all"] == want and row["n"] == pytest.approx(want)


@pytest.mark.parametrize("rule, want", [("start", [2, 1, 0]), ("most", [1, 2, 0]), ("share", [1 + 1 / 4, 1 + 2 / 4, 1 / 4])])
def test_rules_for_tokens_that_cross(rule, want):
    # tokens 0-3, 3-7, 7-9; sections 0-4, 4-6, 6-6.. the second token lies in all three
    ends, bounds = np.array([3, 7, 8]), np.array([0, 4, 6, 8])
    counts, crossing = token_counts.share_out(ends, bounds, rule)
    want = {"start": [2, 0, 1], "most": [1, 1, 1], "share": [1.25, 0.5, 1.25]}[rule]
    assert counts.tolist() == pytest.approx(want) and crossing.tolist() == [1, 1, 1]


def test_sections_of_odd_texts(docs):
    rows = token_counts.section_tokens(docs((1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (None, "\n"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.section, r.begin_byte, r.end_byte))
    assert by[1] == [(0, None, None)] and by[2] == [(0, 0, 0)] and by[None] == [(0, 0, 1)]
    assert sorted(by[3]) == sorted([(0, 0, 2), (1, 2, 3), (2, 3, 4)] * 2)
    assert token_counts.section_tokens(docs()).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs(), rule="other")


def test_workers_keep_tables_only_for_runs_that_keep():
    from tieout.llm.common import in_worker, kept

    made = []

    def make(name):
        made.append(name)
        return name

    keeping = in_worker(lambda batches: (kept(make, "a") + b for b in batches), keeps=True)
    assert list(keeping(iter("xy"))) == ["ax", "ay"] and list(keeping(iter("z"))) == ["az"]
    assert made == ["a"]
    assert list(in_worker(lambda batches: iter(batches))(iter([]))) == []
    assert list(keeping(iter("x"))) == ["ax"] and made == ["a", "a"]


def test_chunks_are_met_once_and_pairs_are_not_searched_again(monkeypatch):
    names, every, ends = sentence_pieces._chunks(pa.array(["a b", None, "", "  b a ", "▁a", " "]))
    assert [[names[i] for i in every[a:b]] for a, b in zip(ends[:-1], ends[1:])] == [["▁a", "▁b"], [], [], ["▁▁▁b", "▁a", "▁"], ["▁▁a"], ["▁▁"]]
    assert len(set(names)) == len(names)
    with open(sentence_pieces.MODEL, "rb") as file:
        vocabulary = sentence_pieces.Vocabulary(file.read())
    asked, search = [], vocabulary._fit_some
    monkeypatch.setattr(vocabulary, "_fit_some", lambda pairs: asked.extend(pairs.tolist()) or search(pairs))
    ids, sizes = sentence_pieces.encode_chunks(["▁the", "▁thesis", "▁the"], vocabulary)
    assert asked and len(set(asked)) < 200
    once = len(asked)
    again = sentence_pieces.encode_chunks(["▁the", "▁thesis", "▁the"], vocabulary)
    assert len(asked) == once and (again[0] == ids).all() and (again[1] == sizes).all()
