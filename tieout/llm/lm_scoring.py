"""Log probabilities of texts under a bigram model with deleted interpolation.

Counts are exact over all training documents. Tokens are grouped into blocks of documents; a block sends every part of
the key space the sorted distinct keys it has, with their counts, and gets the corpus totals of those keys back. A
frequent word is therefore one entry per block, never one per occurrence, and neither the vocabulary nor the bigrams
are ever held by one task or the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tieout.llm.common import fold_of, in_worker, pin
from tieout.llm.words import ODD, Words, mix, text_slices

BLOCK_TOKENS = 1_000_000
PART_KEYS = 2_000_000
TUNE_FOLD = 2
HELD_OUT_FOLD = 1
BUCKETS = 24
ROUNDS = 60
_END = np.uint64(0xD1B54A32D192ED03)
_CELL = 20  # steps per decade when probabilities are grouped to learn the weights

BLOCK = "block long, kind int, doc_ids array<long>, missing array<boolean>, lengths array<long>, vocabulary binary, tokens binary, n_tokens long"
MESSAGE = "part int, block long, keys binary, fitted binary, tuned binary"
REPLY = "block long, part int, totals binary, tuned binary, fitted_tokens long, tuned_tokens long, types long"


def packed(values: np.ndarray) -> bytes:
    """Sorted keys or small counts with like bytes side by side, compressed."""
    columns = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(columns.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _rises(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of one kind (0 fit, 1 tune, 2 held out) in blocks of about ``most`` tokens; a text is never parted."""

    def run(batches):
        waiting, sizes, number = {0: [], 1: [], 2: []}, [0, 0, 0], 0
        for batch in batches:
            ids, done = batch.column("doc_id").to_pylist(), 0
            for first, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                for row in range(end - first):
                    fold = fold_of(ids[done + row])
                    kind = 2 if fold == HELD_OUT_FOLD else int(fold == TUNE_FOLD)
                    tokens = np.append(words.of(row), _END)
                    waiting[kind].append((ids[done + row], tokens))
                    sizes[kind] += len(tokens)
                    if sizes[kind] >= most:
                        yield block(waiting[kind], kind, number)
                        waiting[kind], sizes[kind], number = [], 0, number + 1
                done += end - first
        for kind, rows in waiting.items():
            if rows:
                yield block(rows, kind, number)
                number += 1

    def block(rows, kind, number):
        vocabulary, local = np.unique(np.concatenate([t for _, t in rows]), return_inverse=True)
        values = {
            "block": (TaskContext.get().partitionId() << 32) + number, "kind": kind, "doc_ids": [i or 0 for i, _ in rows],
            "missing": [i is None for i, _ in rows], "lengths": [len(t) for _, t in rows],
            "vocabulary": _rises(vocabulary), "tokens": packed(local.astype(np.uint32)), "n_tokens": len(local),
        }
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values.values(), kinds)], names=list(values))

    return docs.select("doc_id", "text").mapInArrow(in_worker(run), BLOCK)


def _keys(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigram keys, the place of every token's bigram among them, and the vocabulary place of its context.

    The first word of a text has the end of a text as its context.
    """
    ends = np.cumsum(lengths)
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[np.append(0, ends[:-1])] = tokens[ends[-1] - 1]
    pairs, place = np.unique(context * len(vocabulary) + tokens, return_inverse=True)
    keys = mix(vocabulary[pairs // len(vocabulary)] * ODD[0] + vocabulary[pairs % len(vocabulary)] * ODD[1])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return keys[order], rank[place], context


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _sums(row["vocabulary"]), unpacked(row["tokens"], np.uint32).astype(np.int64), np.asarray(row["lengths"], np.int64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def messages(found: DataFrame, parts: int) -> DataFrame:
    """What each block tells each part: even parts hold words, odd parts bigrams."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, lengths = _read(row)
                bigrams, place, _ = _keys(vocabulary, tokens, lengths)
                for odd, keys, at in ((0, vocabulary, tokens), (1, bigrams, place)):
                    counts = np.bincount(at, minlength=len(keys)).astype(np.uint32)
                    nothing = np.zeros(len(keys), np.uint32)
                    fitted, tuned = counts if row["kind"] == 0 else nothing, counts if row["kind"] == 1 else nothing
                    owners = _part(keys, parts)
                    cuts = np.append(np.flatnonzero(np.diff(owners, prepend=owners[:1] + np.uint64(1))), len(keys))
                    out = [(int(owners[a]) * 2 + odd, row["block"], _rises(keys[a:b]), packed(fitted[a:b]), packed(tuned[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "fitted", "tuned"])

    return found.select("block", "kind", "vocabulary", "tokens", "lengths").mapInArrow(in_worker(run), MESSAGE)


def _replies(sent: DataFrame) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        keys = [_sums(k) for k in group["keys"]]
        sizes = np.cumsum([len(k) for k in keys])[:-1]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        fitted, tuned = (np.bincount(place, np.concatenate([unpacked(c, np.uint32) for c in group[name]]), len(distinct)).astype(np.int64) for name in ("fitted", "tuned"))
        out = pd.DataFrame({"block": group["block"].to_numpy(), "part": group["part"].to_numpy()})
        out["totals"] = [packed((fitted + tuned)[p].astype(np.uint64)) for p in np.split(place, sizes)]
        out["tuned"] = [packed(tuned[p].astype(np.uint64)) for p in np.split(place, sizes)]
        for name, value in (("fitted_tokens", fitted.sum()), ("tuned_tokens", tuned.sum()), ("types", (fitted + tuned > 0).sum())):
            out[name] = 0
            out.loc[0, name] = int(value)
        return out

    return sent.groupBy("part").applyInPandas(run, REPLY)


def _bucket(count: np.ndarray) -> np.ndarray:
    """Context frequencies in powers of two; 0 for a context that was never seen."""
    return np.minimum(np.ceil(np.log2(count + 1.0)).astype(np.int64), BUCKETS - 1)


def _chances(row, replies: pd.DataFrame, tokens_all: int, types: int, without_tuned: bool):
    """Relative frequencies of every token: as a word, after its context; and the context's bucket and the word counts."""
    vocabulary, tokens, lengths = _read(row)
    _, place, context = _keys(vocabulary, tokens, lengths)
    replies = replies.sort_values("part")
    totals = []
    for odd in (0, 1):
        own = replies[replies["part"] % 2 == odd]
        count = np.concatenate([unpacked(t, np.uint64).astype(np.int64) for t in own["totals"]])
        if without_tuned:
            count = count - np.concatenate([unpacked(t, np.uint64).astype(np.int64) for t in own["tuned"]])
        totals.append(count)
    words, after = totals[0][tokens], totals[1][place]
    before = totals[0][context]
    return words / max(tokens_all, 1), after / np.maximum(before, 1), _bucket(before), words, lengths


def _weights(cells: pd.DataFrame, types: int) -> np.ndarray:
    """(bucket, [uniform, word, bigram]) by expectation-maximisation over grouped held-out counts."""
    weights = np.tile([0.05, 0.45, 0.5], (BUCKETS, 1))
    weights[0] = [0.1, 0.9, 0.0]
    for bucket, own in cells.groupby("bucket"):
        chance = np.column_stack([np.full(len(own), 1.0 / (types + 1)), _value(own["word"].to_numpy()), _value(own["bigram"].to_numpy())])
        seen, current = own["n"].to_numpy(dtype=float), weights[bucket]
        for _ in range(ROUNDS):
            share = chance * current
            share /= share.sum(axis=1, keepdims=True)
            current = (share * seen[:, None]).sum(axis=0) + np.array([0.01, 0.01, 0.01 if bucket else 0.0])
            current /= current.sum()
        weights[bucket] = current
    return weights


def _grouped(chance: np.ndarray) -> np.ndarray:
    return np.where(chance > 0, np.round(-np.log10(np.maximum(chance, 1e-30)) * _CELL), -1).astype(np.int64)


def _value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell < 0, 0.0, 10.0 ** (-cell / _CELL))


def lm_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``.

    Tokens are the words of a text (A-Z lower-cased, split on ASCII white space) and one end. Training documents are
    those whose crc32(doc_id) % 5 is not ``HELD_OUT_FOLD``. The score adds up log10 of
    w0 / (V + 1) + w1 * c(word) / N + w2 * c(context word) / c(context); the weights depend on the frequency bucket of
    the context and are learned by expectation-maximisation on the training documents of ``TUNE_FOLD`` with the counts of
    the other training documents. The final counts are those of all training documents. base_score is the smoothed word
    model log10((c + 0.5) / (N + 0.5 * (V + 1))).

    For the learning step equal probabilities (to 1/20 of a decade) are grouped, so its table has a size that does not
    depend on the corpus. Null or empty text: the end alone. Null doc_id: trained on, as its crc32 is 0. Repeated rows
    count as often as they occur. Without training documents N and V are 0. Empty input: no rows.
    """
    found = pin(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_tokens))
    tokens = found.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-tokens // part_keys))
    replies = pin(_replies(messages(found, parts)))
    odd = F.col("part") % 2
    sums = replies.groupBy(odd.alias("odd")).agg(*[F.sum(c).alias(c) for c in ("fitted_tokens", "tuned_tokens", "types")]).where("odd = 0").first()
    fitted, tuned, types = (sums["fitted_tokens"], sums["tuned_tokens"], sums["types"]) if sums else (0, 0, 0)

    def cells(key, block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"bucket": [], "word": [], "bigram": [], "n": []})
        word, bigram, bucket, _, _ = _chances(block.iloc[0], reply, fitted, types, True)
        out = pd.DataFrame({"bucket": bucket, "word": _grouped(word), "bigram": _grouped(bigram)})
        return out.value_counts().rename("n").reset_index()

    of_tune = found.where("kind = 1").drop("doc_ids", "missing")
    tune_replies = replies.join(of_tune.select(F.col("block").alias("_block")), F.col("block") == F.col("_block"), "left_semi")
    grouped = of_tune.groupBy("block").cogroup(tune_replies.groupBy("block")).applyInPandas(cells, "bucket long, word long, bigram long, n long")
    weights = _weights(grouped.groupBy("bucket", "word", "bigram").agg(F.sum("n").alias("n")).toPandas(), types)

    def scores(key, block: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        word, bigram, bucket, count, lengths = _chances(row, reply, fitted + tuned, types, False)
        w = weights[bucket]
        value = np.log10(np.maximum(w[:, 0] / (types + 1) + w[:, 1] * word + w[:, 2] * bigram, 1e-300))
        base = np.log10((count + 0.5) / (fitted + tuned + 0.5 * (types + 1)))
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)
        ids = pd.arrays.IntegerArray(np.array(row["doc_ids"], np.int64), np.array(row["missing"], bool))
        return pd.DataFrame({
            "doc_id": ids, "held_out": bool(row["kind"] == 2), "n_tokens": lengths, "n_known": add((count > 0).astype(np.int64)),
            "train_tokens": fitted + tuned, "base_score": add(base), "score": add(value),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answered = replies.select("block", "part", "totals")
    return found.drop("n_tokens").groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(scores, schema)
