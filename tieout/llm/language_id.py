"""Language of a text by prediction by partial matching: one byte context tree per language, frozen after training."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.llm.common import fold, free, in_worker, small_side
from tieout.llm.words import text_slices

ORDER = 3
TRAIN_DOCS = 300  # per language; the only bound on what is learned from
TRAIN_BYTES = 20_000  # of a longer text, so many bytes are learned from
SEGMENTS = 20  # parts of a longer text, spread evenly from its start to its end
TEST_FOLD = 0
LANE = 512
SLICE_BYTES = 1_500_000
STEPS = 1024  # steps of a bit in the table of code lengths
UNDEFINED = "und"


def training_rows(docs: DataFrame, most: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> DataFrame:
    """(lang, text): at most ``most`` texts per language, those with the smallest hash of their id.

    Texts of up to ``longest`` bytes are whole; a longer one is as many bytes in segments spread over all of it.
    Documents are counted first; with that number all but a few times as many hashes as wanted are cut where the rows
    are read, so a language with most of the rows sends no more than the others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.where(fold(F.col("doc_id")) != TEST_FOLD).where("lang IS NOT NULL AND text IS NOT NULL").where(F.length(text) > 0)
    keyed = known.select("lang", "text", F.xxhash64("doc_id", F.lit(9)).alias("h"))
    counts = small_side(known.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("n")))
    share = F.col("h").bitwiseAND(F.lit(2**63 - 1)) / F.lit(2.0**63)
    near = keyed.join(counts, F.col("lang") == F.col("_lang")).where(share * F.col("n") < 4.0 * most + 100)
    near = near.withColumn("text", F.when(F.octet_length("text") <= longest, F.col("text")).otherwise(_segments(F.col("text"), longest)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(share, "h", "text"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def _segments(text: Column, size: int) -> Column:
    """About ``size`` bytes of a text that has more, in equal segments on lines of their own."""
    n = F.char_length(text)
    each = F.greatest(F.floor(size / SEGMENTS * n / F.octet_length(text)), F.lit(1)).cast("int")
    return F.concat_ws("\n", *[F.substring(text, (F.floor((n - each) * i / (SEGMENTS - 1)) + 1).cast("int"), each) for i in range(SEGMENTS)])


def context_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often a byte (the last of ``gram``) follows the bytes before it, for contexts of 0 to ``order`` bytes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        grams, counts = [], []
        data = b"\n".join(t.encode() for t in group["text"]) + b"\n"
        codes = np.frombuffer(b"\n" * order + data, np.uint8).astype(np.uint64)
        for length in range(1, order + 2):
            key = np.zeros(len(data), np.uint64)
            for i in range(length):
                key = key << np.uint64(8) | codes[order + 1 - length + i : order + 1 - length + i + len(data)]
            found, n = np.unique(key, return_counts=True)
            grams += [int(k).to_bytes(length, "big") for k in found]
            counts += n.tolist()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "gram": grams, "n": counts})

    return rows.groupBy("lang").applyInPandas(run, "lang string, gram binary, n long")


class Model:
    """Code lengths in bits of every byte class in every context, and the context that follows.

    A context that a language has seen predicts its bytes by their counts and escapes with probability
    distinct / (total + distinct) to the context without its first byte, whose prediction is spread over the bytes that
    were not seen here; below the empty context all bytes are alike. So the probabilities of all bytes add up to one in
    every context. Contexts are numbered, and reading a byte leads from one number to the next.
    """

    def __init__(self, counts: list[tuple[str, bytes, int]], order: int):
        self.languages = sorted({c[0] for c in counts})
        seen = sorted({b for _, g, _ in counts for b in g} | {10})
        self.classes = np.full(256, len(seen), np.int32)
        self.classes[seen] = np.arange(len(seen), dtype=np.int32)
        width = len(seen) + 1  # the last class: any byte that was never seen
        rest = 256 - len(seen)
        trees: dict[str, dict[bytes, dict[int, int]]] = {x: {} for x in self.languages}
        for lang, gram, n in counts:
            trees[lang].setdefault(gram[:-1], {})[int(self.classes[gram[-1]])] = n
        contexts = sorted({c for tree in trees.values() for c in tree} | {b""}, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(contexts)}
        chance = np.zeros((len(contexts), len(self.languages), width), np.float32)
        for j, lang in enumerate(self.languages):
            tree = trees[lang]
            for i, context in enumerate(contexts):
                if context:
                    lower = chance[number[context[1:]], j]
                else:
                    lower = np.full(width, 1 / 256)
                    lower[-1] = rest / 256
                found = tree.get(context)
                if not found:
                    chance[i, j] = lower
                    continue
                at, n = np.fromiter(found, np.int64), np.array(list(found.values()), float)
                escape = len(at) / (n.sum() + len(at))
                own = lower.copy()
                own[at] = 0
                if own.sum() > 0:
                    own *= escape / own.sum()
                    own[at] = n / (n.sum() + len(at))
                else:
                    own[at] = n / n.sum()
                chance[i, j] = own
        chance[:, :, -1] /= max(rest, 1)  # one byte of that class
        np.log2(np.maximum(chance, 1e-9, out=chance), out=chance)
        chance *= -STEPS
        self.bits = np.round(chance).astype(np.int16).transpose(0, 2, 1).reshape(len(contexts) * width, -1)
        self.next = np.zeros(len(contexts) * width, np.int32)
        for i, context in enumerate(contexts):
            for k, byte in enumerate([*seen, None]):
                after = b"" if byte is None else (context + bytes([byte]))[-order:] if order else b""
                while after not in number:
                    after = after[1:]
                self.next[i * width + k] = number[after] * width
        start = b"\n" * order
        while start not in number:
            start = start[1:]
        self.start, self.order, self.width = number[start] * width, order, width

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text under every language. Texts are read in lanes side by side; a lane first reads the bytes before it."""
        sizes = np.diff(offsets)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        begin = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        end = np.minimum(begin + LANE, offsets[1:][text])
        first = np.maximum(begin - self.order, offsets[:-1][text])
        order = np.argsort(-(end - first), kind="stable")  # lanes that end early are the last ones
        begin, end, first, text = begin[order], end[order], first[order], text[order]
        length = end - first
        classes, state = self.classes[data], np.full(len(text), self.start, np.int64)
        state[first > offsets[:-1][text]] = 0
        total = np.zeros((len(text), len(self.languages)), np.int64)
        active = len(text)
        for step in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= step:
                active -= 1
            at = first[:active] + step
            cell = state[:active] + classes[at]
            counted = at >= begin[:active]
            if step < self.order and not counted.all():
                total[:active][counted] += self.bits[cell[counted]]
            else:
                total[:active] += self.bits[cell]
            state[:active] = self.next[cell]
        out = np.zeros((len(sizes), len(self.languages)))
        np.add.at(out, text, total / STEPS)
        return out


@lru_cache(maxsize=1)
def _has_letters_table() -> np.ndarray:
    return np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any alphabet."""
    ascii_ = np.append(0, np.cumsum(_has_letters_table()[data]))
    has = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
        text = bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace")
        has[i] = any(c.isalpha() for c in text)
    return has


def fit(docs: DataFrame, order: int = ORDER, most: int = TRAIN_DOCS, longest: int = TRAIN_BYTES) -> Model | None:
    """Model of all languages that have a training document; None if there is none. Its size is bounded by the sample."""
    counts = context_counts(training_rows(docs, most, longest), order).collect()
    return Model([(r.lang, bytes(r.gram), r.n) for r in counts], order) if counts else None


def predict(docs: DataFrame, model: Model | None, untold: str = UNDEFINED) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced).

    lang_pred is the language with the shortest code; the first by name if several are equal. score is its share when
    each language has the weight 2 ** -(bits per 32 bytes), so it is 1 / number of languages where all are alike. Null
    text or a text without letters: ``und`` with score 0. No model: ``untold`` with score 0 for texts with letters. Whole texts are read. Empty input: no rows.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for first, end, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
                has = _letters(data, offsets)
                if model is None:
                    names += [untold if h else UNDEFINED for h in has.tolist()]
                    scores += [0.0] * len(has)
                    continue
                bits = model.code_lengths(data, offsets)
                best = bits.argmin(axis=1)
                rate = (bits - bits.min(axis=1, keepdims=True)) * (32 / np.maximum(np.diff(offsets), 32))[:, None]
                share = 1 / np.exp2(-rate).sum(axis=1)
                names += [model.languages[b] if h else UNDEFINED for b, h in zip(best.tolist(), has.tolist())]
                scores += np.where(has, share, 0.0).tolist()
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in [*kept.dtypes, ("lang_pred", "string"), ("score", "double")])
    return kept.mapInArrow(in_worker(run), schema)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from text and lang of the documents outside the test fold."""
    model = fit(docs)
    return predict(docs.select("doc_id", "text", (fold(F.col("doc_id")) == TEST_FOLD).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose text is null or has no letter, also if there is nothing to learn from; columns unchanged."""
    held = {c: free(docs, f"{c}_held") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    known = predict(docs.withColumnsRenamed(held), fit(docs), untold="").where(F.col("lang_pred") != UNDEFINED)
    return known.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in held.items()})
