"""Tokens of documents shared out to their sections by the offsets of one encoding of the whole text."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tieout.llm.common import in_worker

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most", "share")
SCHEMA = "doc_id long, section int, begin_byte long, end_byte long, n_tokens double, n_crossing long, document_tokens long"


@lru_cache(maxsize=2)
def _encoding(name: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def line_sections(data: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin, and its end; a line has its line break."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], breaks, [len(data)]]))


def share_out(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every section, and how many of its tokens go across one of its ends.

    Tokens lie side by side and end at ``token_ends``; sections lie between ``bounds``. A token inside a section counts
    there. A token that goes across goes by ``rule``: ``start`` to the section of its first byte, ``most`` to the one with
    most of its bytes (the first of several), ``share`` to all of them by their part of its bytes.
    """
    begins = np.append(0, token_ends[:-1])
    first = np.searchsorted(bounds, begins, "right") - 1
    last = np.searchsorted(bounds, token_ends, "left") - 1
    sections = len(bounds) - 1
    inside = first == last
    counts = np.bincount(first[inside], minlength=sections).astype(float)
    crossing = np.zeros(sections, np.int64)
    across = np.flatnonzero(~inside)
    parts = last[across] - first[across] + 1
    token = np.repeat(across, parts)
    section = np.arange(len(token)) - np.repeat(np.cumsum(parts) - parts, parts) + first[token]
    held = np.minimum(token_ends[token], bounds[section + 1]) - np.maximum(begins[token], bounds[section])
    np.add.at(crossing, section, 1)
    if rule == "share":
        np.add.at(counts, section, held / (token_ends[token] - begins[token]))
    elif rule == "start":
        np.add.at(counts, first[across], 1.0)
    else:
        order = np.lexsort((section, -held, token))
        chosen = order[np.append(True, np.diff(token[order]) != 0)] if len(order) else order
        np.add.at(counts, section[chosen], 1.0)
    return counts, crossing


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", sections=line_sections) -> DataFrame:
    """One row per section of every document: its byte span, its tokens by ``rule``, and how many go across its ends.

    A text is encoded once and whole; byte-level tokens lie side by side, so their lengths give their spans, and both
    span lists are joined as intervals in one pass. ``sections`` gives the bounds of the sections of a text (lines by
    default). The tokens of all sections of a document add up to its tokens under every rule. Null text: one section
    with null span and no tokens; empty text: one empty section. Repeated rows give repeated sections. Empty input: no rows.
    ``vocabulary`` is a path that the driver can read; executors get the file from Spark.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches):
        encoding, sizes = _encoding(name)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        names = SCHEMA.replace(",", "").split()[::2]
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    out.append(([doc_id], [0], [None if text is None else 0], [None if text is None else 0], [0.0], [0], [0]))
                    continue
                data = text.encode()
                bounds = sections(data)
                ends = np.cumsum(sizes[encoding.encode_ordinary(text)])
                counts, crossing = share_out(ends, bounds, rule)
                n = len(counts)
                out.append(([doc_id] * n, range(n), bounds[:-1].tolist(), bounds[1:].tolist(), counts.tolist(), crossing.tolist(), [len(ends)] * n))
                held += n
                if held >= 50_000:
                    yield table(out, kinds, names)
                    out, held = [], 0
            if out:
                yield table(out, kinds, names)

    def table(out, kinds, names):
        return pa.RecordBatch.from_arrays([pa.array([x for row in out for x in row[i]], kind) for i, kind in enumerate(kinds)], names=names)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(in_worker(run), SCHEMA)
