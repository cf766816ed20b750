"""Encoding with a public SentencePiece BPE vocabulary by suffix-array matching, and decoding.

A batch of texts is parted at word beginnings (no piece of the vocabulary goes across one) and its distinct chunks are
written into one index text. Every piece is looked up in the sorted suffixes of that text by binary search, which gives
all places where it occurs. These edges are sorted by position and relaxed from left to right: the encoding of a prefix
that ends in a piece is the encoding of the shorter prefix and that piece, if and only if the pair of its last two pieces
is what the merges make of their joined text. So every position keeps one edge, and the result is that of the merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkFiles
from pyspark.sql import DataFrame, types as T

from tieout.llm.common import in_worker, kept
from tieout.llm.words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_CHARS = 2_000_000
KNOWN_CHUNKS = 700_000  # encoded chunks that a worker keeps for its next batches; it starts anew beyond them
MARK = "▁"
CHARACTER = 1 << 24  # a character that is no piece has this number and more
BEGIN = 1 << 26  # stands before the first piece of a chunk
RECENT = 20  # binary logarithm of the number of pairs that are looked up in one step


class Vocabulary:
    """Pieces of a model file, and which of them may stand side by side."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        count = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(count)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(count)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
        self.unknown = model.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this vocabulary goes across word beginnings")
        if model.decode(model.encode(" ﬁ  x ")) != " ﬁ  x ":
            raise ValueError("this vocabulary changes texts before it parts them")
        self.length = max(map(len, self.ids))
        self.as_bytes = [b"" if special[i] else p.encode() for i, p in enumerate(self.pieces)]
        for value, i in enumerate(self.bytes.tolist()):
            if i >= 0:
                self.as_bytes[i] = bytes([value])
        spaced = [b.replace(MARK.encode(), b" ") for b in self.as_bytes]
        self.byte_sizes = np.array([len(b) for b in spaced], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_pool = np.frombuffer(b"".join(spaced), np.uint8)
        long = [(p, i) for p, i in sorted(self.ids.items()) if len(p) > 1]
        self.long_ids, self.long_sizes = np.array([i for _, i in long], np.int64), np.array([len(p) for p, _ in long], np.int64)
        self.long_points = np.zeros((len(long), self.length), np.uint32)
        self.long_points[np.arange(self.length) < self.long_sizes[:, None]] = _points("".join(p for p, _ in long))
        self._pairs, self._fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self._recent, self._recent_fits = np.full(1 << RECENT, -1, np.int64), np.zeros(1 << RECENT, bool)

    def name(self, piece: str) -> int:
        """Id of a piece, or a number for a character that is none."""
        return self.ids[piece] if piece in self.ids else CHARACTER + ord(piece)

    def _text(self, name: int) -> str:
        return "" if name == BEGIN else self.pieces[name] if name < CHARACTER else chr(name - CHARACTER)

    def merged(self, text: str) -> list[str]:
        """Merge the best neighbouring pair (highest score, then leftmost) until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit_all(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the merges make exactly these two pieces of their joined text; pairs once seen are kept.

        A table by the hash of the pair knows most of them at once, the others are found among all pairs seen.
        """
        pairs = (before << 32) | piece
        place = (mix(pairs.view(np.uint64)) >> np.uint64(64 - RECENT)).view(np.int64)
        out = self._recent_fits[place]
        late = np.flatnonzero(self._recent[place] != pairs)
        if len(late):
            asked, which = np.unique(pairs[late], return_inverse=True)
            fits = self._fit_some(asked)
            out[late] = fits[which]
            place = place[late]
            self._recent[place] = pairs[late]
            self._recent_fits[place] = out[late]  # of pairs with one place the last in both
        return out

    def _fit_some(self, pairs: np.ndarray) -> np.ndarray:
        """The same for sorted different pairs."""
        at = np.searchsorted(self._pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self._pairs)
        known[inside] = self._pairs[at[inside]] == pairs[inside]
        out = np.zeros(len(pairs), bool)
        out[known] = self._fits[at[known]]
        new = np.flatnonzero(~known & (pairs >= 0))
        for i, pair in zip(new.tolist(), pairs[new].tolist()):
            left, right = self._text(pair >> 32), self._text(pair & 0xFFFFFFFF)
            out[i] = self.merged(left + right) == ([left, right] if left else [right])
        if len(new):
            self._pairs, self._fits = np.insert(self._pairs, at[new], pairs[new]), np.insert(self._fits, at[new], out[new])
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def suffix_order(codes: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first ``length`` or more symbols, by prefix doubling from as many as fit a long."""
    bits = max(int(codes.max()).bit_length(), 1)
    width = min(62 // bits, length)
    rank, later = np.zeros(len(codes), np.int64), codes.astype(np.int64)
    for _ in range(width):
        rank = (rank << bits) | later
        later = np.append(later[1:], 0)
    while width < length:
        _, rank = np.unique(rank, return_inverse=True)
        after = np.zeros_like(rank)
        after[: len(rank) - width] = rank[width:] + 1
        rank = rank * (int(rank.max()) + 2) + after
        width *= 2
    return np.argsort(rank)


def occurrences(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of ``order`` whose suffixes begin with it: all pieces are searched at once."""
    padded = np.append(codes, np.zeros(pieces.shape[1], codes.dtype))
    found = []
    for strict in (False, True):
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
        while (low < high).any():
            open_ = low < high
            middle = (low + high) // 2
            start = order[np.minimum(middle, len(order) - 1)]
            side, same = np.zeros(len(pieces), np.int8), open_.copy()
            for k in range(pieces.shape[1]):
                same &= lengths > k
                if not same.any():
                    break
                at = np.flatnonzero(same)
                there, wanted = padded[start[at] + k], pieces[at, k]
                side[at] = np.sign(there.astype(np.int64) - wanted)
                same[at] = side[at] == 0
            right = open_ & ((side < 0) | ((side == 0) & strict))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        found.append(low)
    return found[0], found[1]


def encode_chunks(chunks: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after another, and how many each has."""
    points = _points("\0".join(chunks) + "\0")
    place = np.zeros(0x110000, np.int32)
    place[points] = 1
    alphabet = np.flatnonzero(place)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    codes = place[points]
    bounds = np.cumsum([0] + [len(c) + 1 for c in chunks])
    codes[bounds[1:] - 1] = 0
    order = suffix_order(codes, vocabulary.length)
    table = place[vocabulary.long_points]
    table[np.arange(vocabulary.length) >= vocabulary.long_sizes[:, None]] = -1
    here = np.flatnonzero((table != 0).all(axis=1))
    single = np.flatnonzero(codes)  # every character is an edge: a piece of its own, or bytes
    names = np.array([vocabulary.name(chr(p)) for p in alphabet.tolist()], np.int64)
    start, end, piece = [single], [single + 1], [names[codes[single] - 1]]
    if len(here):
        lengths = vocabulary.long_sizes[here]
        low, high = occurrences(codes, order, table[here], lengths)
        counts = high - low
        which = np.repeat(np.arange(len(here)), counts)
        found = order[np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        start.append(found)
        end.append(found + lengths[which])
        piece.append(vocabulary.long_ids[here][which])
    start, end, piece = np.concatenate(start), np.concatenate(end), np.concatenate(piece)
    del order
    # Edges by the distance of their end from the beginning of their chunk: one step relaxes all chunks at once.
    distance = end - np.repeat(bounds[:-1], np.diff(bounds))[start]
    ranked = np.argsort(distance.astype(np.uint16 if distance.max() < 1 << 16 else np.int32), kind="stable")
    start, end, piece = start[ranked], end[ranked], piece[ranked]
    steps = np.append(0, np.cumsum(np.bincount(distance, minlength=1)))
    del distance, ranked
    last, before = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
    last[bounds[:-1]] = BEGIN
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        if a < b:
            ahead = last[start[a:b]]
            good = vocabulary.fit_all(ahead, piece[a:b]) & (ahead >= 0)
            last[end[a:b][good]], before[end[a:b][good]] = piece[a:b][good], start[a:b][good]
    # Follow the edges back from the end of every chunk.
    at, owner, path, owners = bounds[1:] - 1, np.arange(len(chunks)), [], []
    first = bounds[:-1]
    while len(at):
        path.append(last[at])
        owners.append(owner)
        at = before[at]
        more = at > first[owner]
        at, owner = at[more], owner[more]
    path, owners = np.concatenate(path[::-1]), np.concatenate(owners[::-1])
    path = path[np.argsort(owners, kind="stable")].astype(np.int32)
    sizes = np.bincount(owners, minlength=len(chunks))
    if path.max() < CHARACTER:
        return path, sizes
    owners = np.sort(owners)
    for character in np.unique(path[path >= CHARACTER]).tolist():  # in place of the character its bytes
        found, at = np.array(_as_bytes(chr(character - CHARACTER), vocabulary), np.int32), np.flatnonzero(path == character)
        path[at] = found[0]
        path = np.insert(path, np.repeat(at + 1, len(found) - 1), np.tile(found[1:], len(at)))
        owners = np.insert(owners, np.repeat(at + 1, len(found) - 1), np.repeat(owners[at], len(found) - 1))
    return path, np.bincount(owners, minlength=len(chunks))


class Encoded:
    """Ids of chunks that were met, one after another in one array."""

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.vocabulary, self.most = vocabulary, most
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text begins and ends in them; a null text has none."""
        distinct, every, counts = _chunks(texts)
        new = [c for c in distinct if c not in self.place]
        if len(self.place) + len(new) > self.most:
            self.clear()
            new = distinct
        if new:
            ids, sizes = encode_chunks(new, self.vocabulary)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.ids = np.append(self.ids, ids)
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        which = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[every]
        sizes = self.starts[which + 1] - self.starts[which]
        ends = np.append(0, np.cumsum(sizes))
        flat = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[which] - ends[:-1], sizes)]
        return flat, ends[counts]


def _as_bytes(character: str, vocabulary: Vocabulary) -> list[int]:
    found = [int(vocabulary.bytes[b]) for b in character.encode()]
    return found if min(found) >= 0 else [vocabulary.unknown]


def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different chunks of texts, the number of each chunk in order, and where each text begins and ends in them.

    A chunk is a word with all spaces before it, one more at the beginning of a text; spaces at its end are one, too.
    """
    parted = pa.compute.split_pattern(pa.compute.replace_substring(pa.compute.fill_null(texts, ""), MARK, " "), " ")
    words, counts = parted.flatten(), pa.compute.list_value_length(parted).to_numpy()
    last = np.zeros(len(words), bool)
    last[np.cumsum(counts) - 1] = True
    text = np.repeat(np.arange(len(counts)), counts)
    empty = pa.compute.equal(pa.compute.binary_length(words), 0).to_numpy(zero_copy_only=False)
    some = ~pa.compute.equal(pa.compute.binary_length(pa.compute.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero((~empty | last) & some[text])
    before = np.diff(at, prepend=-1) - 1  # empty words before: spaces beyond one
    first = np.append(True, text[at][1:] != text[at][:-1]) if len(at) else np.zeros(0, bool)
    before[first] = at[first] - (np.cumsum(counts) - counts)[text[at[first]]]
    coded = words.take(pa.array(at)).dictionary_encode()
    every, names = coded.indices.to_numpy().astype(np.int64), [MARK + w for w in coded.dictionary.to_pylist()]
    more = np.flatnonzero(before)
    if len(more):
        kinds, which = np.unique(np.stack([every[more], before[more]]), axis=1, return_inverse=True)
        every[more] = len(names) + which.ravel()
        names += [MARK * n + names[word] for word, n in kinds.T.tolist()]
        used, every = np.unique(every, return_inverse=True)
        names = [names[i] for i in used.tolist()]
    return names, every, np.append(0, np.cumsum(np.bincount(text[at], minlength=len(counts))))


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """Text of ids; the space that encoding puts before a text is taken off again."""
    text = b"".join(map(vocabulary.as_bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def decode_all(flat: np.ndarray, ends: np.ndarray, missing: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """Texts of many rows of ids at once, for ids that encoding has given: bytes of all pieces, without each first space."""
    sizes = vocabulary.byte_sizes[flat]
    bounds = np.append(0, np.cumsum(sizes))
    at = np.arange(int(bounds[-1]), dtype=np.int64) + np.repeat(vocabulary.byte_starts[flat] - bounds[:-1], sizes)
    data, begin, end = vocabulary.byte_pool[at], bounds[ends[:-1]], bounds[ends[1:]]
    keep = np.ones(len(data), bool)
    keep[begin[end > begin]] = False
    lengths = np.maximum(end - begin - 1, 0)
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    valid = pa.compute.invert(missing)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep])), pa.array(valid).buffers()[1])


def _texts(batches, most: int):
    """Rows of batches in runs of about ``most`` characters."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_numpy())
        first = 0
        while first < batch.num_rows:
            base = int(sizes[first - 1]) if first else 0
            end = max(int(np.searchsorted(sizes, base + most, "right")), first + 1)
            yield batch.slice(first, end - first)
            first = end


def _encoded(name: str, most: int) -> Encoded:
    with open(SparkFiles.get(name), "rb") as file:
        return Encoded(Vocabulary(file.read()), most)


def encode(docs: DataFrame, model: str = MODEL, batch_chars: int = BATCH_CHARS, decode: bool = False, most_known: int = KNOWN_CHUNKS) -> DataFrame:
    """``docs`` with ``piece_ids`` (and ``decoded`` if wanted), named so that no column of ``docs`` is lost.

    The result for a text is that of the vocabulary's own library. Null text: null ids; empty text: no ids. A column of
    ``docs`` that is already called piece_ids or decoded is replaced. Repeated rows are encoded alike. The ids of U+2581
    are those of a space, so that character alone is not given back by decoding. Memory is bounded by ``batch_chars`` and
    the longest text. Empty input: no rows. ``model`` is a path that the driver can read; executors get the file from Spark.
    """
    docs.sparkSession.sparkContext.addFile(model)
    name = model.rsplit("/", 1)[-1]
    rest = docs.drop("piece_ids", "decoded")
    fields = [*rest.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] if decode else []

    def run(batches):
        known = kept(_encoded, name, most_known)
        vocabulary = known.vocabulary
        for batch in _texts(batches, batch_chars):
            texts = batch.column("text")
            flat, ends = known.texts(texts)
            missing = texts.is_null()
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=missing)
            batch = batch.append_column("piece_ids", ids)
            if decode:
                batch = batch.append_column("decoded", decode_all(flat, ends, missing, vocabulary))
            yield batch

    return rest.mapInArrow(in_worker(run, keeps=True), T.StructType(fields))
