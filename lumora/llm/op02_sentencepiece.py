"""SentencePiece encoding by a unigram Viterbi search over a double-array trie of pieces, and decoding.

The text gets a leading blank, blanks become the marker U+2581, and the pieces with the highest sum of scores are taken. A character
that no piece covers costs the least score less 10 and comes out as its UTF-8 byte pieces. No piece has a
marker after another character or holds a newline, so the search runs on each marked word alone; workers search a
batch's unseen words together, all words one position a step, and keep the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.session import ship

MARK = "▁"
CACHE_WORDS = 300_000  # words whose pieces a worker keeps at a time
PLACES = 100  # places tried for a state's children before they go to the end of the trie
LONG_BYTES = 256  # longer words are searched one by one
_CHAR = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


@dataclass
class Pieces:
    """A vocabulary. base, check, value: the double-array trie over UTF-8 bytes; value is a piece's id or -1."""

    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown_score: float


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: from state s the byte c leads to base[s] + c if check there is s. The root is state 0."""
    children: dict[bytes, list[int]] = {b"": []}
    for key in keys:
        for i in range(len(key)):
            head = key[: i + 1]
            if head not in children:
                children[head] = []
                children[key[:i]].append(key[i])
    base, check, value = ([x] * (len(children) + 512) for x in (0, -1, -1))
    check[0], free, top = 0, 1, 1
    level = [(b"", 0)]
    for head, state in level:
        codes = children[head]
        value[state] = keys.get(head, -1)
        if not codes:
            continue
        while check[free] != -1:
            free += 1
        low, tries = min(codes), 0
        at = max(1, free - low)
        while any(check[at + c] != -1 for c in codes):
            tries += 1
            at = at + 1 if tries < PLACES else max(at + 1, top - low)
        base[state] = at
        for c in codes:
            check[at + c] = state
            level.append((head + bytes([c]), at + c))
        top = max(top, at + max(codes) + 1)
        if top + 512 > len(check):
            for x, empty in ((base, 0), (check, -1), (value, -1)):
                x.extend([empty] * len(x))
    base, check, value = (np.array(x, np.int32) for x in (base, check, value))
    return base, check, value


def load(path: str) -> Pieces:
    """The vocabulary of a .model file: pieces, log scores and byte pieces; control and unknown pieces aren't matched.

    The public file's scores are ranks (its pieces come from merges): a piece of rank r gets the log probability that Zipf's law
    gives it, log(1 / (r + 1)) less the log of their sum.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    texts, byte_ids, plain = [b""] * len(ids), np.full(256, -1, np.int32), {}
    for i in ids:
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            texts[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain[piece.encode()] = i
            texts[i] = piece.replace(MARK, " ").encode()
    if any(MARK in p.decode().lstrip(MARK) or b"\n" in p for p in plain):
        raise ValueError("a piece spans words")
    ranks = np.minimum(-np.array([model.get_score(i) for i in ids]), len(ids))
    scores = -np.log1p(np.maximum(ranks, 0)) - np.log(np.sum(1 / np.arange(1, len(ids) + 1)))
    return Pieces(texts, scores, byte_ids, *double_array(plain), float(scores[list(plain.values())].min()) - 10)


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def _search_one(p: Pieces, word: bytes) -> list[int]:
    n = len(word)
    best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
    base, check, value = p.base, p.check, p.value
    i = 0
    while i < n:
        char, state, single = _char_bytes(word[i]), 0, False
        for j in range(i, n):
            after = base[state] + word[j]
            if after >= len(check) or check[after] != state or not after:
                break
            state = after
            piece = value[state]
            if piece >= 0:
                single |= j + 1 - i == char
                if (score := best[i] + p.scores[piece]) > best[j + 1]:
                    best[j + 1], back[j + 1] = score, (i, piece)
        end = min(n, i + char)
        if not single and (score := best[i] + p.unknown_score) > best[end]:
            best[end], back[end] = score, (i, -1)
        i = end
    ids: list[int] = []
    while n:
        i, piece = back[n]
        ids[:0] = [int(piece)] if piece >= 0 else [int(p.byte_ids[b]) for b in word[i:n]]
        n = i
    return ids


def _search_many(p: Pieces, words: list[bytes]) -> list[np.ndarray]:
    """The best pieces of words of LONG_BYTES bytes at most: the search steps over byte positions of all words at once."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    codes = np.zeros((len(words), width), np.uint8)
    codes[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    best = np.full((len(words), width + 1), -np.inf)
    best[:, 0] = 0
    came, piece_at = np.zeros((len(words), width + 1), np.int32), np.full((len(words), width + 1), -1, np.int32)
    char = np.select([codes < 0xC0, codes < 0xE0, codes < 0xF0], [1, 2, 3], 4)
    first = (codes & 0xC0) != 0x80
    for i in range(width):
        here = np.flatnonzero((lengths > i) & first[:, i])
        alive, state = here, np.zeros(len(here), np.int32)
        single = np.zeros(len(words), bool)
        for j in range(i, width):
            inside = lengths[alive] > j
            alive, state = alive[inside], state[inside]
            after = np.minimum(p.base[state] + codes[alive, j], len(p.check) - 1)
            going = (p.check[after] == state) & (after > 0)
            alive, state = alive[going], after[going]
            if not len(alive):
                break
            piece = p.value[state]
            found = piece >= 0
            rows, ids = alive[found], piece[found]
            single[rows[char[rows, i] == j + 1 - i]] = True
            score = best[rows, i] + p.scores[ids]
            better = score > best[rows, j + 1]
            rows = rows[better]
            best[rows, j + 1], came[rows, j + 1], piece_at[rows, j + 1] = score[better], i, ids[better]
        rows = here[~single[here]]
        if len(rows):
            end = np.minimum(i + char[rows, i], lengths[rows])
            score = best[rows, i] + p.unknown_score
            better = score > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], came[rows, end], piece_at[rows, end] = score[better], i, -1
    row_parts, id_parts, at = [], [], lengths.copy()
    rows = np.arange(len(words))
    while len(rows):
        ids, starts = piece_at[rows, at[rows]], came[rows, at[rows]]
        known = ids >= 0
        row_parts.append(rows[known])
        id_parts.append(ids[known])
        for r, s in zip(rows[~known], starts[~known], strict=True):
            raw = codes[r, s : at[r]][::-1]
            row_parts.append(np.full(len(raw), r))
            id_parts.append(p.byte_ids[raw])
        at[rows] = starts
        rows = rows[at[rows] > 0]
    flat_rows, flat_ids = np.concatenate(row_parts)[::-1], np.concatenate(id_parts)[::-1]
    order = np.argsort(flat_rows, kind="stable")
    return np.split(flat_ids[order].astype("<i4"), np.cumsum(np.bincount(flat_rows, minlength=len(words)))[:-1])


def word_keys(text: str) -> list[str]:
    """The text's marked words, each without its first marker; one that begins with a newline has none."""
    if not text:
        return []
    marked = text.replace("\n", " \n")
    if MARK not in text and "  " not in marked and marked[0] not in " \n":
        return marked.split(" ")
    return [w[1:] if w[0] == MARK else w for w in _CHAR.findall(MARK + text.replace(" ", MARK))]


class Encoder:
    """Encodes texts, keeping the pieces of the words it has seen as raw int32 bytes."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def _learn(self, words: set[str]) -> None:
        raw = {w: (w if w[:1] == "\n" else MARK + w).encode("utf-8", "replace") for w in words}
        short = sorted((w for w in raw if len(raw[w]) <= LONG_BYTES), key=lambda w: len(raw[w]))
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            for w, ids in zip(part, _search_many(self.pieces, [raw[w] for w in part]), strict=True):
                self.known[w] = ids.tobytes()
        for w in raw.keys() - set(short):
            self.known[w] = np.array(_search_one(self.pieces, raw[w]), "<i4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), 500):
            split = [word_keys(t) for t in texts[i : i + 500]]
            unseen = set().union(*split).difference(self.known)
            if len(self.known) + len(unseen) > CACHE_WORDS:
                self.known.clear()
                unseen = set().union(*split)
            self._learn(unseen)
            for words in split:
                yield np.frombuffer(b"".join([self.known[w] for w in words]), "<i4")


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of ids: markers become blanks, runs of byte pieces characters; the leading blank goes."""
    texts = pieces.texts
    return b"".join([texts[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(shared.value)
    at = None
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            at = part.schema.get_field_index("text") if at is None else at
            ids = list(encoder.encode([t or "" for t in part.column(at).to_pylist()]))
            decoded = pa.array([decode(encoder.pieces, x) for x in ids], pa.string())
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), flat)
            columns = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, decoded, lists, pa.array(list(map(len, ids)), pa.int64())], [*(n for n in part.schema.names if n != "text"), "text", "piece_ids", "n_pieces"])


def encode_texts(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(text, ...) with piece_ids array<int> and n_pieces long, and as text what decoding the ids gives back.

    The text comes back as it was, but for a literal U+2581, which decodes to a blank as the format has it.
    A null or empty text has no ids and decodes to the empty text. Any other columns pass through; columns of these two names are
    replaced. An empty table stays empty.
    """
    ship(docs.sparkSession)
    docs = docs.drop("piece_ids", "n_pieces")
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    schema = (fields + ", " if fields else "") + "text string, piece_ids array<int>, n_pieces long"
    return docs.mapInArrow(lambda batches: _encode(batches, shared), schema)
