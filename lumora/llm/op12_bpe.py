"""Byte-level BPE encoding and decoding with content-defined chunks.

1. A rolling hash over WINDOW bytes cuts each text where the content says so, so passages that documents share give the same
   chunks wherever they stand.
2. A chunk is encoded once by a worker and kept from document to document and task to task (two generations of CACHE_BYTES).
   No text is shuffled.
3. What was encoded around a join of two chunks may differ from the whole text's tokens there. A window from the second place
   before the join to the second place after it, where the vocabulary's pattern always splits, is encoded again; its outer tokens
   must be the very tokens of the chunks, else the window doubles. So the result is that of the whole text.

The pattern never joins a character other than white space to white space after it, whatever stands before: those are the places.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from lumora.llm.text import buffers
from lumora.session import ship

WINDOW = 32  # bytes that decide about a cut
LEAST, MEAN, MOST = 256, 1024, 8192  # bytes of a chunk
CACHE_BYTES = 16 << 20  # of chunks and ids in each of the cache's two generations
SLICE_BYTES = 1 << 20  # bytes of texts cut at once, about
DECODED_ROWS = 500  # rows decoded at once
LONG_BYTES = 16 << 10  # pieces above go to the library, whose merges aren't quadratic in a word's length
_GEAR = np.random.default_rng(1201).integers(0, 1 << 32, 256, dtype=np.uint32)
_FACTOR = 0x9E3779B1
#: Last bytes of white-space characters in UTF-8; a character that ends in one of them is never taken for another one.
_DOUBTFUL = (0x85, 0xA0, 0x9A, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F, 0x8E)
_FIRM = np.zeros(256, bool)
_FIRM[0x21:0x7F] = _FIRM[0x80:] = True
_FIRM[list(_DOUBTFUL)] = False
_SHORT = bytes(range(0xE0))  # bytes of characters of one or two bytes
_SPACE = np.isin(np.arange(256), (9, 10, 13, 32))


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(visible)]
    return {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}


def _vocabulary(spec: dict) -> tuple[dict[bytes, int], dict[str, int], list[bytes]]:
    """(ids of ordinary tokens by their bytes, ids of special tokens, bytes by id) of a tokenizer's .json."""
    byte, special = _byte_of(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    bytes_of = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        bytes_of[i] = t
    return ranks, special, bytes_of


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """By id the bytes of a byte-level vocabulary's tokens."""
    with open(path) as f:
        return _vocabulary(json.load(f))[2]


class ByteBpe:
    """The vocabulary at path. plain: strings of special tokens inside a text are ordinary text, else tokens (the library's default).

    Chunks go to the tiktoken library with the same merges, about four times as fast. A character outside two UTF-8 bytes first
    has to show that both libraries split around it alike; else its chunks go to the tokenizers library.
    """

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        with open(path) as f:
            spec = json.load(f)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model["type"] != "BPE":
            raise ValueError("a byte-level BPE vocabulary is wanted")
        byte, (ranks, special, self.bytes_of) = _byte_of(), _vocabulary(spec)
        self.lengths = np.array([len(t) for t in self.bytes_of])
        merged = [ranks.get(bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
        self.fast, self.special, self.agreed = None, set() if plain else set(special), {}
        if merged == sorted(merged) and len({*merged}) == len(merged) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):  # a token's id is its merge's rank
            self.fast = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if plain else special)
            if not all(map(self._alike, map(chr, range(0x800)))):
                self.fast = None
        self.known: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        self.held = self.encoded = self.reused = 0

    def _alike(self, char: str) -> bool:
        probe = f"a{char}b1{char}1 {char} .{char}.{char}{char}\n{char}\n  {char}"
        return self._quick(probe).tolist() == self._library(probe).tolist()

    def _quick(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def piece(self, raw: bytes) -> np.ndarray:
        """The ids of bytes as a text of their own."""
        text = raw.decode()
        if self.fast is None or len(raw) > LONG_BYTES:
            return self._library(text)
        if raw.translate(None, _SHORT):
            for c in {*text}:
                if c > "߿" and c not in self.agreed:
                    self.agreed[c] = self._alike(c)
            if not all(self.agreed.get(c, True) for c in text):
                return self._library(text)
        return self._quick(text)

    def chunk(self, raw: bytes) -> np.ndarray:
        found = self.known.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                found = self.piece(raw)
                self.encoded += 1
            else:
                self.reused += 1
            if self.held > CACHE_BYTES:
                self.known, self.old, self.held = {}, self.known, 0
            self.known[raw] = found
            self.held += len(raw) + found.nbytes + 200
        else:
            self.reused += 1
        return found

    def document(self, raw: bytes, cuts: list[int], firm: list[int]) -> np.ndarray:
        """The ids of a text, given where its chunks begin (after 0) and the places where the pattern always splits."""
        edges = [0, *cuts, len(raw)]
        chunks = [self.chunk(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        if not cuts:
            return chunks[0]
        ends: dict[int, np.ndarray] = {}

        def kept(i: int, lo: int, hi: int) -> np.ndarray | None:
            """The ids of chunk i between two places; None where one isn't an end of its tokens."""
            if i not in ends:
                ends[i] = np.cumsum(self.lengths[chunks[i]]) + edges[i]
            a, b = np.searchsorted(ends[i], (lo, hi), "right")
            if (lo == edges[i] or a and ends[i][a - 1] == lo) and (hi == edges[i] or b and ends[i][b - 1] == hi):
                return chunks[i][a:b]
            return None

        out, at, i = [], 0, 0  # all before `at`, which lies in chunk i, is in out
        for join, cut in enumerate(cuts):
            if cut < at:
                continue
            near, after, reach = bisect_right(firm, cut), bisect_left(firm, cut), 2
            while True:
                lo = max(at, firm[near - reach] if near >= reach else 0)
                hi = firm[after + reach - 1] if after + reach <= len(firm) else len(raw)
                fresh = self.piece(raw[lo:hi])
                last = bisect_right(edges, hi - 1) - 1
                head = np.zeros(0, np.uint32) if lo == at else kept(join, lo, firm[bisect_right(firm, lo)])
                tail = np.zeros(0, np.uint32) if hi == len(raw) else kept(last, max(edges[last], firm[bisect_left(firm, hi) - 1]), hi)
                left = kept(i, at, lo)
                if left is not None and head is not None and tail is not None and np.array_equal(fresh[: len(head)], head) and np.array_equal(fresh[len(fresh) - len(tail) :], tail):
                    break
                if lo == at and hi == len(raw):
                    break
                reach *= 2
            out += [left, fresh]
            at, i = hi, last
        out.append(kept(i, at, len(raw)))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def open_bpe(path: str, plain: bool = False) -> ByteBpe:
    """One for a worker, kept from task to task."""
    return ByteBpe(path, plain)


def rolling_hash(buf: np.ndarray) -> np.ndarray:
    """For each byte a hash of the WINDOW bytes that end there, by doubling the window."""
    x, width, factor = _GEAR[buf], 1, np.uint32(_FACTOR)
    with np.errstate(over="ignore"):
        while width < WINDOW:
            y = x.copy()
            y[width:] += x[:-width] * factor
            x, width, factor = y, width * 2, factor * factor
    return x ^ (x >> np.uint32(15))


def cut_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """For each text, by its bytes: where chunks begin after its first, and where the pattern always splits."""
    starts = np.ones(len(buf) + 1, bool)
    starts[:-1] = (buf & 0xC0) != 0x80
    wanted = np.flatnonzero(rolling_hash(buf) < np.uint32((1 << 32) // (MEAN - LEAST))) + 1
    wanted = wanted[starts[wanted]]
    firm = np.flatnonzero(_FIRM[buf[:-1]] & _SPACE[buf[1:]]) + 1 if len(buf) else wanted
    cuts, places = [], []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, at = [], lo
        if hi - lo > LEAST:
            here = wanted[np.searchsorted(wanted, lo) : np.searchsorted(wanted, hi)].tolist()
            while hi - at > LEAST:
                k = bisect_left(here, at + LEAST)
                to = here[k] if k < len(here) else hi
                if to > at + MOST:
                    to = at + MOST
                    while not starts[to]:
                        to -= 1
                if to >= hi:
                    break
                own.append(to - lo)
                at = to
        cuts.append(own)
        a, b = np.searchsorted(firm, (lo, hi), "right")
        places.append((firm[a:b] - lo).tolist() if own else [])
        if places[-1] and places[-1][-1] == hi - lo:
            places[-1].pop()
    return cuts, places


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about SLICE_BYTES; a longer text is alone."""
    buf, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def encode_slice(bpe: ByteBpe, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    raw, at = buf.tobytes(), offsets.tolist()
    cuts, places = cut_places(buf, offsets)
    return [bpe.document(raw[lo:hi], c, p) if hi > lo else np.zeros(0, np.uint32) for lo, hi, c, p in zip(at, at[1:], cuts, places, strict=False)]


def _encode(batches: Iterator[pa.RecordBatch], path: str, plain: bool) -> Iterator[pa.RecordBatch]:
    bpe = open_bpe(path, plain)
    for batch in batches:
        for first, buf, offsets in slices(batch.column("text")):
            ids = encode_slice(bpe, buf, offsets)
            new = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            part = batch.slice(first, len(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), *new], [*(c for c in part.schema.names if c != "text"), "n_tokens", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = token_bytes(path)  # nothing else of the vocabulary is opened
    for whole in batches:
        for first in range(0, max(1, len(whole)), DECODED_ROWS):
            batch = whole.slice(first, DECODED_ROWS)
            texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))


def _types(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name not in without)


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), plain: bool = False) -> DataFrame:
    """Columns `keep`, n_tokens and ids for each row of docs(text, ...): whole texts as the tokenizers library encodes them.

    ids: little-endian unsigned 32-bit integers, without begin, end or added special tokens, truncation or padding. Strings of
    special tokens inside a text are those tokens, with `plain` ordinary text. A null or empty text has none. path: a byte-level
    BPE .json without normalizer, else ValueError in the tasks. Texts without white space are encoded whole. Rows that repeat each
    come out; columns other than `keep` (also ones named ids or n_tokens) are left out; an empty table stays empty.
    """
    ship(docs.sparkSession)
    docs = docs.select(*keep, "text")
    return docs.mapInArrow(partial(_encode, path=path, plain=plain), _types(docs, "text") + "n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(ids, ...) with a column text: what the library's decode(ids, skip_special_tokens=False) gives; null for null ids."""
    ship(encoded.sparkSession)
    encoded = encoded.drop("text")
    return encoded.mapInArrow(partial(_decode, path=path), _types(encoded) + "text string")
