"""The tokenizers library over texts through a cache of their white-space-delimited words.

The word_bpe vocabularies drop white space before any merge, so a text's ids are those of its words one after another. A word is
encoded by the library once and kept; frequent words can be given beforehand. Unseen words of Latin letters go to the library's
model many at a time: its steps before the model only turn them into lower case and their bytes into the characters that stand for them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000  # words in each of the cache's two generations, about
LATIN_WORDS = 1000  # words in a text that the model gets
_LATIN = f"^(?P<core>[A-Za-zªµºÀ-ÖØ-öø-į]+)(?P<tail>[{re.escape(punctuation.replace(chr(39), ''))}]*)$"  # letters, then marks other than '
_PROBES = ("word", "straße", "ñandú", "àéîõü", "lettersletters", "ÿþ", "x")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the library


@lru_cache(maxsize=2)
def open_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if (tokenizer.encode("a b\tc", add_special_tokens=False).ids) != [i for w in "abc" for i in tokenizer.encode(w, add_special_tokens=False).ids]:
        raise ValueError("this tokenizer's words depend on the white space around them")
    return tokenizer


def _byte_characters() -> np.ndarray:
    """For each byte the UTF-8 of the character that stands for it, [256, 2], 0 after one of ASCII: visible ones for themselves, the
    others from U+0100 on. A space, which no word has, stays."""
    visible = {*range(32, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in visible or x == 32]
    places = {x: 256 + i for i, x in enumerate(hidden) if x != 32}
    return np.array([list(chr(places.get(x, x)).encode().ljust(2, b"\0")) for x in range(256)], np.uint8)


_CHARACTERS = _byte_characters()


class LatinWords:
    """The library's model of a tokenizer over words of lower-case Latin letters, which are told apart by the tokens that end a word."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = CharDelimiterSplit(" ")
        self.ends, suffix = np.zeros(tokenizer.get_vocab_size(), bool), getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ends[[i for token, i in tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words, where each one's begin); fewer bounds where the vocabulary lacks a byte."""
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(words), LATIN_WORDS):
            raw = _CHARACTERS[np.frombuffer(" ".join(words[i : i + LATIN_WORDS]).encode(), np.uint8)].reshape(-1)
            found.append(np.array(self.tokenizer.encode_batch_fast([raw[raw > 0].tobytes().decode()], add_special_tokens=False)[0].ids, np.int64))
        ids = np.concatenate(found)
        return ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])


@lru_cache(maxsize=2)
def latin_words(path: str) -> LatinWords | None:
    """None where the model alone doesn't give the ids that the library gives to words of lower-case Latin letters."""
    tokenizer = open_tokenizer(path)
    latin = LatinWords(tokenizer)
    ids, bounds = latin.encode(list(_PROBES))
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES]
    return latin if np.array_equal(bounds, np.cumsum([0, *map(len, want)])) and ids.tolist() == [*chain.from_iterable(want)] else None


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def lengths(ids: np.ndarray, bounds: np.ndarray) -> list[int]:
    """Of each word the number of its ids."""
    return np.diff(bounds).tolist()


def id_bytes(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each word its ids as little-endian unsigned 32-bit integers."""
    raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def shared_cache(path: str, value: Callable) -> WordCache:
    """The cache of this worker, kept from task to task."""
    return WordCache(path, value)


class WordCache:
    """value turns the ids of words, and where each one's begin, into what is kept of each, which can be added (lengths, bytes)."""

    def __init__(self, path: str, value: Callable[[np.ndarray, np.ndarray], list], frequent: dict | None = None):
        self.tokenizer, self.latin = open_tokenizer(path), latin_words(path)
        self.value, self.frequent = value, frequent or {}
        self.known, self.old = dict(self.frequent), {}

    def _encode(self, words: list[str]) -> list:
        found = []
        for i in range(0, len(words), 10_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + 10_000], add_special_tokens=False)]
            found += self.value(np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum([0, *map(len, ids)]))
        return found

    def _learn(self, words: list[str]) -> None:
        """Latin words with a tail of marks are put together from the two parts, which the library always splits."""
        parts = pc.extract_regex(pa.array(words, pa.string()), _LATIN)
        latin = parts.is_valid().to_numpy(zero_copy_only=False)
        other = [words[i] for i in np.flatnonzero(~latin)]
        self.known.update(zip(other, self._encode(other), strict=True))
        cores, tails = (pc.utf8_lower(pc.struct_field(parts.drop_null(), x)).dictionary_encode() for x in ("core", "tail"))
        names = strings(cores.dictionary)
        ids, bounds = self.latin.encode(names) if self.latin else (None, ())
        core = self.value(ids, bounds) if len(bounds) == len(names) + 1 else self._encode(names)
        tail = self._encode(strings(tails.dictionary))
        both = zip(cores.indices.to_numpy().tolist(), tails.indices.to_numpy().tolist(), strict=True)
        self.known.update(zip((words[i] for i in np.flatnonzero(latin)), [core[i] + tail[j] for i, j in both], strict=True))

    def _meet(self, words: Iterable[str]) -> None:
        """Makes distinct words known; the older generation goes when the younger is full."""
        if len(self.known) > CACHE_WORDS + len(self.frequent):
            self.known, self.old = dict(self.frequent), self.known
        new = [w for w in words if w not in self.known]
        self.known.update((w, self.old[w]) for w in new if w in self.old)
        self._learn([w for w in new if w not in self.old])

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(what is kept of all words of a text column, as bytes one after another, where each text's begin); for values that are
        bytes. Words are cut at the white space of ASCII; other white space stays in them, and the library drops it."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        names = strings(words.dictionary)
        self._meet(names)
        taken = pa.array(map(self.known.__getitem__, names), pa.large_binary(), size=len(names)).take(words.indices)
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        return np.frombuffer(data or b"", np.uint8, int(at[-1])), at[split.offsets.to_numpy()]

    def words(self, texts: list[str]) -> Iterator[list]:
        """For each text what is kept of its words, in order."""
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            split = [t.split() if not _CONTROL.search(t) else None for t in part]
            self._meet(set(chain.from_iterable(filter(None, split))))
            for text, words in zip(part, split, strict=True):
                if words is None:
                    ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
                    yield self.value(ids, np.array([0, len(ids)]))
                else:
                    yield list(map(self.known.__getitem__, words))
