"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D (UTF-8 never has those inside a character), compared
with A-Z as a-z. All functions take the raw buffers of an Arrow array, so no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

STEP = 1 << 17  # bytes hashed at once; a longer word is hashed alone
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


BYTES = _byte_values()
WEIGHTS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, texts: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many texts and bytes of text at most (a longer text is one slice)."""
    sizes = np.diff(buffers(batch.column("text"))[1])
    lo = 0
    while lo < batch.num_rows:
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + texts]), size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of all words in bytes, and where each text's words begin among them."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    starts, ends = ~space, ~space
    starts[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[full] = ~space[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = ~space[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, as differences of running sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        size = STEP if hi - lo <= STEP else hi - lo
        up, down = _powers(size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTES[buf[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words begin) of a string column."""
    buf, offsets = buffers(column)
    starts, ends, at = spans(buf, offsets)
    return hash_spans(buf, starts, ends), at


def hash_word(word: str) -> int:
    """The hash that word_hashes gives to a text of one word."""
    return int(word_hashes(pa.array([word]))[0][0])


def shingles(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its n-word shingles, repeats included; of its whole sequence if it has fewer words."""
    words, at = word_hashes(column)
    if len(words) >= n:
        sums = words[: len(words) - n + 1] * WEIGHTS[0]
        for j in range(1, n):
            sums += words[j : len(words) - n + 1 + j] * WEIGHTS[j]
        sums = mix(sums)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= n:
            yield sums[lo : hi - n + 1]
        elif hi > lo:
            yield mix(np.atleast_1d((words[lo:hi] * WEIGHTS[: hi - lo]).sum(dtype=np.uint64)) + np.uint64(int(hi - lo)))
        else:
            yield words[:0]


def bottom(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending; all if there are fewer."""
    if len(values) > 4 * k:
        few = np.unique(np.partition(values, 2 * k)[: 2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(values)[:k]


def overlap(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Of the k smallest values of the union of two sketches: how many both have, and how many there are."""
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    if not len(both):
        return 0, 0
    first = np.concatenate([[True], ~same])
    rank = np.cumsum(first)
    size = min(k, int(rank[-1]))
    return int((same & (rank[1:] <= size)).sum()), size
