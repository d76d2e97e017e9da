"""Alignment of two tokenizers' tokens by the bytes that they cover.

1. A task encodes its texts with both vocabularies (content-defined chunks for the byte-level one, runs of words for the pieces); the ids are
   written once, and the later steps read those.
2. Of a batch of texts laid end to end, cumsum gives where tokens end, intersect1d the cuts that both have, searchsorted each
   token's group; links come from repeating each A token over the B tokens of its group, LINKS at a time.
3. Tasks count in how many texts they met each linked pair of ids; salted partial sums, then sums, give the corpus's counts.
4. Counts and each A id's highest come back by slices of A ids of SLICE_PAIRS pairs at most (one slice, unless there are more
   pairs), each broadcast to a pass over the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.op12_bpe import encode_slice, open_bpe, slices, token_bytes
from lumora.llm.text import buffers
from lumora.session import cut, ship

LINKS = 1 << 19  # links expanded at once
TOKENS = 1 << 17  # A tokens of texts laid end to end, about
TASK_PAIRS = 1 << 20  # distinct pairs that a task counts before it hands them on
SLICE_PAIRS = 2_000_000  # pairs whose counts are broadcast at once
SALTS = 8
RUN = 512  # characters of a run of words, at least


class Pieces:
    """A sentencepiece model; texts are encoded by runs that begin at a space, where none of its pieces can span."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_control(i)]
        apart = not any("▁" in p.lstrip("▁") for p in plain)
        probe = "one  two\n three\t four   ü. 12"
        self.by_runs = apart and all(self._ids([x]) == self.model.encode([x], num_threads=1) for x in (probe, f" {probe} ", f"{probe * 40}"))

    def _runs(self, text: str) -> list[str]:
        out, at = [], 0
        while (to := text.find(" ", at + RUN)) > 0:
            while to > 0 and text[to - 1] == " ":
                to = text.find(" ", to + 1)
            if to < 0 or to + 1 == len(text):  # the model puts no space before nothing
                break
            out.append(text[at:to])
            at = to + 1  # the model puts the space before each run itself
        out.append(text[at:])
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        runs = [self._runs(t) for t in texts]
        found = iter(self.model.encode(list(chain.from_iterable(runs)), num_threads=1))
        return [list(chain.from_iterable(next(found) for _ in r)) for r in runs]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._ids(texts) if self.by_runs else self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def open_pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def _lengths(path: str) -> np.ndarray:
    table = token_bytes(path) if path.endswith(".json") else open_pieces(path).bytes_of
    return np.array([len(x) for x in table])


def _kind(path: str) -> str:
    """How an id of this vocabulary is stored."""
    return "<u2" if len(_lengths(path)) <= 1 << 16 else "<u4"


def _encode(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """The ids of both vocabularies; none where they don't give back the text with a space before it."""
    bpe, pieces = open_bpe(a, True), open_pieces(b)
    kinds = [_kind(path) for path in (a, b)]
    for batch in batches:
        for first, _, rows in slices(batch.column("text")):
            part = batch.slice(first, len(rows) - 1)
            buf, offsets = buffers(pa.array([f" {t}" if t else "" for t in part.column("text").to_pylist()], pa.string()))
            raw, at = buf.tobytes(), offsets.tolist()
            ids_a = encode_slice(bpe, buf, offsets)
            ids_b = pieces.encode([raw[lo + 1 : hi].decode() for lo, hi in zip(at, at[1:], strict=False)])
            out: tuple[list, list] = [], []
            for lo, hi, x, y in zip(at, at[1:], ids_a, ids_b, strict=False):
                same = hi > lo and b"".join(map(bpe.bytes_of.__getitem__, x.tolist())) == raw[lo:hi] == b"".join(map(pieces.bytes_of.__getitem__, y))
                for ids, kind, column in zip((x, y), kinds, out, strict=True):
                    column.append(np.array(ids, kind).tobytes() if same else b"")
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(column, pa.binary()) for column in out)], [*names, "a", "b"])


@dataclass
class Aligned:
    """Texts laid end to end: their tokens, where each text's begin, each token's group, and where each text's groups begin."""

    a: np.ndarray
    b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    at_groups: np.ndarray

    def per_text(self, of_groups: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_groups)])
        return np.diff(sums[self.at_groups])


def _offsets(column: pa.Array, kind: str) -> np.ndarray:
    """Where each row's ids begin among those of a binary column."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (at - at[0]) // np.dtype(kind).itemsize


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def align(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    ends = np.concatenate([[0], ends_a])[at_a[1:]]  # of texts
    at_groups = np.concatenate([[0], np.searchsorted(cuts, ends, "right")])
    return Aligned(a, b, at_a, at_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), at_groups)


def _parts(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Runs of rows with about TOKENS A tokens, aligned."""
    kinds, tables = (_kind(a), _kind(b)), (_lengths(a), _lengths(b))
    for batch in batches:
        at = [_offsets(batch.column(c), kind) for c, kind in zip("ab", kinds, strict=True)]
        row = 0
        while row < len(batch):
            to = max(row + 1, int(np.searchsorted(at[0], at[0][row] + TOKENS, "right")) - 1)
            part = batch.slice(row, to - row)
            ids = [_flat(part.column(c), kind) for c, kind in zip("ab", kinds, strict=True)]
            yield part, align(ids[0], at[0][row : to + 1] - at[0][row], ids[1], at[1][row : to + 1] - at[1][row], *tables)
            row = to


def pairs(x: Aligned, n_b: int, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of each text's distinct linked pairs, a pair being a * n_b + b; some: the A tokens that count."""
    texts = np.repeat(np.arange(len(x.at_a) - 1), np.diff(x.at_a))[some]
    groups, ids = x.group_a[some], x.a[some]
    counts_b = np.bincount(x.group_b, minlength=int(x.at_groups[-1]))
    first_b = np.cumsum(counts_b) - counts_b
    times = counts_b[groups]
    upto = np.concatenate([[0], np.cumsum(times)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + LINKS, "right")) - 1)
        n, total = times[lo:hi], int(upto[hi] - upto[lo])
        within = np.arange(total) - np.repeat(upto[lo:hi] - upto[lo], n)
        partner = x.b[np.repeat(first_b[groups[lo:hi]], n) + within]
        keys = (np.repeat(texts[lo:hi], n) << 40) + np.repeat(ids[lo:hi], n) * n_b + partner
        found.append(np.unique(keys, return_counts=True))
        lo = hi
    keys, links = _summed(found)
    return keys >> 40, keys & ((1 << 40) - 1), links


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their sums."""
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """(a, b, n): in how many of this task's texts ids are linked; a pair comes more than once only if there are over TASK_PAIRS."""
    n_b = len(_lengths(b))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = _summed(held)
        for i in range(0, len(keys), 100_000):
            k = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k // n_b, pa.int32()), pa.array(k % n_b, pa.int32()), pa.array(n[i : i + 100_000], pa.int64())], ["a", "b", "n"])

    for _, x in _parts(batches, a, b):
        held.append(np.unique(pairs(x, n_b)[1], return_counts=True))
        if sum(len(k) for k, _ in held) > TASK_PAIRS:
            held = [_summed(held)]
            if len(held[0][0]) > TASK_PAIRS // 2:
                yield from out()
                held = []
    yield from out()


@lru_cache(maxsize=4)
def _decimals(n: int) -> dict[str, np.ndarray]:
    return {tail: np.array([f"{i}{tail}" for i in range(n)], object) for tail in ",|;"}


def group_texts(x: Aligned, n: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each text; ids are below n."""
    order = np.argsort(np.concatenate([x.group_a * 2, x.group_b * 2 + 1]), kind="stable")
    ids, spot = np.concatenate([x.a, x.b])[order], np.concatenate([x.group_a * 2, x.group_b * 2 + 1])[order]
    step = np.diff(spot, append=spot[-1:] + 1)  # 0: the same side of the group, 1: its other side or the next group
    words = np.empty(len(ids), object)
    for tail, which in ((",", step == 0), ("|", (step != 0) & (spot % 2 == 0)), (";", (step != 0) & (spot % 2 == 1))):
        words[which] = _decimals(n)[tail][ids[which]]
    words, at = words.tolist(), (x.at_a + x.at_b).tolist()
    return ["".join(words[lo:hi])[:-1] for lo, hi in zip(at, at[1:], strict=False)]


def _measure(batches: Iterator[pa.RecordBatch], a: str, b: str, shared, lo: int, hi: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """For each row n_best and count_sum over A ids from lo on, below hi; with `whole` also the other columns."""
    len_a, len_b = _lengths(a), _lengths(b)
    known, counts, best = shared.value
    for part, x in _parts(batches, a, b):
        some = slice(None) if whole and hi >= len(len_a) else np.flatnonzero((x.a >= lo) & (x.a < hi))
        texts, pair, links = pairs(x, len(len_b), some)
        n = counts[np.searchsorted(known, pair)] if len(known) else np.zeros(0, np.int64)
        sums = np.zeros((2, len(part)), np.int64)
        np.add.at(sums[0], texts, links * (n == best[pair // len(len_b) - lo]))
        np.add.at(sums[1], texts, links * n)
        columns = [part.column("_row"), pa.array(sums[0]), pa.array(sums[1])]
        if whole:
            n_groups = np.diff(x.at_groups)
            n_links = x.per_text(np.bincount(x.group_a, minlength=int(x.at_groups[-1])) * np.bincount(x.group_b, minlength=int(x.at_groups[-1])))
            columns += [*(part.column(c) for c in part.schema.names if c not in ("_row", "a", "b")), pa.array(np.diff(x.at_a)), pa.array(np.diff(x.at_b)), pa.array(n_groups), pa.array(n_links), pa.array(group_texts(x, max(len(len_a), len(len_b))), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*(str(i) for i in range(len(columns)))])


def pair_counts(encoded: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): in how many rows of encoded(a, b) the ids are linked; salted partial sums first, then sums."""
    found = encoded.select("a", "b").mapInArrow(partial(_count, a=a, b=b), "a int, b int, n long")
    salted = found.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _id_slices(counts: DataFrame, n_a: int) -> list[tuple[int, int]]:
    """Ranges of A ids with SLICE_PAIRS pairs at most each (an id alone may have more, as many as there are B ids)."""
    sizes = np.zeros(n_a, np.int64)
    for r in counts.groupBy("a").count().toLocalIterator():  # as many rows as the vocabulary has ids, at most
        sizes[r.a] = r["count"]
    found, lo, held = [], 0, 0
    for i in range(n_a):
        if held and held + sizes[i] > SLICE_PAIRS:
            found.append((lo, i))
            lo, held = i, 0
        held += int(sizes[i])
    return [*found, (lo, n_a)]


def align_texts(docs: DataFrame, a: str, b: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for each row of docs(text, ...).

    a: a byte-level BPE .json, whose special strings are ordinary text, for the text with a space before it; b: a sentencepiece
    .model, which puts that space itself. Where tokens of both end, groups end; a link is an A and a B token of one group. A pair's
    count is the number of rows whose text links it. n_best: links whose count is the highest of their A id; count_sum: the links'
    counts, summed; groups: `a1,a2|b1;a3|b2,b3`. A null or empty text, or one that either vocabulary doesn't give back byte for byte,
    has no tokens, zeros, and '' for groups. Rows that repeat each come out and count; columns other than `keep` are left out;
    an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    encoded = docs.select(*keep, "text").mapInArrow(partial(_encode, a=a, b=b), f"{types}, a binary, b binary")
    encoded = cut(encoded.withColumn("_row", F.monotonically_increasing_id()))
    counts = cut(pair_counts(encoded, a, b))
    n_a, n_b = len(_lengths(a)), len(_lengths(b))
    sums, whole = "_row long, n_best long, count_sum long", f"{types}, n_a long, n_b long, n_groups long, n_links long, groups string"
    passes = []
    for lo, hi in _id_slices(counts, n_a):
        own = counts.where((F.col("a") >= lo) & (F.col("a") < hi)).toArrow()
        key = own.column("a").to_numpy().astype(np.int64) * n_b + own.column("b").to_numpy()
        order = np.argsort(key)
        n = own.column("n").to_numpy()
        best = np.zeros(hi - lo, np.int64)
        np.maximum.at(best, key // n_b - lo, n)
        shared = spark.sparkContext.broadcast((key[order], n[order], best))
        measure = partial(_measure, a=a, b=b, shared=shared, lo=lo, hi=hi, whole=lo == 0)
        passes.append(encoded.mapInArrow(measure, f"{sums}, {whole}") if lo == 0 else encoded.select("_row", "a", "b").mapInArrow(measure, sums))
    found, *more = passes
    if more:
        more = cut(reduce(DataFrame.unionAll, more).groupBy("_row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum")))
        found = found.join(more, "_row").withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_sum"))
    return found.select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
