"""Language-model scoring: unigram counts of the whole training corpus, and a gated recurrent model on top of them.

Words are known by their 64-bit hashes. The most frequent HEAD_WORDS are the model's own words; all others fall into
TAIL_CLASSES by their first and last byte, and inside a tail class a word has the share (c + 1) / (N_j + V_j + 1) of its training count
c, of the class's N_j tokens and V_j words. So each score needs the count of every token: counts of the TABLE_WORDS most frequent words
are broadcast, the rest are looked up in buckets of the hash space, where packed lookups meet the count table.

The recurrent part starts at the log shares of the whole corpus's counts and learns from every training text, in rounds: replicas of
REPLICA_TOKENS tokens or so, dealt by a hash of the text, train from the broadcast weights, and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.gru import Gru
from lumora.llm.text import buffers, hash_spans, mix, slices, spans
from lumora.session import cut, ship

HEAD_WORDS = 2048
TAIL_CLASSES = 64
TABLE_WORDS = 1 << 16
REPLICA_TOKENS = 1_000_000  # tokens that a replica trains on in a round, about
SMALL_TOKENS = 1_200_000  # fewer training tokens are passed over more than once, up to three times
ROUNDS = (1, 1, 2, 4, 8, 16)  # shares of the texts that the rounds take; with few tokens there is one round
PARTS = 16  # of the weights, averaged apart
SEGMENT = 2048  # a longer text trains in parts of so many tokens, the state anew in each
BUCKET_WORDS = 400_000  # words of the count table in a bucket, about
BUCKET_LOOKUPS = 2_000_000  # lookups in a bucket, about
COUNTED = 1_000_000  # words of slices that a task counts together, about
SLOT_BITS = 18  # first bits of a hash, by which a word of the broadcast table is found
TEXTS = 2000  # texts scored together, or
BYTES = 8 << 20  # so many bytes of text


def words_and_classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tail classes, where each text's words begin) of the words of a text column."""
    buf, offsets = buffers(column)
    starts, ends, at = spans(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), at
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += 32
    ends_of = fold[buf[starts]] * np.uint64(256) + fold[buf[ends - 1]]
    return hash_spans(buf, starts, ends), (mix(ends_of) % np.uint64(TAIL_CLASSES)).astype(np.uint8), at


def _by_word(words: np.ndarray, kinds: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their tail classes, the sums of their n, or how often they occur)."""
    known = pa.array(words).dictionary_encode()
    at, distinct = known.indices.to_numpy(), known.dictionary.to_numpy()
    own = np.empty(len(distinct), kinds.dtype)
    own[at] = kinds
    return distinct, own, np.bincount(at, weights=n, minlength=len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, ...]] = []

    def summed() -> pa.RecordBatch:
        words, kinds, n = _by_word(*map(np.concatenate, zip(*found, strict=True)))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(kinds.astype(np.int32)), pa.array(n)], ["word", "kind", "n"])

    for batch in batches:
        for piece in slices(batch, TEXTS, BYTES):
            found.append(_by_word(*words_and_classes(piece.column("text"))[:2]))
            if sum(len(x[0]) for x in found) > COUNTED:
                yield summed()
    if found:
        yield summed()


@dataclass
class Model:
    """words: the hashes of the broadcast table, ascending; counts and tokens: theirs (a token is a head word's id or HEAD_WORDS plus
    a tail class); shares: log10(N_j + V_j + 1) of the tail classes; end: the count of the end; total, distinct: N and V."""

    words: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    shares: np.ndarray
    end: int
    total: int
    distinct: int
    gru: Gru | None = None

    def look_up(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, token) of words."""
        tokens = kinds.astype(np.int32) + HEAD_WORDS
        counts = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        first = np.searchsorted(self.words >> np.uint64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        at, last = first[slot], first[slot + 1] - 1  # the words that a hash can be among
        left = np.flatnonzero(at <= last)
        while len(left):
            own = at[left]
            same = self.words[own] == hashes[left]
            found, own = left[same], own[same]
            counts[found], tokens[found] = self.counts[own], self.tokens[own]
            left = left[~same & (at[left] < last[left])]
            at[left] += 1
        return counts, tokens

    def sequences(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end after each text, bounds) for the recurrent model."""
        bounds = at + np.arange(len(at))
        ids = np.full(bounds[-1], self.gru.end, np.int32)
        inside = np.ones(len(ids), bool)
        inside[bounds[1:] - 1] = False
        ids[inside] = tokens
        return ids, bounds


def _score(batches: Iterator[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    base = TaskContext.get().partitionId() << 40
    rows = 0
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bucket", "words", "owners"]
    kinds_of = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
    denominator = np.log10(model.total + model.distinct + 1)
    for batch in batches:
        for piece in slices(batch, TEXTS, BYTES):
            hashes, kinds, at = words_and_classes(piece.column("text"))
            counts, tokens = model.look_up(hashes, kinds)
            n, owner = piece.num_rows, np.repeat(np.arange(piece.num_rows), np.diff(at))
            per_text = lambda values, owner=owner, n=n: np.bincount(owner, weights=values, minlength=n)
            plus = np.log10(np.maximum(counts, 0) + 1)
            tail = tokens >= HEAD_WORDS
            n_tokens = np.diff(at) + 1
            base_score = per_text(plus) + np.log10(model.end + 1) - n_tokens * denominator
            score = model.gru.score(*model.sequences(tokens, at)) / np.log(10) + per_text(np.where(tail, plus - model.shares[kinds], 0.0))
            known = per_text((counts > 0).astype(float)).astype(np.int64) + (model.end > 0)
            texts = [np.arange(rows, rows + n) + base, piece.column("doc_id"), piece.column("held_out"), n_tokens, known, base_score, score, *(pa.nulls(n, k) for k in kinds_of[7:])]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(texts, kinds_of, strict=True)], names)
            rare = counts < 0
            words, owners = hashes[rare], owner[rare].astype("<u4")
            place = (words >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            order = np.argsort(words, kind="stable")  # and so by place
            words, owners, place = words[order].astype("<u8"), owners[order], place[order].astype(np.int32)
            cuts = np.flatnonzero(np.diff(place)) + 1
            some = place[np.concatenate([[0], cuts])] if len(place) else place
            blobs = [[x.tobytes() for x in np.split(v, cuts)] if len(v) else [] for v in (words, owners)]
            lookups = [np.full(len(some), base + rows), *(pa.nulls(len(some), k) for k in kinds_of[1:7]), some, *blobs]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(lookups, kinds_of, strict=True)], names)
            rows += n


def _meet(lookups: pa.Table, counts: pa.Table) -> pa.Table:
    """For each row of a bucket's lookups, packed: its texts, their sums of log10(c + 1) and of known tokens; at most one of each a lookup."""
    order = np.argsort(known := counts.column("word").to_numpy().view(np.uint64))
    known, n = known[order], counts.column("n").to_numpy()[order]
    answers: list[list[bytes]] = [[], [], []]
    for words, owners in zip(*(lookups.column(c).to_pylist() for c in ("words", "owners")), strict=True):
        words, owners = np.frombuffer(words, "<u8"), np.frombuffer(owners, "<u4")
        c = np.zeros(len(words))
        if len(known):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            c = np.where(known[at] == words, n[at], 0)
        texts, back = np.unique(owners, return_inverse=True)
        for kept, x in zip(answers, (texts.astype("<u4"), np.bincount(back, weights=np.log10(c + 1)), np.bincount(back, weights=c > 0).astype("<u4")), strict=True):
            kept.append(x.tobytes())
    return pa.table([lookups.column("uid").cast(pa.int64()), *(pa.array(x, pa.binary()) for x in answers)], ["slice", "texts", "plus", "found"])


def _add_up(answers: pa.Table) -> pa.Table:
    """(uid, plus, found) of the texts of a slice, from the answers of all buckets."""
    texts, plus, found = (np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("texts", "<u4"), ("plus", "<f8"), ("found", "<u4")))
    own, back = np.unique(texts, return_inverse=True)
    uids = own.astype(np.int64) + (answers.column("slice")[0].as_py() if len(own) else 0)
    sums, known = np.bincount(back, weights=plus, minlength=len(own)), np.bincount(back, weights=found, minlength=len(own)).astype(np.int64)
    return pa.table([pa.array(uids), pa.array(sums), pa.array(known)], ["uid", "plus", "found"])


def count_words(training: DataFrame) -> DataFrame:
    """(word, kind, n): hash, tail class and count of every word of training(text)."""
    counted = training.select("text").mapInArrow(_count, "word long, kind int, n long")
    return cut(counted.groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n")))


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The token ids of texts, packed; key: theirs, another one for each copy in a slice, so that copies are dealt too."""
    model: Model = shared.value
    for batch in batches:
        for piece in slices(batch, TEXTS, BYTES):
            hashes, kinds, at = words_and_classes(piece.column("text"))
            ids, bounds = model.sequences(model.look_up(hashes, kinds)[1], at)
            keys = piece.column("key").to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            nth = np.empty(len(keys), np.uint64)
            nth[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
            keys = np.where(nth > 0, mix(keys + nth), keys)
            ids = ids.astype("<u2")
            blobs = [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(blobs, pa.binary())], ["key", "ids"])


def _train(texts: pa.Table, shared, epochs: int, span: tuple[float, float]) -> pa.Table:
    """The weights of a replica after its texts, times their tokens, in PARTS."""
    gru: Gru = copy(shared.value)
    gru.p = {k: v.copy() for k, v in gru.p.items()}
    replica, texts = texts.column("replica")[0].as_py(), texts.sort_by([("key", "ascending")])
    blobs = texts.column("ids").to_pylist()
    lengths = np.array([len(x) // 2 for x in blobs])
    parts = -(-lengths // SEGMENT)
    follows = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    bounds = np.append(np.repeat(np.cumsum(lengths) - lengths, parts) + follows * SEGMENT, lengths.sum())
    width = int(np.clip(lengths.sum() // 6000, 32, 192))
    gru.train(np.frombuffer(b"".join(blobs), "<u2").astype(np.int32), bounds, epochs=epochs, width=width, span=span, follows=follows > 0)
    weights = np.array_split(gru.flat().astype(np.float64) * lengths.sum(), PARTS)
    columns = [[replica] * PARTS, list(range(PARTS)), [int(lengths.sum())] * PARTS, [w.tobytes() for w in weights]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["replica", "part", "tokens", "weights"])


def _average(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by([("replica", "ascending")])
    total = sum(np.frombuffer(w.as_py(), np.float64) for w in parts.column("weights"))
    mean = total / sum(parts.column("tokens").to_pylist())
    return pa.table([pa.array([parts.column("part")[0].as_py()], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["part", "weights"])


def _step(weights, epochs: int, span: tuple[float, float]) -> Callable[[pa.Table], pa.Table]:
    return lambda texts: _train(texts, weights, epochs, span)


def train(training: DataFrame, model: Model) -> None:
    """Trains the recurrent part of the model on all texts of training(doc_id, text)."""
    sc = training.sparkSession.sparkContext
    shared = sc.broadcast(model)
    keyed = training.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    encoded = cut(keyed.mapInArrow(lambda batches: _encode(batches, shared), "key long, ids binary"))
    epochs = int(np.clip(-(-SMALL_TOKENS // model.total), 1, 3))
    shares = np.array(ROUNDS if model.total > SMALL_TOKENS else (1,)) / sum(ROUNDS if model.total > SMALL_TOKENS else (1,))
    place = F.pmod("key", F.lit(1 << 20)) / float(1 << 20)
    done = 0.0
    for i, share in enumerate(shares):
        upto = done + share if i < len(shares) - 1 else 1.0
        replicas = max(1, round(model.total * share / REPLICA_TOKENS))
        weights = sc.broadcast(model.gru)
        mine = encoded.where((place >= done) & (place < upto)).withColumn("replica", F.pmod(F.shiftright("key", 20), F.lit(replicas)))
        trained = mine.groupBy("replica").applyInArrow(_step(weights, epochs, (done, upto)), "replica long, part int, tokens long, weights binary")
        found = trained.groupBy("part").applyInArrow(_average, "part int, weights binary").collect()
        if found:
            model.gru.set_flat(np.concatenate([np.frombuffer(r.weights, np.float64) for r in sorted(found, key=lambda r: r.part)]))
        done = upto


def most_frequent(counts: DataFrame, k: int) -> list:
    """The k rows of counts(word, kind, n) with the highest n, ties by word; a histogram says which ones can be among them."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    taken, least = 0, 0
    for r in sizes:
        taken, least = taken + r.words, r.level
        if taken >= k:
            break
    return counts.where(level >= least).orderBy(F.desc("n"), "word").limit(k).collect()


def fit(training: DataFrame, counts: DataFrame, seed: int = 0) -> Model:
    """A model of training(doc_id, text) and its counts. Without training texts the recurrent part is left as it was drawn."""
    texts = training.count()
    top = most_frequent(counts, TABLE_WORDS)
    by_kind = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (np.array([getattr(by_kind[j], x) if j in by_kind else 0 for j in range(TAIL_CLASSES)], np.int64) for x in "nv")
    total, distinct = int(n.sum()) + texts, int(v.sum()) + (texts > 0)
    for r in top[:HEAD_WORDS]:
        n[r.kind] -= r.n
        v[r.kind] -= 1
    words = np.array([r.word for r in top], np.int64).view(np.uint64)
    tokens = np.array([i if i < HEAD_WORDS else HEAD_WORDS + r.kind for i, r in enumerate(top)], np.int32)
    order = np.argsort(words)
    model = Model(words[order], np.array([r.n for r in top], np.int64)[order], tokens[order], np.log10(n + v + 1.0), texts, total, distinct, Gru(HEAD_WORDS, TAIL_CLASSES, seed=seed))
    if texts:
        model.gru.start_at(np.array([r.n for r in top[:HEAD_WORDS]]), n, texts)
        train(training, model)
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text, held_out).

    It learns from the rows that aren't held out. Tokens are the words, A-Z as a-z, and one end. base_score sums
    log10((c + 1) / (N + V + 1)), score is the model's log10 probability of the whole text, words and end. A null text is
    empty: only the end. A null held_out counts as false. Repeated rows each come out, other columns are ignored, an empty table gives an empty result.
    Two words whose 64-bit hashes meet would share a count (about 1e-5 for ten million words).
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = count_words(training)
    model = fit(training, counts)
    buckets = max(1, model.distinct // BUCKET_WORDS, model.total // BUCKET_LOOKUPS // 4)
    shared = spark.sparkContext.broadcast(model)
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bucket int, words binary, owners binary"
    scored = cut(docs.mapInArrow(lambda batches: _score(batches, shared, buckets), schema))
    place = F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(word, 40) * {buckets}, 24) as int)")
    rare = counts.select(place.alias("bucket"), "word", "n")
    lookups = scored.where("bucket is not null").select("bucket", "uid", "words", "owners")
    answers = lookups.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(_meet, "slice long, texts binary, plus binary, found binary")
    found = answers.groupBy("slice").applyInArrow(_add_up, "uid long, plus double, found long")
    texts = scored.where("bucket is null").join(found, "uid", "left")
    plus = F.coalesce("plus", F.lit(0.0))
    return texts.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + plus).alias("base_score"), (F.col("score") + plus).alias("score"),
    )
