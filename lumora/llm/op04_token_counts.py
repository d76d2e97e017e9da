"""Token counts by a two-tier lookup: a broadcast table of frequent words' lengths, and worker caches for the rest.

Nothing of the words is shuffled: the table comes from a bounded sample and only saves work, every other word is encoded
where it is met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.wordcache import WordCache, lengths
from lumora.session import ship

SAMPLE_DOCS = 2000  # texts whose words fill the table, about
TABLE_WORDS = 50_000  # words in the table
BATCH_WORDS = 20_000  # of which a batch of the sample names so many at most


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter = Counter()
        for text in batch.column("text").to_pylist():
            words.update(text.split())
        top = words.most_common(BATCH_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_lengths(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """(words joined by newlines, their token counts as bytes) of a sample's most frequent words: a compact table."""
    texts = docs.select("text").where("text is not null")
    rate = min(1.0, SAMPLE_DOCS / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate * (1 << 20)).mapInArrow(_words, "word string, n long")
    words: Counter = Counter()
    for r in sample.toLocalIterator():
        words[r.word] += r.n
    top = [w for w, _ in words.most_common(TABLE_WORDS)]
    counts = [sum(x) for x in WordCache(path, lengths).words(top)]
    kept = [(w, n) for w, n in zip(top, counts, strict=True) if n < 256]
    return "\n".join(w for w, _ in kept), bytes(n for _, n in kept)


def _count(batches: Iterator[pa.RecordBatch], path: str, shared) -> Iterator[pa.RecordBatch]:
    words, counts = shared.value
    cache = WordCache(path, lengths, dict(zip(words.split("\n"), counts, strict=True)) if counts else None)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = pa.array([sum(x) for x in cache.words(texts)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text), as the tokenizers library counts whole texts.

    path: a .json vocabulary whose words don't depend on white space, else ValueError. No begin, end or added special
    tokens, no truncation; strings of special tokens inside a text count as the library has it by default. A null
    text is empty and counts 0. Repeated rows each come out, other columns are ignored, an empty table stays empty.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(partial(_count, path=path, shared=shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
