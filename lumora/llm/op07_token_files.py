"""Token ids in binary files of patched frame-of-reference blocks.

A file holds a run of documents in ascending doc_id order, all little-endian:

    magic "PFOR0001", then u64: documents, ids, blocks, exceptions, bytes of packed ids
    document ids i64, flags u8 (1: the doc_id is null), lengths u32   one for each document
    block minimum u32, width u8, exceptions before it u32, packed bytes before it u64   one for each block (the index)
    packed ids: each block's ids less its minimum, the low `width` bits of each, lowest bit first
    exceptions: place in the block u8, high bits u32

A block has 256 ids, the last is filled up with its minimum. Its width fits PERCENTILE of 100 of its ids; the others keep their high
bits in the exception list.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.op03_mixing import running
from lumora.llm.text import slices
from lumora.llm.wordcache import id_bytes, shared_cache
from lumora.session import cut, scratch, ship

MAGIC = b"PFOR0001"
BLOCK = 256
PERCENTILE = 95
FILE_IDS = 1 << 21  # a file is closed at the document that reaches so many ids
TEXTS = 4000  # texts encoded together, or
BYTES = 8 << 20  # so many bytes of text
_GROUP = 256  # blocks packed at once


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _layout(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id of a block: the 64-bit word that its bits begin in, its place in there; and the ids whose bits end in the next word."""
    at = np.arange(BLOCK) * width
    return at >> 6, (at & 63).astype(np.uint64), np.flatnonzero((at & 63) + width > 64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """(minimum, width, exceptions before, bytes before, packed, places, high bits) of the blocks of ids."""
    n = -(-len(ids) // BLOCK)
    blocks = np.empty(n * BLOCK, np.uint32)
    blocks[: len(ids)] = ids
    if n:
        blocks[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    blocks = blocks.reshape(n, BLOCK)
    low = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    lengths = _bit_lengths(rest)
    at = BLOCK * PERCENTILE // 100
    width = np.partition(lengths, at, axis=1)[:, at] if n else np.zeros(0, np.uint8)
    over = lengths > width[:, None]
    rows, places = np.nonzero(over)
    high = rest[rows, places] >> width[rows]
    starts = np.concatenate([[0], np.cumsum(width.astype(np.uint64) * (BLOCK // 8))]).astype(np.uint64)
    packed = np.zeros(int(starts[-1]) // 8, "<u8")
    for w in np.unique(width[width > 0]).tolist():
        word, shift, over_edge = _layout(w)
        for group in np.array_split(chosen := np.flatnonzero(width == w), -(-len(chosen) // _GROUP)):
            bits = rest[group].astype(np.uint64) & np.uint64((1 << w) - 1)
            lines = np.bitwise_or.reduceat(bits << shift, np.flatnonzero(np.diff(word, prepend=-1)), axis=1)
            lines[:, word[over_edge] + 1] |= bits[:, over_edge] >> (np.uint64(64) - shift[over_edge])
            packed[starts[group].astype(np.int64)[:, None] // 8 + np.arange(lines.shape[1])] = lines
    before = np.searchsorted(rows, np.arange(n)).astype(np.uint32)
    return low, width, before, starts[:-1], packed.tobytes(), places.astype(np.uint8), high.astype(np.uint32)


def unpack(n_ids: int, low, width, before, starts, packed: np.ndarray, places, high) -> np.ndarray:
    """The ids of the blocks; the inverse of pack."""
    n = len(low)
    rest = np.zeros((n, BLOCK), np.uint32)
    packed = packed.view("<u8")
    for w in np.unique(width[width > 0]).tolist():
        word, shift, over_edge = _layout(w)
        for group in np.array_split(chosen := np.flatnonzero(width == w), -(-len(chosen) // _GROUP)):
            lines = packed[starts[group].astype(np.int64)[:, None] // 8 + np.arange(w * BLOCK // 64)]
            bits = lines[:, word] >> shift
            bits[:, over_edge] |= lines[:, word[over_edge] + 1] << (np.uint64(64) - shift[over_edge])
            rest[group] = bits & np.uint64((1 << w) - 1)
    rows = np.repeat(np.arange(n), np.diff(np.append(before, len(places)).astype(np.int64)))
    rest[rows, places] |= high << width[rows].astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)[:n_ids]


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents: their ids one after another in `ids`."""
    low, width, before, starts, packed, places, high = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(low), len(places), len(packed)], "<u8")
    parts = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), lengths.astype("<u4"), low.astype("<u4"), width, before.astype("<u4"), starts.astype("<u8")]
    return MAGIC + b"".join(x.tobytes() for x in (head, *parts)) + packed + places.tobytes() + high.astype("<u4").tobytes()


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; ValueError if it isn't whole."""
    if raw[:8] != MAGIC or len(raw) < 48:
        raise ValueError("not a token file")
    docs, n_ids, blocks, exceptions, size = (int(x) for x in np.frombuffer(raw, "<u8", 5, 8))
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, kind, n, at)
        at += part.nbytes
        return part

    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    low, width, before, starts = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u8", blocks)
    ids = unpack(n_ids, low, width, before, starts, take("u1", size), take("u1", exceptions), take("<u4", exceptions))
    if at != len(raw) or lengths.sum(dtype=np.int64) != n_ids:
        raise ValueError("a token file is cut short")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, ids


def _put(folder: str, name: str, raw: bytes) -> None:
    """Writes a file whole: under a name of its own first, then renamed. What an earlier run of the task left is replaced."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(raw)
    if store.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        store.delete_file(f"{path}/{name}")
    store.move(own, f"{path}/{name}")


def _with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of texts, end_id after each, where each text's begin)."""
    bounds = bounds + np.arange(len(bounds))
    out, inside = np.full(len(ids) + len(bounds) - 1, end_id, np.uint32), np.ones(len(ids) + len(bounds) - 1, bool)
    inside[bounds[1:] - 1] = False
    out[inside] = ids
    return out, bounds


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache = shared_cache(path, id_bytes)
    part, doc_ids, lengths, texts, size, files, n_ids = TaskContext.get().partitionId(), [], [], [], 0, 0, 0

    def flush() -> None:
        nonlocal doc_ids, lengths, texts, size, files, n_ids
        _put(folder, f"{part:08d}-{files:06d}.pfor", to_bytes(doc_ids, np.concatenate(lengths), np.concatenate(texts)))
        files, n_ids = files + 1, n_ids + size
        doc_ids, lengths, texts, size = [], [], [], 0

    for batch in batches:
        for piece in slices(batch, TEXTS, BYTES):
            raw, at = cache.joined(piece.column("text"))
            ids, bounds = _with_end(raw.view("<u4"), at // 4, end_id)
            rows, lo = piece.column("doc_id").to_pylist(), 0
            while lo < len(rows):
                hi = min(len(rows), int(np.searchsorted(bounds, bounds[lo] + FILE_IDS - size)))
                doc_ids += rows[lo:hi]
                lengths.append(np.diff(bounds[lo : hi + 1]))
                texts.append(ids[bounds[lo] : bounds[hi]])
                size += int(bounds[hi] - bounds[lo])
                if size >= FILE_IDS:
                    flush()
                lo = hi
    if doc_ids:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([n_ids])], ["files", "ids"])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> tuple[int, int]:
    """Encodes docs(doc_id, text) and writes their ids, each document's followed by end_id, into files under folder; returns
    (files, ids). The files' names ascend as the doc_ids in them, null first; rows of one doc_id stand together by a hash of
    the text, and may fill several ranges.

    folder: a URI that the executors share and pyarrow can write (file://, hdfs://, s3:// ...). A null text is empty.
    An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")]
    ranged = docs.select("text", *order).repartitionByRange(parts, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row")
    done = ranged.select("doc_id", "text").mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id), "files long, ids long")
    files, ids = done.agg(F.sum("files"), F.sum("ids")).first()
    return files or 0, ids or 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            doc_ids, lengths, ids = from_bytes(content.as_py())
            part, number = re.search(r"(\d+)-(\d+)\.pfor$", name).groups()
            starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            raw = ids.astype("<u4")
            crcs = [crc32(raw[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([(int(part) << 32) + int(number)] * n, pa.int64()), pa.array(starts[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "file", "at", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, file, at, n_tokens, ids_crc32) of each document in the files under folder; file ascends as they were written,
    at counts the ids before it in its file. A file that is cut short is an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInArrow(_read, "doc_id long, file long, at long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs(doc_id, text), from files written and read back.

    start counts the ids of all documents before it, ids_crc32 is over its ids as little-endian unsigned 32-bit integers.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "tokens-")
    files, _ = write_tokens(docs, folder, path, end_id)
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = cut(read_tokens(spark, folder))
    sizes = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = running(sizes, "file", "ids", "before").select("file", "before")
    return found.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
