"""Hard negatives of anchor vectors by blocked matrix products.

1. Vectors are quantised to whole numbers, so that products in float64 are exact below 2^53 (Cauchy-Schwarz bounds each block's;
   beyond, a block is multiplied as 64-bit integers).
2. Anchors are packed into blocks of ANCHOR_BYTES at most, one after another. A block is broadcast, and every task multiplies it with its
   rows in pieces, keeping for each anchor the best `positives` of its label. What the tasks kept is merged by anchor.
3. With the merged positives the block is broadcast again; each positive's score gives a window, and the tasks keep the best
   `negatives` of other labels in each window. These are merged by anchor and positive.

A task returns at most `positives` rows an anchor, `negatives` a window; pieces of scores never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.session import cut, scratch, ship

ANCHOR_BYTES = 32 << 20  # of the anchors that are broadcast at once, their windows included
PACK_BYTES = 2 << 20  # of the vectors that a task packs into one row of anchors
ROWS, COLUMNS = 512, 2048  # anchors and candidates multiplied at once
NONE = np.iinfo(np.int64).min
_EXACT = 2.0**52
_MOST = 2.0**62


@dataclass
class Block:
    """Anchors of one length, numbered from `first` in their broadcast; windows only in the second pass: [anchors, positives]."""

    first: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def matrices(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, quantised vectors as float64) of the rows that take part, for each length of vectors, ordered by id."""
    column, ids, labels = batch.column("embedding"), batch.column("vec_id"), batch.column("label")
    valid = np.ones(len(batch), bool)
    for c in (column, ids, labels):
        if c.null_count:
            valid &= c.is_valid().to_numpy(zero_copy_only=False)
    some = batch.filter(pa.array(valid))
    column = some.column("embedding")
    if not len(some):
        return
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    sizes = np.diff(column.offsets.to_numpy())
    ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        with np.errstate(all="ignore"):
            v = np.floor(values[starts[rows][:, None] + np.arange(dim)] * scale)
            rows_ok = np.isfinite(v).all(axis=1) & (np.einsum("ij,ij->i", v, v) < _MOST)
        rows, v = rows[rows_ok], v[rows_ok]
        order = np.argsort(ids[rows], kind="stable")
        yield ids[rows][order].astype(np.int64), labels[rows][order].astype(np.int64), v[order]


def _pack(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows of anchors of one length, of PACK_BYTES at most."""
    held: dict[int, list] = {}

    def packed(dim: int) -> pa.RecordBatch:
        parts = held.pop(dim)
        blobs = [np.concatenate([p[k] for p in parts]).tobytes() for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([sum(len(p[0]) for p in parts)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["dim", "n", "ids", "labels", "vectors"])

    for batch in batches:
        for ids, labels, v in matrices(batch, scale):
            dim = v.shape[1]
            step = max(1, PACK_BYTES // (8 * dim))
            for i in range(0, len(ids), step):
                part = tuple(x[i : i + step] for x in (ids, labels, v))
                if dim in held and sum(len(p[0]) for p in held[dim]) + len(part[0]) > step:
                    yield packed(dim)
                held.setdefault(dim, []).append(part)
    for dim in list(held):
        yield packed(dim)


def _merge(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, new_scores: np.ndarray, new_ids: np.ndarray) -> None:
    """Puts the best of the kept and the new into the kept, by row: higher scores first, then smaller ids."""
    s, i = np.concatenate([scores[rows], new_scores], axis=1), np.concatenate([ids[rows], new_ids], axis=1)
    order = np.lexsort((i, ~s), axis=-1)[:, : scores.shape[1]]  # ~s falls as s rises, without overflow
    scores[rows], ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _take(part: np.ndarray, ids: np.ndarray, scores: np.ndarray, best_ids: np.ndarray, first: int, floor: np.ndarray) -> None:
    """Merges the best columns of part (none: the least value of its type) into rows first.. of the kept; below floor nothing counts."""
    least = -np.inf if part.dtype == np.float64 else NONE
    top = part.max(axis=1)
    bar = np.maximum(scores[first : first + len(part), -1], floor)
    rows = np.flatnonzero((top > least) & (top >= bar))
    if not len(rows):
        return
    part, k = part[rows], min(scores.shape[1], part.shape[1])
    found, who = np.full((len(rows), k), NONE), np.zeros((len(rows), k), np.int64)
    for j in range(k):
        at = part.argmax(axis=1)  # the first of equal ones, which has the smallest id
        value = part[np.arange(len(rows)), at]
        real = (value > least) & (value >= floor[rows])
        found[real, j], who[real, j] = value[real].astype(np.int64), ids[at[real]]
        part[np.arange(len(rows)), at] = least
    _merge(scores, best_ids, rows + first, found, who)


def _scan(batches: Iterator[pa.RecordBatch], blocks, scale: float, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of this task's rows for each anchor, in the second pass for each window of each anchor."""
    kept = {}
    for batch in batches:
        for ids, labels, v in matrices(batch, scale):
            block = blocks.value.get(v.shape[1])
            if block is None or not len(ids):
                continue
            width = 1 if block.low is None else block.low.shape[1]
            if v.shape[1] not in kept:
                kept[v.shape[1]] = (np.full((width, len(block.ids), k), NONE), np.zeros((width, len(block.ids), k), np.int64))
            scores, best = kept[v.shape[1]]
            bound = np.sqrt(np.einsum("ij,ij->i", v, v).max() * np.einsum("ij,ij->i", block.vectors, block.vectors).max())
            a, b = (block.vectors, v) if bound < _EXACT else (block.vectors.astype(np.int64), v.astype(np.int64))
            least = -np.inf if bound < _EXACT else NONE
            for i in range(0, len(block.ids), ROWS):
                rows = slice(i, i + ROWS)
                for j in range(0, len(ids), COLUMNS):
                    columns = slice(j, j + COLUMNS)
                    s = a[rows] @ b[columns].T
                    same = block.labels[rows, None] == labels[None, columns]
                    if block.low is None:
                        s[~same | (block.ids[rows, None] == ids[None, columns])] = least
                        _take(s, ids[columns], scores[0], best[0], i, np.full(len(s), NONE))
                        continue
                    s[same] = least
                    for w in range(width):
                        _take(np.where(s <= block.high[rows, w, None], s, least), ids[columns], scores[w], best[w], i, block.low[rows, w])
    for dim, (scores, best) in kept.items():
        block = blocks.value[dim]
        for w in range(len(scores)):
            row, j = np.nonzero(scores[w] != NONE)
            for at in range(0, len(row), 50_000):
                r, c = row[at : at + 50_000], j[at : at + 50_000]
                columns = [block.first + r, block.ids[r], np.full(len(r), w), best[w][r, c], scores[w][r, c]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["anchor", "anchor_id", "window", "id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merges what the tasks kept: the first k of each anchor and window, with their rank from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(packed: DataFrame, of: list) -> dict[int, Block]:
    """The anchors of some rows of the packed table, by length."""
    parts: dict[int, list] = {}
    for r in packed.where(F.col("pack").isin(of)).toLocalIterator():
        parts.setdefault(r.dim, []).append((np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), np.frombuffer(r.vectors).reshape(r.n, r.dim)))
    blocks, first = {}, 0
    for dim, p in parts.items():
        blocks[dim] = Block(first, *(np.concatenate(x) for x in zip(*p, strict=True)))
        first += len(blocks[dim].ids)
    return blocks


def _set_windows(blocks: dict[int, Block], top: DataFrame, k: int, low: int, high: int) -> None:
    """Gives the blocks the windows of their anchors' positives (top), of which there are k an anchor at most."""
    table = top.select("anchor", "rank", "score").toArrow()
    anchors, ranks = table.column("anchor").to_numpy(), table.column("rank").to_numpy()
    scores = table.column("score").to_pylist()  # whole numbers without bound, as products with low and high may pass 64 bits
    lows = np.array([max(NONE + 1, min(-NONE - 1, -(-low * s // 100))) for s in scores], np.int64)
    highs = np.array([max(NONE, min(-NONE - 1, high * s // 100)) for s in scores], np.int64)
    for block in blocks.values():
        n = len(block.ids)
        block.low, block.high = np.full((n, k), NONE + 1), np.full((n, k), NONE)
        mine = (anchors >= block.first) & (anchors < block.first + n)
        at = (anchors[mine] - block.first, ranks[mine] - 1)
        block.low[at], block.high[at] = lows[mine], highs[mine]


def mine_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among vectors(vec_id, embedding, label).

    anchors: a condition on vec_id. Components become floor(scale * x); a score is the inner product with the anchor; higher
    scores come first, ties by smaller vec_id. An anchor's positives are its first `positives` rows of its label and another vec_id;
    its negatives for a positive are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score, ranked from 1. Only vectors of one length are compared. Rows with a null vec_id, label or vector, an
    empty vector, a null or non-finite component, or a squared length of 2^62 or more take no part. Rows that repeat a vec_id each
    count, as anchors too. Anchors without positives, and positives without negatives, give no row; an empty table gives none.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    packed = rows.where(anchors).mapInArrow(partial(_pack, scale=scale), "dim int, n int, ids binary, labels binary, vectors binary")
    packed = cut(packed.withColumn("pack", F.monotonically_increasing_id()))
    groups: list[list] = []
    filled = ANCHOR_BYTES
    for r in packed.select("pack", (F.col("n").cast("long") * 8 * (F.col("dim") + 3 + 4 * positives)).alias("size")).orderBy("pack").toLocalIterator():
        if filled + r.size > ANCHOR_BYTES:
            groups.append([])
            filled = 0
        groups[-1].append(r.pack)
        filled += r.size
    folder, found = scratch(spark, "negatives-"), "anchor long, anchor_id long, window long, id long, score long"
    for n, of in enumerate(groups):
        blocks = _blocks(packed, of)
        first = spark.sparkContext.broadcast(blocks)
        top = cut(_best(rows.mapInArrow(partial(_scan, blocks=first, scale=scale, k=positives), found), positives))
        _set_windows(blocks, top, positives, low, high)
        second = spark.sparkContext.broadcast(blocks)
        near = _best(rows.mapInArrow(partial(_scan, blocks=second, scale=scale, k=negatives), found), negatives)
        near = near.select("anchor", "anchor_id", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        held = top.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = near.join(held, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        named.write.parquet(f"{folder}/{n}")
        first.destroy()
        second.destroy()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not groups:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in range(len(groups))))
