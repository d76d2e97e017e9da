"""Samples that are features of the reference's models: negatives of a ranking, validation rows by vertical."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.draws import digest
from lumora.operators.evaluate import KEY

try:
    from _md5 import md5  # Python's own, which takes little more than half of OpenSSL's time for a few bytes
except ImportError:
    from hashlib import md5

HARD_POOL = 200  # fused candidates that hard negatives are drawn from


def negatives(scored: DataFrame, fused: Column, n_hard: int, n_easy: int, pool: int = HARD_POOL, seed: int = 0, targets: bool = False) -> DataFrame:
    """The drawn candidates of each row of scored (the key, item_id, ...), with the column hard; with `targets` the target too, hard null.

    n_hard of the `pool` best by `fused` (ties by item), then n_easy of all others; both in the order of a digest of row and item.
    A row with fewer candidates gives what it has. One shuffle by row serves all orders.
    """
    row, draw = Window.partitionBy(*KEY), digest(*KEY, "item_id", seed=seed)
    df = scored.withColumns({"_target": F.col("item_id") == F.col("target"), "_fused": F.round(fused, 10), "_draw": draw})
    df = df.withColumn("_best", F.row_number().over(row.orderBy("_target", F.desc("_fused"), "item_id")))
    df = df.withColumn("_hard", F.row_number().over(row.orderBy("_target", F.col("_best") > pool, "_draw", "item_id")))
    df = df.withColumn("hard", F.when(~F.col("_target"), (F.col("_hard") <= n_hard) & (F.col("_best") <= pool)))
    df = df.withColumn("_easy", F.row_number().over(row.orderBy("_target", "hard", "_draw", "item_id")))
    drawn = F.col("hard") | (~F.col("hard") & (F.col("_easy") <= n_easy))
    return df.where(drawn | F.col("_target") if targets else drawn).drop("_target", "_fused", "_draw", "_best", "_hard", "_easy")


def draw(batches: Iterator[pa.RecordBatch], pools: Broadcast, n_hard: int, n_easy: int, pool: int = HARD_POOL) -> Iterator[pa.RecordBatch]:
    """The same draws where a task has each row at once: (the key, text: the key's part of the digest, zero: what candidates without a score fuse to, at, fused: places and
    fused values of the others). pools: the candidates of each vertical in their order, and the rest of the text."""
    for batch in batches:
        columns = {c: batch.column(c) for c in ("user_id", "target", "vertical")}
        texts, verticals, zeros = (batch.column(c).to_pylist() for c in ("text", "vertical", "zero"))
        items, hards, times = [], [], []
        for row in range(batch.num_rows):
            known, said = pools.value[verticals[row]]
            fused = np.full(len(known), zeros[row])
            fused[batch.column("at")[row].values.to_numpy()] = batch.column("fused")[row].values.to_numpy()
            start = f"{texts[row]}|".encode()
            high, low = np.frombuffer(b"".join([md5(start + x).digest() for x in said]), ">u8").reshape(-1, 2).T
            own = known.index(columns["target"][row]).as_py()
            others = np.delete(np.arange(len(known)), own if own is not None else [])
            best = others[np.argsort(-fused[others], kind="stable")[:pool]]
            hard = _first(best, high, low, n_hard)
            easy = _first(np.setdiff1d(others, hard, assume_unique=True), high, low, n_easy)
            items.append(known.take(pa.array(np.concatenate([hard, easy]))))
            hards.append(np.arange(len(hard) + len(easy)) < len(hard))
            times.append(len(hards[-1]))
        if items:
            rows = pa.array(np.repeat(np.arange(batch.num_rows), times))
            yield pa.RecordBatch.from_arrays([*(x.take(rows) for x in columns.values()), pa.concat_arrays(items), pa.array(np.concatenate(hards))], [*columns, "item_id", "hard"])


def _first(places: np.ndarray, high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """The n of the places with the smallest digests."""
    if len(places) > n:
        places = places[high[places] <= np.partition(high[places], n - 1)[n - 1]]
    return places[np.lexsort((places, low[places], high[places]))[:n]]


def rows_by_vertical(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows of each vertical at most, in the order of a digest of the row; each task keeps its first n before the shuffle."""
    place = F.row_number().over(Window.partitionBy("vertical").orderBy(digest(*KEY, seed=seed), *KEY))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
