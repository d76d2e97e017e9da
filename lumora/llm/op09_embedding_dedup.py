"""Embedding near-deduplication by collision counting over one-dimensional projections.

1. Equal vectors form one class. Unit vectors are projected on M orthogonal random directions, scaled so that the difference of two
   projections has the deviation of the vectors' distance.
2. The sorted projections are cut at quantiles, the first into slabs and the second, inside each slab, into tiles of about TILE_VALUES components.
   Two tiles meet only where the first projection's windows of REACH deviations overlap, and where enough projections of
   the tiles can collide at all.
3. Where tiles meet, each vector's window of half width WINDOW in every projection is held against the other's, and collisions are counted
   for each pair (on projections in steps of STEP, the window rounded up). Pairs with at least `least_count` collisions are
   verified by their cosine in double precision: a pair at the threshold has fewer with a probability under MISS.
4. A task returns its vectors' link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, partial
from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lumora.llm.graph import connected_components, lowest_linked
from lumora.session import cut, ship

M = 32
WINDOW = 1.0
STEP = WINDOW / 15
REACH = 4.0
MISS = 1e-4
TILE_VALUES = 1 << 19  # components of a tile's vectors, about
_ROWS = 256  # rows of a tile counted at once


@lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    """min(M, dim) orthogonal directions, [dim, directions], of length sqrt(dim)."""
    q, _ = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q[:, :M] * sqrt(dim)


def least_count(similarity: float, m: int, miss: float = MISS) -> int:
    """The fewest collisions of m that a pair at the threshold has, but for miss."""
    near = erf(WINDOW / sqrt(2 - 2 * similarity) / sqrt(2)) if similarity < 1 else 1.0
    below, c = 0.0, 0
    while c < m and (below := below + comb(m, c) * near**c * (1 - near) ** (m - c)) <= miss:
        c += 1
    return c


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it lasts, tasks get so many rows at once: for rows that are tiles."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _usable(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The rows whose vector has a direction, with the vector's bytes (of this kind, no negative zero)."""
    for batch in batches:
        ids, raw = [], []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if vec_id is None or not vector.is_valid or not len(vector.values) or vector.values.null_count:
                continue
            v = vector.values.to_numpy().astype(kind) + np.zeros(1, kind)
            if np.isfinite(v).all() and v.any():
                ids.append(vec_id)
                raw.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "vector"])


def _project(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second, dims = [], [], []
        for raw in batch.column("vector").to_pylist():
            v = np.frombuffer(raw, kind).astype("<f8")
            v = v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max()
            p = v @ directions(len(v))
            first.append(p[0])
            second.append(p[min(1, len(p) - 1)])
            dims.append(len(v))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(first, pa.float64()), pa.array(second, pa.float64())], [*batch.schema.names, "dim", "p1", "p2"])


def _tile(key: tuple, rows: pa.Table, kind: str) -> pa.Table:
    vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind).reshape(rows.num_rows, -1)
    units = vectors.astype("<f8") / np.abs(vectors).max(axis=1, keepdims=True)
    p = (units / np.linalg.norm(units, axis=1, keepdims=True)) @ directions(vectors.shape[1])
    blobs = [rows.column("node").to_numpy(), rows.column("copies").to_numpy(), vectors]
    return pa.table({
        "tile": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([vectors.shape[1]], pa.int32()), "low": pa.array([p[:, 0].min()]), "high": pa.array([p[:, 0].max()]),
        "nodes": pa.array([blobs[0].astype("<i8").tobytes()], pa.binary()), "copies": pa.array([blobs[1].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
    })


def _meet(batches: Iterator[pa.RecordBatch], similarity: float, stored: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            dim, same = row["dim"], row["a"] == row["b"]
            sides = [[np.frombuffer(row[f"{x}_{end}"], kind) for x, kind in (("nodes", "<i8"), ("copies", "<i8"), ("vectors", stored))] for end in ("a", "b")]
            units = []
            for side in sides:
                v = side[2].reshape(-1, dim).astype("<f8")
                v = v / np.abs(v).max(axis=1, keepdims=True)
                units.append(v / np.linalg.norm(v, axis=1, keepdims=True))
            m = min(M, dim)
            least = least_count(similarity, m)
            steps = [np.floor(u @ directions(dim) / STEP) for u in units]
            half = ceil(WINDOW / STEP) + 1
            apart = (steps[0].min(axis=0) > steps[1].max(axis=0) + half) | (steps[1].min(axis=0) > steps[0].max(axis=0) + half)
            if m - apart.sum() < least:
                continue
            x, y = (np.ascontiguousarray((s % 256).astype(np.uint8).T) for s in steps)  # collisions that only wrap around are verified away
            found_a, found_b = [], []
            for lo in range(0, x.shape[1], _ROWS):
                part = x[:, lo : lo + _ROWS]
                count = np.zeros((part.shape[1], y.shape[1]), np.uint8)
                for i in range(m):
                    count += (part[i][:, None] - y[i][None, :] + np.uint8(half)) <= np.uint8(2 * half)
                i, j = np.nonzero(count >= least)
                if same:
                    i, j = i[i + lo < j], j[i + lo < j]
                for k in range(0, len(i), 50_000):
                    a, b = i[k : k + 50_000] + lo, j[k : k + 50_000]
                    near = np.einsum("ij,ij->i", units[0][a], units[1][b]) >= similarity
                    found_a.append(a[near])
                    found_b.append(b[near])
            a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
            if not len(a):
                continue
            n, k = len(sides[0][0]), len(sides[1][0])
            links = [np.bincount(a, weights=sides[1][1][b], minlength=n), np.bincount(b, weights=sides[0][1][a], minlength=k)]
            nodes, links = np.concatenate([sides[0][0], sides[1][0]]), np.concatenate(links).astype(np.int64)
            low = lowest_linked(n + k, a, b + (0 if same else n))
            some = np.flatnonzero(links)
            roots = low[some % n if same else some]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[roots]), pa.array(links[some])], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding): groups of vectors linked by their cosine.

    Vectors of one length link at a cosine of `similarity` or more, in double precision. n_links counts the other vectors
    linked directly, component_id is the smallest vec_id reachable. Null, empty and zero vectors and any with a null or
    non-finite component link with nothing; so do rows with a null vec_id, whose component is null, and which are kept. Equal
    vectors link, also under one vec_id, and each row comes out. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select("vec_id", "embedding")
    kind = "<f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "<f8"
    usable = cut(vectors.mapInArrow(partial(_usable, kind=kind), "vec_id long, vector binary").withColumn("node", F.xxhash64("vector")))
    classes = usable.groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    placed = cut(classes.mapInArrow(partial(_project, kind=kind), "node long, vec_id long, copies long, vector binary, dim int, p1 double, p2 double"))
    cuts = placed.groupBy("dim").agg(F.count("*").alias("n")).withColumn("slabs", F.ceil(F.sqrt(F.col("n") * F.col("dim") / TILE_VALUES)).cast("int"))

    def sliced(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
        """Which of `slabs` equal shares of its group a row's value is in, ties by node."""
        at = F.row_number().over(Window.partitionBy(*by).orderBy(value, "node")) - 1
        return df.withColumn(name, F.floor(at * F.col("slabs") / F.count("*").over(Window.partitionBy(*by))).cast("int"))

    bounds = placed.join(F.broadcast(cuts), "dim").groupBy("dim").agg(F.max("slabs").alias("slabs"), F.percentile_approx("p1", [i / 256 for i in range(1, 256)], 10_000).alias("edges"))
    slab = F.floor(F.size(F.filter("edges", lambda e: e <= F.col("p1"))) * F.col("slabs") / 256).cast("int")
    slabs = placed.join(F.broadcast(bounds), "dim").withColumn("slab", F.when(F.col("slabs") <= 1, 0).otherwise(slab)).drop("edges")
    tiles = sliced(slabs, ["dim", "slab"], "p2", "part")
    tiles = tiles.withColumn("tile", F.col("dim").cast("long") * (1 << 40) + F.col("slab").cast("long") * (1 << 20) + F.col("part"))
    tiles = cut(tiles.select("tile", "node", "copies", "vector").groupBy("tile").applyInArrow(lambda key, rows: _tile(key, rows, kind), "tile long, dim int, low double, high double, nodes binary, copies binary, vectors binary"))

    reach = REACH * sqrt(2 - 2 * similarity)
    width = max(reach, 1e-3)
    spots = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    own = tiles.select(F.col("tile").alias("a"), "dim", "low", "high", spots(F.col("low"), F.col("high")).alias("spot"))
    wide = tiles.select(F.col("tile").alias("b"), "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), spots(F.col("low") - reach, F.col("high") + reach).alias("spot"))
    pairs = own.join(wide, ["dim", "spot"]).where(f"a <= b and low <= high_b + {reach} and low_b <= high + {reach}").select("a", "b", "dim").distinct()
    for end in ("a", "b"):
        side = tiles.select(F.col("tile").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("nodes", "copies", "vectors")))
        pairs = pairs.join(side, end)
    with arrow_rows(spark, 2):
        links = cut(pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(partial(_meet, similarity=similarity, stored=kind), "a long, b long, n long"))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(links.where("a <> b").select("a", "b"))
    named = placed.select("node", "vec_id", "copies").join(roots, "node", "left").join(counts, "node", "left")
    named = named.select("node", "vec_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    found = usable.select("vec_id", "node").join(named.drop("vec_id").join(least, "root"), "node").select("vec_id", "n_links", "component_id")
    rest = vectors.mapInArrow(_unusable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unusable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            if vec_id is None or not vector.is_valid or not len(vector.values) or vector.values.null_count:
                ids.append(vec_id)
                continue
            v = vector.values.to_numpy().astype("<f8")
            if not (np.isfinite(v).all() and v.any()):
                ids.append(vec_id)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["vec_id"])
