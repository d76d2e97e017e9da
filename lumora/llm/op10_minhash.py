"""MinHash near-deduplication by bottom-k sketches of one hash function.

1. Every text becomes its set of word shingles; equal sets form one class at once, so copies never meet in pairs.
2. A class keeps the `k` smallest shingle hashes. A pair at the threshold shares at least `least_overlap` of its retained values, but for
   a probability of MISS. So when each class's values go by how many classes retain them, rarest first, both have a shared one among the
   first k - least_overlap + 1: only those key the inverted lists. What a common passage brings stands last and keys none.
3. In each list the member whose lists are longest is the pivot; the others are paired with it (a group of
   copies is a star around its original, so that finds most links without the group's square).
4. Union-sketch estimates drop pairs far below the threshold, the full sets decide the rest exactly.
5. Lists whose members aren't yet in one component form clusters (lists that share members). A cluster is cut into blocks of
   BLOCK classes; where two blocks hold different components, a task counts the overlaps of all their sketches, then of the sets of
   those that pass, and returns a spanning forest of the links. So no pair is missed and none is written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.graph import connected_components, lowest_linked
from lumora.llm.text import mix, overlap, shingles
from lumora.session import batches_of, cut, ship

MISS = 1e-6
BLOCK = 512  # classes of a cluster that are held against one another at once
COLUMNS = 4096  # shingles counted at once
BATCH_ROWS = 500  # texts or pairs of sets that a worker gets at once
BROADCAST_IDS = 1_000_000  # so many 8-byte ids at most are broadcast to find texts; more are joined


def least_overlap(similarity: float, k: int, miss: float = MISS) -> np.ndarray:
    """For union sketches of 0 to k values the fewest shared ones that a pair at the threshold has, but for miss."""
    out = np.zeros(k + 1, np.int64)
    for n in range(1, k + 1):
        below, c = 0.0, 0
        while (below := below + comb(n, c) * similarity**c * (1 - similarity) ** (n - c)) <= miss:
            c += 1
        out[n] = c
    return out


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            yield part, [np.unique(x >> np.uint64(1)) for x in shingles(part.column("text"), n)]


def _class(values: np.ndarray) -> int:
    """A 63-bit name of a set: a hash of its size and two sums over its values."""
    x = np.array([mix(values).sum(dtype=np.uint64), mix(values ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64), len(values)], np.uint64)
    return int(mix(mix(mix(x[:1]) ^ x[1:2]) ^ x[2:])[0] >> np.uint64(1))


def _sketches(batches: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for part, sets in _sets(batches, n):
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([_class(x) if len(x) else None for x in sets], pa.int64()),
                pa.array([x[:k].astype("<i8").tobytes() for x in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "class", "sketch"],
        )


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            sketches = [np.frombuffer(x, "<i8") for x in part.column("sketch").to_pylist()]
            times = [len(x) for x in sketches]
            wide = [np.repeat(part.column(c).to_numpy(zero_copy_only=False), times) for c in ("class", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.concatenate(sketches) if sketches else [], *wide)], ["key", "node", "n"])


def _alike(batches: Iterator[pa.RecordBatch], k: int, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            shared, size = overlap(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), k)
            kept.append(shared >= least[size])
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _blobs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for _, sets in _sets(batches, n):
        some = [x for x in sets if len(x)]
        yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in some], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in some], pa.binary())], ["node", "values"])


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            kept.append(den * shared >= num * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x shares with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    rows, values = [], []
    for sets in (x, y):
        rows.append(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        values.append(np.concatenate(sets))
    both = np.intersect1d(*values)
    columns = [np.minimum(np.searchsorted(both, v), max(0, len(both) - 1)) for v in values]
    for i in range(2):
        shared = both[columns[i]] == values[i] if len(both) else np.zeros(len(values[i]), bool)
        rows[i], columns[i] = rows[i][shared], columns[i][shared]
        order = np.argsort(columns[i], kind="stable")
        rows[i], columns[i] = rows[i][order], columns[i][order]
    for lo in range(0, len(both), COLUMNS):
        dense = []
        for i, sets in enumerate((x, y)):
            a, b = np.searchsorted(columns[i], [lo, lo + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[rows[i][a:b], columns[i][a:b] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _compare_blocks(rows: pa.Table, num: int, den: int, k: int, least: int) -> pa.Table:
    """The links between the two blocks (side 0 and 1, or one block with itself) that join components, as a forest."""
    order = np.argsort(rows.column("side").to_numpy(), kind="stable")
    node, root, side = (rows.column(c).to_numpy()[order] for c in ("node", "root", "side"))
    blobs = rows.column("values").to_pylist()
    sets = [np.frombuffer(blobs[i], "<i8") for i in order]
    n = np.array([len(s) for s in sets], float)
    at = int((side == 0).sum())
    a, b = (np.arange(at), np.arange(at, len(node))) if at < len(node) else (np.arange(at), np.arange(at))
    found = []
    if len(a) and len(b):
        large, small = np.maximum(n[a][:, None], n[b][None, :]), np.minimum(n[a][:, None], n[b][None, :])
        likely = (root[a][:, None] != root[b][None, :]) & (den * small >= num * large)
        likely &= _overlaps([sets[i][:k] for i in a], [sets[i][:k] for i in b]) >= np.minimum(np.ceil(num * large / den), least)
        a, b = a[likely.any(axis=1)], b[likely.any(axis=0)]
        if len(a):
            shared = _overlaps([sets[i] for i in a], [sets[i] for i in b])
            linked = (root[a][:, None] != root[b][None, :]) & (den * shared >= num * (n[a][:, None] + n[b][None, :] - shared))
            i, j = np.nonzero(linked)
            low = lowest_linked(len(node), a[i], b[j])
            found = np.flatnonzero(low != np.arange(len(node)))
            return pa.table({"a": pa.array(node[found]), "b": pa.array(node[low[found]])})
    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _attach(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """pairs(a, b) with the value of a as x and of b as y."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(name)), end)
    return pairs.select("a", "b", "x", "y")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, k: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text): groups of texts whose shingle sets are linked.

    Two texts link if den * |intersection| >= num * |union| of their sets of `shingle`-word shingles (words as in
    `lumora.llm.text`; a text of fewer words is one shingle). component_id is the smallest doc_id reachable, kept marks that
    one. Null, empty and blank texts have n_shingles 0 and link with nothing. Rows with a null doc_id link
    with nothing either, have a null component_id and are kept. Rows that repeat a doc_id each come out. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    similarity = num / den
    with batches_of(spark, BATCH_ROWS):
        sketched = cut(docs.mapInArrow(partial(_sketches, n=shingle, k=k), "doc_id long, n_shingles long, class long, sketch binary"))
    known = sketched.where("class is not null and doc_id is not null")
    classes = cut(known.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    sketches = classes.select(F.col("class").alias("node"), "sketch")

    values = classes.select("class", "n_shingles", "sketch").mapInArrow(_values, "key long, node long, n long")
    common = values.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1")
    retained, needed = F.least("n", F.lit(k)), F.least(F.ceil(F.col("n") * num / den), F.lit(int(least_overlap(similarity, k)[k])))
    of_node = Window.partitionBy("node")
    shared = values.join(common, "key").withColumn("rank", F.row_number().over(of_node.orderBy("classes", "key")))
    shared = shared.withColumn("alone", retained - F.count("*").over(of_node))
    lists = shared.where(F.col("rank") + F.col("alone") <= retained - needed + 1).select("key", "node", "n")
    lists = cut(lists)
    lists = cut(lists.join(lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"))
    central = lists.groupBy("node").agg(F.sum(F.ln("members")).alias("weight"))
    near_size = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num
    weighed = cut(lists.join(central, "node").select("key", "node", "n", "weight"))
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n")).alias("pivot"))
    stars = weighed.join(pivots, "key")
    stars = stars.where((F.col("node") != -F.col("pivot.minus")) & near_size(F.col("n"), F.col("pivot.n")))
    stars = stars.select(F.least("node", -F.col("pivot.minus")).alias("a"), F.greatest("node", -F.col("pivot.minus")).alias("b")).distinct()

    least = least_overlap(similarity, k)

    def full_sets(nodes: DataFrame) -> DataFrame:
        """(node, values) of nodes(node)."""
        firsts = cut(classes.join(nodes.withColumnRenamed("node", "class"), "class", "left_semi").select("doc_id"))
        if firsts.count() <= BROADCAST_IDS:
            firsts = F.broadcast(firsts)
        sets = docs.join(firsts, "doc_id", "left_semi").mapInArrow(partial(_blobs, n=shingle), "node long, values binary")
        with batches_of(spark, BATCH_ROWS):
            return cut(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    likely = cut(_attach(stars, sketches, "sketch").mapInArrow(partial(_alike, k=k, least=least), "a long, b long"))
    sets = full_sets(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    with batches_of(spark, BATCH_ROWS):
        first = cut(_attach(likely, sets, "values").mapInArrow(partial(_linked, num=num, den=den), "a long, b long"))
    roots = connected_components(first)

    named = lists.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    named = cut(named)
    open_lists = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    mixed = cut(named.join(open_lists, "key"))
    if not mixed.isEmpty():
        clusters = connected_components(mixed.select(F.col("node").alias("a"), (-F.col("key") - 1).alias("b"))).where("node >= 0")
        members = mixed.select("node", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node")
        place = F.row_number().over(Window.partitionBy("cluster").orderBy("root", "node")) - 1
        members = cut(members.withColumn("block", F.floor(place / BLOCK)))
        blocks = members.groupBy("cluster", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        x, y = blocks.alias("x"), blocks.alias("y")
        open_ = ~((F.col("x.low") == F.col("x.high")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.low") == F.col("y.high")))
        tasks = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & open_)
        tasks = cut(tasks.select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("x"), F.col("y.block").alias("y")))
        sides = [tasks.withColumn("block", F.col("x")).withColumn("side", F.lit(0)), tasks.where("x <> y").withColumn("block", F.col("y")).withColumn("side", F.lit(1))]
        rows = sides[0].unionByName(sides[1]).join(members, ["cluster", "block"]).join(full_sets(members.select("node").distinct()), "node")
        fewest = int(least[k])

        def compare(rows: pa.Table) -> pa.Table:
            return _compare_blocks(rows, num, den, k, fewest)

        second = cut(rows.select("cluster", "x", "y", "side", "node", "root", "values").groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long"))
        roots = connected_components(first.unionByName(second))

    named = classes.select("class", "doc_id").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least_id = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least_id, "root").select("class", "component_id")
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")).join(found, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
